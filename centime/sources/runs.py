"""Runs of results that are safe to repeat: data first, a manifest last, and readers follow manifests only.

Each attempt at a run writes into folders of its own. Its manifest then takes the next free number by a rename that never
replaces a file. A run counts once, as its last committed attempt; what a failed or running attempt has written is in no
manifest, so no reader ever sees half a run.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import remove_folder

_MANIFEST = "number long, run string, attempt string, rows map<string,bigint>"


class RunStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _fs(self):
        return self._path("manifests").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, run: str, tables: dict[str, DataFrame]) -> int:
        """Write a run's tables and commit them together; the commit's number."""
        attempt, counts = uuid.uuid4().hex, {}
        for name, df in tables.items():
            seen = Observation()
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.folder}/data/{name}/{attempt}")
            counts[name] = seen.get["rows"]
        return self._commit({"run": run, "attempt": attempt, "rows": counts})

    def _commit(self, manifest: dict) -> int:
        jvm, fs = self.spark._jvm, self._fs()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.spark._jsc.hadoopConfiguration())
        keep = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        fs.mkdirs(self._path("manifests"))
        number = max([0, *(r["number"] for r in self._manifests().select("number").collect())]) + 1
        while True:
            draft = self._path("drafts", f"{manifest['attempt']}.json")
            out = fs.create(draft, True)
            out.write(bytearray(json.dumps({"number": number, **manifest}).encode()))
            out.close()
            if not fs.exists(self._path("manifests", f"{number:012d}.json")):
                try:
                    context.rename(draft, self._path("manifests", f"{number:012d}.json"), keep)
                    return number
                except Exception:  # another writer took the number meanwhile
                    if not fs.exists(self._path("manifests", f"{number:012d}.json")):
                        raise
            number += 1

    def _manifests(self) -> DataFrame:
        if not self._fs().exists(self._path("manifests")):
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).json(f"{self.folder}/manifests")

    def runs(self) -> DataFrame:
        """(run, number, attempt, rows): the committed runs, each as its last attempt; rows maps a table's name to its rows."""
        last = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("number")))
        return self._manifests().withColumn("last", last).where("last = 1").select("run", "number", "attempt", "rows")

    def read(self, name: str, run: str | None = None, newest: bool = False) -> DataFrame | None:
        """The rows of a table with their ``run``: of all runs, of one, or of the newest (the greatest name). None if no run has it.

        Manifests, one small row a run, are read on the driver; data are not.
        """
        found = {r["attempt"]: r["run"] for r in self.runs().where(F.map_contains_key("rows", F.lit(name))).collect() if run in (None, r["run"])}
        if newest and found:
            found = {a: r for a, r in found.items() if r == max(found.values())}
        if not found:
            return None
        data = self.spark.read.parquet(*[f"{self.folder}/data/{name}/{a}" for a in found])
        attempt = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        names = self.spark.createDataFrame([(a, r) for a, r in found.items()], "attempt string, run string")
        return data.withColumn("attempt", attempt).join(names, "attempt").drop("attempt")

    def prune(self) -> int:
        """Take away attempts that no reader follows: superseded, failed ones (no attempt may be running meanwhile); how many."""
        kept, gone, fs = {r["attempt"] for r in self.runs().select("attempt").collect()}, 0, self._fs()
        tables = fs.listStatus(self._path("data")) if fs.exists(self._path("data")) else []
        for table in tables:
            for attempt in fs.listStatus(table.getPath()):
                if attempt.getPath().getName() not in kept:
                    remove_folder(self.spark, attempt.getPath().toString())
                    gone += 1
        return gone
