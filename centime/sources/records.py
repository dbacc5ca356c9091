"""A file for each record, without a folder for each: a Spark data source whose tasks write into a staged folder, committed at once.

``save_records`` writes rows (name, content). A task puts its records into one folder of its own below a staged one; when all tasks
are done, one rename makes the staged folder a run, and what failed attempts left goes. So readers see a whole run or
nothing, and there are as many folders as tasks. A name written again in a later run takes the place of the earlier record.
"""

from __future__ import annotations

import email.message
import email.policy
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.accounts import mail_file_name


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    records: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
        self.path, self.run, self.staged = path.rstrip("/"), f"run-{stamp}", f".staged-{stamp}-{uuid.uuid4().hex[:8]}"

    def _store(self) -> tuple[arrow_fs.FileSystem, str]:
        return arrow_fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path)

    def write(self, iterator: Iterator) -> _Written:
        store, root = self._store()
        task, n = uuid.uuid4().hex, 0
        for row in iterator:
            if not n:
                store.create_dir(f"{root}/{self.staged}/{task}", recursive=True)
            with store.open_output_stream(f"{root}/{self.staged}/{task}/{file_name(row['name'])}") as out:
                out.write(bytes(row["content"]))
            n += 1
        return _Written(task, n)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = self._store()
        kept = {m.folder for m in messages if m is not None and m.records}
        if not kept:
            return
        for info in store.get_file_info(arrow_fs.FileSelector(f"{root}/{self.staged}")):
            if info.base_name not in kept:  # a failed attempt, or one of two that did the same
                store.delete_dir(info.path)
        store.move(f"{root}/{self.staged}", f"{root}/{self.run}")

    def abort(self, messages: list[_Written | None]) -> None:
        store, root = self._store()
        if store.get_file_info(f"{root}/{self.staged}").type == arrow_fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staged}")


class RecordFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def file_name(name: str) -> str:
    """A name as that of a file: whatever it holds, it stays one file in its folder."""
    safe = quote(name, safe=" @+,=()[]{}!'", encoding="utf-8")
    return safe.replace(".", "%2E", 1) if safe.startswith(".") else safe


def save_records(records: DataFrame, folder: str) -> None:
    """Write rows (name string, content string or binary) as files. Rows without a name or content are left out; of one name in a run one stays."""
    records.sparkSession.dataSource.register(RecordFiles)
    rows = records.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content")).where("name is not null and content is not null")
    rows.dropDuplicates(["name"]).write.format("record_files").mode("append").save(folder)


def read_records(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """(name, content, run): of every name the record of the latest run. No runs: no rows."""
    try:
        found = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/run-*/*/*")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "name string, content binary, run string")
        raise
    parts = F.split("path", "/")
    named = found.select(F.url_decode(F.replace(F.element_at(parts, -1), F.lit("+"), F.lit("%2B"))).alias("name"), "content", F.element_at(parts, -3).alias("run"))
    last = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("run")))
    return named.where(F.col("name").endswith(suffix)).withColumn("last", last).where("last = 1").drop("last")


def save_receipts(receipts: DataFrame, folder: str) -> None:
    """Parsed receipts as ``<base_name>.json``, a file each."""
    save_records(receipts.select(F.concat("base_name", F.lit(".json")).alias("name"), F.to_json(F.struct("*")).alias("content")), folder)


def load_receipts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The receipts that ``save_receipts`` wrote, each as of the latest run, in columns of ``schema``."""
    return read_records(spark, folder, ".json").select(F.from_json(F.decode("content", "UTF-8"), schema).alias("r")).select("r.*")


def save_mail(mail: DataFrame, folder: str) -> None:
    """Messages (sent_on, subject, message_id, sender, html, text) as files: ``.eml``, ``.json`` with what is known of it, ``.html`` and ``.txt`` where there is such a body.

    Names are those of ``accounts.mail_file_name``, so a message saved again takes the place of the earlier one.
    """
    base = mail_file_name(F.col("sent_on"), F.coalesce("subject", F.lit("")), F.coalesce("message_id", F.lit("")))
    known = F.to_json(F.struct("message_id", "subject", "sender", F.col("sent_on").cast("string").alias("date"), F.col("html").isNotNull().alias("has_html"), F.col("text").isNotNull().alias("has_text")))
    rows = mail.select(base.alias("base"), known.alias("known"), "sender", "subject", "message_id", F.date_format("sent_on", "EEE, dd MMM yyyy HH:mm:ss").alias("sent"), "html", "text")

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                out.append((f"{r.base}.json", r.known.encode()))
                out.append((f"{r.base}.eml", _message(r)))
                out += [(f"{r.base}.{kind}", body.encode()) for kind, body in (("html", r.html), ("txt", r.text)) if body is not None]
            yield pd.DataFrame(out, columns=["name", "content"])

    save_records(rows.mapInPandas(files, "name string, content binary"), folder)


def _message(r) -> bytes:
    m = email.message.EmailMessage(policy=email.policy.SMTP)
    for header, value in (("From", r.sender), ("Subject", r.subject), ("Message-ID", r.message_id), ("Date", r.sent and f"{r.sent} +0000")):
        if value is not None:
            m[header] = " ".join(value.split())
    m.set_content(r.text or "")
    if r.html is not None:
        m.add_alternative(r.html, subtype="html")
    return m.as_bytes()
