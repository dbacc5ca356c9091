"""Helpers that the operators share: table access, checkpoints and Arrow batch plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..checkpoints import checkpoint_dir, checkpointed, remove_folder

__all__ = ["as_bytes", "checkpoint_dir", "checkpointed", "crc_mod", "free_name", "hashed_sample", "map_rows", "quoted", "remove_folder", "spread", "table", "texts_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores if its files make fewer partitions than there are: small tables come as one row group.

    For operators whose work per row is in Python; those of DataFrame functions alone take the table as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes of a batch that are Python values at a time, about; a longer row comes alone.
SLICE_BYTES = 4 << 20


def map_rows(df: DataFrame, make: Callable[[], Callable[[tuple], tuple | None]], schema: str | StructType) -> DataFrame:
    """Map each row to a row of ``schema`` in Arrow batches; ``make`` runs once a task.

    Strings reach the function as UTF-8 bytes, other values as Python values.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            step = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, step):
                columns = [as_bytes(c).to_pylist() for c in batch.slice(at, step).columns]
                rows = [f(r) for r in zip(*columns)]
                rows = [r for r in rows if r is not None]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows), fields)], schema=fields)

    return df.mapInArrow(run, schema)


def quoted(name: str) -> str:
    """A column name as an expression that means that column, whatever its characters."""
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def as_bytes(column: pa.Array) -> pa.Array:
    if pa.types.is_string(column.type):
        return column.cast(pa.binary())
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary())
    return column


def hashed_sample(df: DataFrame, key: str, by: str, per_class: int) -> dict:
    """A bounded sample to fit a model on: the keys of at most ``per_class`` rows of each value of ``by``, repeated keys once.

    Keys are taken by the order of a hash, which does not depend on partitions. Class sizes are counted first, so that only
    about twice the keys asked for leave the scan, and no other column does. ``by`` must have few values (classes of a classifier).
    """
    df = df.select(key, by).where(F.col(by).isNotNull() & F.col(key).isNotNull()).distinct()
    counts = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    spot = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30))
    share = F.coalesce(*[F.when(F.col(by) == F.lit(k), F.lit(int(min(1.0, 2 * per_class / n + 20 / n) * (1 << 30)))) for k, n in counts.items()]) if counts else F.lit(0)
    found: dict = {k: [] for k in counts}
    for r in df.withColumn("spot", spot).where(F.col("spot") < share).collect():
        found[r[by]].append(r)
    return {k: [r[key] for r in sorted(v, key=lambda r: (r["spot"], str(r[key])))[:per_class]] for k, v in sorted(found.items())}


def texts_of(docs: DataFrame, keys: list) -> DataFrame:
    """(doc_id, text) of a bounded list of ids, which is broadcast; of an id's repeated rows the least text."""
    picked = docs.sparkSession.createDataFrame([(k,) for k in keys], docs.select("doc_id").schema).distinct()
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"))


def crc_mod(column, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(column.cast("string").cast("binary")) % n
