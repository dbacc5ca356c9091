"""Streams: new files taken up once, rolling figures over event time, and late rows told apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def take_up(spark: SparkSession, folder: str, schema, into: str, state: str, pattern: str = "*.parquet", key: str | None = None) -> StreamingQuery:
    """Append the rows of files that were not seen before to a Parquet table, each file once, then stop."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    if key:
        rows = rows.dropDuplicates([key])
    return rows.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(into)


def daily_flow(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Sums by day and kind from a stream (ts timestamp, kind, cents), final once the watermark has passed."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "kind").agg(F.sum("cents").alias("cents"), F.count("*").alias("n"))


def rolling_flow(events: DataFrame, length: str = "7 days", step: str = "1 day", delay: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", length, step)).agg(F.sum("cents").alias("cents"))


def _parts(spark: SparkSession, folder: str, name: str, before: int | None = None) -> DataFrame | None:
    """What the batches (those before a number) have written under a name; None if nothing has been."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.parquet(f"{folder}/{name}")
    return rows if before is None else rows.where(F.col("batch") < before)


def flow_with_late(events: DataFrame, into: str, state: str, delay: str = "2 days") -> StreamingQuery:
    """Sums by day and kind of a stream (ts timestamp, kind, cents), with rows that come too late kept apart; read with ``flow_tables``.

    A row is late if it is older than the latest ts of all earlier batches less ``delay``. Each batch writes its sums, its late rows
    and its latest ts under its own number, in place of what an earlier try of the batch left: a restart counts nothing twice.
    What a batch writes is bounded by its days and kinds, and only the latest ts is read back.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = _parts(spark, into, "marks", number)
        mark = marks.agg(F.max("latest") - F.expr(f"interval {delay}")).first()[0] if marks is not None else None
        late = F.coalesce(F.col("ts") < F.lit(mark), F.lit(False)) if mark is not None else F.lit(False)
        rows = batch.where("ts is not null").withColumn("late", late).persist()
        put = lambda df, name: df.coalesce(1).write.mode("overwrite").parquet(f"{into}/{name}/batch={number}")
        sums = rows.where("not late").groupBy(F.window("ts", "1 day")["start"].alias("day"), "kind").agg(F.sum("cents").alias("cents"), F.count("*").alias("n"))
        put(sums, "sums")
        rows.where("late").drop("late").write.mode("overwrite").parquet(f"{into}/late/batch={number}")
        put(rows.agg(F.max("ts").alias("latest")).where("latest is not null"), "marks")
        rows.unpersist()

    return events.writeStream.foreachBatch(take).option("checkpointLocation", state).trigger(availableNow=True).start()


def flow_tables(spark: SparkSession, into: str, delay: str = "2 days") -> tuple[DataFrame, DataFrame]:
    """(day, kind, cents, n, final) and the late rows of ``flow_with_late``; a day is final once no row can change it."""
    sums, late, marks = (_parts(spark, into, x) for x in ("sums", "late", "marks"))
    closed = marks.agg((F.max("latest") - F.expr(f"interval {delay}")).alias("closed"))
    flow = sums.groupBy("day", "kind").agg(F.sum("cents").alias("cents"), F.sum("n").alias("n"))
    mark = closed.first()[0]
    return flow.withColumn("final", F.col("day") + F.expr("interval 1 day") <= F.lit(mark)), late.drop("batch")
