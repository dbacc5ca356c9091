"""Ledger transactions matched to receipts by exact total and nearest date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scoring


#: Cents of a block of amounts, in which places are counted.
BLOCK = 1 << 16


def valid_receipts(receipts: DataFrame) -> DataFrame:
    return receipts.dropna(subset=["receipt_date", "total_cents"])


def match_receipts(transactions: DataFrame, receipts: DataFrame, window_days: int = 3) -> DataFrame:
    """One row for each transaction (tx_id, date, cents): the receipt of equal total nearest in date within the window.

    The exact-date match is the case of gap 0, so one equality join with a band serves both: on the amount and a bucket of
    dates as wide as the window, in which a receipt lies with the buckets beside it, so that popular totals meet only what is
    of about then. Ties go to the first base_name. Gaps over 3 days (in a wider window) have confidence 0.
    """
    t = transactions.select("tx_id", "date", F.abs("cents").alias("amount_cents"))
    r = valid_receipts(receipts).select("base_name", "receipt_date", F.col("total_cents").alias("amount_cents"))
    gap, width = F.abs(F.datediff("date", "receipt_date")), max(window_days, 1)
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / width)
    around = F.explode(F.array(*[bucket("receipt_date") + n for n in (-1, 0, 1)])) if window_days else bucket("receipt_date")
    met = t.withColumn("bucket", bucket("date")).join(r.withColumn("bucket", around), ["amount_cents", "bucket"]).where(gap <= window_days).select("tx_id", "base_name", gap.alias("gap"))
    first = met.groupBy("tx_id").agg(F.min(F.struct("gap", "base_name")).alias("m")).select("tx_id", "m.gap", "m.base_name")
    score = scoring.by_gap(F.col("gap"), scoring.RECEIPT, 0)
    return t.join(first, "tx_id", "left").select(
        "tx_id",
        "amount_cents",
        F.col("base_name").isNotNull().alias("matched"),
        "base_name",
        "gap",
        F.when(F.col("gap") == 0, "exact_match").when(F.col("gap").isNotNull(), "date_window_match").otherwise("no_match").alias("method"),
        F.coalesce(score, F.lit(0)).alias("score"),
        F.when(F.col("base_name").isNull(), F.col("amount_cents")).otherwise(F.lit(0)).cast("long").alias("unmatched_cents"),
    )


def near_misses(transactions: DataFrame, receipts: DataFrame, most: int = 5) -> DataFrame:
    """For each transaction up to ``most`` receipts of the same day with other totals, the closest first (a top-k report).

    (tx_id, base_name, off, rank), ties by base_name. A day's distinct totals and amounts stand in one order; what is closest
    to an amount is among as many totals on either side of it, so rows grow with the amounts, not with the pairs of a day.
    Places are counted within blocks of BLOCK cents and added up over the blocks, so no task holds a whole day.
    """
    t = transactions.select("tx_id", "date", F.abs("cents").alias("amount_cents"))
    r = valid_receipts(receipts).select("base_name", F.col("receipt_date").alias("date"), "total_cents")
    first = r.withColumn("k", F.row_number().over(Window.partitionBy("date", "total_cents").orderBy("base_name"))).where(F.col("k") <= most)
    totals = first.groupBy("date", F.col("total_cents").alias("at")).agg(F.collect_list("base_name").alias("names"))
    amounts = t.select("date", F.col("amount_cents").alias("at"), F.lit(True).alias("asked")).distinct()
    line = totals.unionByName(amounts, allowMissingColumns=True).groupBy("date", "at").agg(F.first("names", ignorenulls=True).alias("names"), F.first("asked", ignorenulls=True).alias("asked"))
    line = line.withColumn("block", F.floor(F.col("at") / BLOCK))
    upto = Window.partitionBy("date", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("date").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = line.groupBy("date", "block").agg(F.count("names").alias("n")).select("date", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    line = line.withColumn("within", F.count("names").over(upto)).join(blocks, ["date", "block"]).withColumn("place", F.col("before") + F.col("within"))
    spots = line.where("asked").select("date", "at", F.explode(F.sequence(F.col("place") - most, F.col("place") + most)).alias("place"))
    beside = line.where("names is not null").select("date", "place", F.col("at").alias("total_cents"), "names")
    met = spots.join(beside, ["date", "place"]).where("total_cents <> at").select("date", "at", F.abs(F.col("total_cents") - F.col("at")).alias("off"), F.explode("names").alias("base_name"))
    closest = met.groupBy("date", "at").agg(F.slice(F.array_sort(F.collect_list(F.struct("off", "base_name"))), 1, most).alias("closest"))
    found = t.join(closest.withColumnRenamed("at", "amount_cents"), ["date", "amount_cents"]).select("tx_id", F.posexplode("closest").alias("i", "m"))
    return found.select("tx_id", "m.base_name", "m.off", (F.col("i") + 1).alias("rank"))


def summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("total_transactions"),
        F.count_if("matched").alias("matched_transactions"),
        F.round(F.try_divide(F.count_if("matched"), F.count("*")), 6).alias("match_rate"),
        F.round(F.avg(F.when(F.col("matched"), F.col("score"))) / 100, 3).alias("average_confidence"),
        F.coalesce(F.sum(F.when(F.col("matched"), F.col("amount_cents"))), F.lit(0)).alias("matched_cents"),
        F.coalesce(F.sum("unmatched_cents"), F.lit(0)).alias("unmatched_cents"),
    )
