"""Parsed receipts: which are kept, which are valid, a range of dates, their order and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keeps(order_id: Column, day: Column, total_cents: Column) -> Column:
    """Whether a parsed page says anything: an order, a date or a total other than 0."""
    return (F.coalesce(order_id, F.lit("")) != "") | day.isNotNull() | (F.coalesce(total_cents, F.lit(0)) != 0)


def between(receipts: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Receipts dated from ``start`` to ``end``, both included; an end that is not given is open. Undated ones go if either is."""
    for bound, holds in ((start, lambda b: F.col("receipt_date") >= b), (end, lambda b: F.col("receipt_date") <= b)):
        if bound is not None:
            receipts = receipts.where(holds(F.lit(bound).cast("date")))
    return receipts


def by_date(receipts: DataFrame) -> DataFrame:
    """With the number of items, missing texts empty, in order of date; undated ones last."""
    texts = {c: F.coalesce(c, F.lit("")) for c in ("order_id", "apple_id", "document_number") if c in receipts.columns}
    return receipts.withColumns({**texts, "item_count": F.coalesce(F.size("items"), F.lit(0))}).orderBy(F.col("receipt_date").asc_nulls_last(), "base_name")


def summary(receipts: DataFrame) -> DataFrame:
    """One row: count, sum and mean of totals, first and last date, distinct ids in order, how many receipts each format has."""
    formats = receipts.groupBy("format_detected").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("format_detected", "count")))).alias("formats"))
    one = receipts.agg(
        F.count("*").alias("total_receipts"), F.coalesce(F.sum("total_cents"), F.lit(0)).alias("total_cents"), F.avg("total_cents").alias("average_cents"),
        F.min("receipt_date").alias("earliest"), F.max("receipt_date").alias("latest"), F.array_sort(F.collect_set("apple_id")).alias("apple_ids"),
    )
    return one.withColumn("k", F.lit(1)).join(formats.withColumn("k", F.lit(1)), "k").drop("k")


def _said(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def valid_transaction(id: Column, day: Column, description: Column, account: Column, amount: Column) -> Column:
    """All there; an amount of 0 is one."""
    return _said(id) & day.isNotNull() & _said(description) & _said(account) & amount.isNotNull()


def valid_receipt(id: Column, day: Column, vendor: Column, total_cents: Column) -> Column:
    """All there, and the total is not negative."""
    return _said(id) & day.isNotNull() & _said(vendor) & F.coalesce(total_cents >= 0, F.lit(False))


def valid_match(transaction_ok: Column, receipts_ok: Column, confidence: Column, method: Column) -> Column:
    """A valid transaction, valid receipts only (an array of booleans), a confidence from 0 to 1 and a method."""
    return transaction_ok & F.forall(receipts_ok, lambda x: x) & F.coalesce(confidence.between(0, 1), F.lit(False)) & _said(method)


def is_exact_match(confidence: Column, gap_days: Column, amount_difference: Column) -> Column:
    return F.coalesce((confidence >= 0.95) & (gap_days <= 1) & (amount_difference == 0), F.lit(False))


def total_amount(receipts: Column) -> Column:
    """The sum of the totals of an array of receipts."""
    return F.aggregate(receipts, F.lit(0).cast("long"), lambda a, r: a + F.coalesce(r["total_cents"], F.lit(0).cast("long")))
