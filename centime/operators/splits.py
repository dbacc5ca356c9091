"""Matched totals allocated to line items, so that each transaction's splits add up exactly. Amounts in milliunits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import cents_to_milliunits, floor_div, proportional


def memo(name: Column, quantity: Column) -> Column:
    return F.when(quantity > 1, F.concat(name, F.lit(" (qty: "), quantity.cast("string"), F.lit(")"))).otherwise(name)


def order_splits(items: DataFrame) -> DataFrame:
    """items (tx_id, tx_mu, idx, name, quantity, cents) to splits with ``ok``: do they add up to minus the amount?"""
    out = items.select("tx_id", "tx_mu", "idx", (-cents_to_milliunits(F.col("cents"))).alias("amount_mu"), memo(F.col("name"), F.col("quantity")).alias("memo"))
    total = F.sum("amount_mu").over(Window.partitionBy("tx_id"))
    return out.withColumn("ok", total == -F.abs("tx_mu"))


def receipt_splits(items: DataFrame) -> DataFrame:
    """items (tx_id, tx_mu, idx, name, cents, subtotal_cents, tax_cents) to splits with the tax spread over them.

    Each item takes its share of the tax rounded down, the last one what remains. A missing subtotal is the items' sum.
    """
    by = Window.partitionBy("tx_id")
    base = F.coalesce("subtotal_cents", F.sum("cents").over(by))
    tax = F.coalesce("tax_cents", F.lit(0))
    shared = items.withColumns({"base": base, "tax": F.when(base == 0, F.lit(0)).otherwise(tax)})
    shared = shared.withColumn("share", proportional(F.col("cents"), F.col("base"), F.col("tax")))
    last = F.row_number().over(by.orderBy(F.col("idx").desc())) == 1
    mine = F.when(last, F.col("tax") - F.sum("share").over(by) + F.col("share")).otherwise(F.col("share"))
    out = shared.select("tx_id", "tx_mu", "idx", F.col("name").alias("memo"), "cents", mine.alias("tax_cents"))
    out = out.withColumn("amount_mu", -cents_to_milliunits(F.col("cents") + F.col("tax_cents")))
    return out.withColumn("ok", F.sum("amount_mu").over(by) == -F.abs("tx_mu"))


def generic_splits(items: DataFrame) -> DataFrame:
    """items (tx_id, idx, name, cents, category_id) to splits as they are."""
    return items.select("tx_id", "idx", (-cents_to_milliunits(F.col("cents"))).alias("amount_mu"), F.col("name").alias("memo"), "category_id")


def validate(splits: DataFrame, tolerance: int = 0) -> DataFrame:
    """(tx_id, n_splits, gap, valid): do the splits of each transaction (tx_mu, amount_mu) add up within the tolerance?"""
    gap = F.sum("amount_mu") + F.first(F.abs("tx_mu"))
    return splits.groupBy("tx_id").agg(F.count("*").alias("n_splits"), gap.alias("gap")).withColumn("valid", F.abs("gap") <= tolerance)


def sorted_splits(splits: DataFrame) -> DataFrame:
    """Splits with their place: the largest amount first, then by memo."""
    order = Window.partitionBy("tx_id").orderBy(F.abs("amount_mu").desc(), "memo", "idx")
    return splits.withColumn("place", F.row_number().over(order))


def summary(splits: DataFrame) -> DataFrame:
    """For each transaction: count, sum, average rounded down, extremes of the absolute amounts, the first three memos."""
    memos = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("idx", "memo"))), 1, 3), lambda x: F.substring(x["memo"], 1, 50))
    total, n = F.sum("amount_mu"), F.count("*")
    return splits.groupBy("tx_id").agg(
        n.alias("n_splits"), total.alias("total_mu"), F.floor(total.cast("decimal(20,0)") / n).cast("long").alias("average_mu"),
        F.max(F.abs("amount_mu")).alias("largest_mu"), F.min(F.abs("amount_mu")).alias("smallest_mu"), F.array_join(memos, "|").alias("memos"),
    )


def balance_adjustments(updates: DataFrame, accounts: DataFrame) -> DataFrame:
    """updates (account_id, new_cents) to adjusting edits for the accounts (id, name, balance_mu) that differ."""
    met = updates.join(accounts.withColumnRenamed("id", "account_id"), "account_id")
    change = F.col("new_cents") - floor_div(F.abs("balance_mu"), 10)
    return met.select("account_id", "name", change.alias("adjustment_cents"), F.lit("Balance adjustment").alias("memo")).where("adjustment_cents <> 0")
