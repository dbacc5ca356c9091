"""From matches to edits: matched orders and receipts brought to their items, split, checked and nested for writing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import cents_to_milliunits, proportional, with_symbol
from . import splits
from .accounts import account_type, provider


def order_edit_rows(best: DataFrame, items: DataFrame) -> DataFrame:
    """Splits (tx_id, idx, amount_mu, memo, ok, source) of best matches (tx_id, tx_mu, account, order_id, item_idx) over items.

    items: account, order_id, idx, name, quantity, cents. item_idx names the items that a split payment took; null takes all.
    Matches without an order, an id or an amount have none.
    """
    known = best.where("order_id is not null and tx_id is not null and tx_mu is not null").select("tx_id", "tx_mu", "account", "order_id", "item_idx")
    met = known.join(items, ["account", "order_id"]).where(F.col("item_idx").isNull() | F.array_contains("item_idx", F.col("idx").cast("int")))
    return splits.order_splits(met).select("tx_id", "idx", "amount_mu", "memo", "ok", F.lit("orders").alias("source"))


def receipt_edit_rows(matches: DataFrame, receipts: DataFrame) -> DataFrame:
    """Splits of receipt matches (transaction_id, transaction_mu, matched, receipt_ids) over receipts with nested items.

    Only matches of one receipt count, and only if that receipt is there and has items. receipts: base_name, subtotal_cents,
    tax_cents, items (array of structs with title and cents).
    """
    single = matches.where(F.col("matched") & (F.size("receipt_ids") == 1) & F.col("transaction_id").isNotNull() & F.col("transaction_mu").isNotNull())
    named = single.select(F.col("transaction_id").alias("tx_id"), F.col("transaction_mu").alias("tx_mu"), F.col("receipt_ids")[0].alias("base_name"))
    met = named.join(receipts.select("base_name", "subtotal_cents", "tax_cents", F.posexplode("items").alias("idx", "item")), "base_name")
    rows = met.select("tx_id", "tx_mu", "idx", F.col("item.title").alias("name"), F.col("item.cents").alias("cents"), "subtotal_cents", "tax_cents")
    return splits.receipt_splits(rows).select("tx_id", "idx", "amount_mu", "memo", "ok", F.lit("receipts").alias("source"))


def _sum(amounts: Column) -> Column:
    """The sum of an array without its nulls; null if there is nothing else."""
    known = F.filter(amounts, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast("long"), lambda a, x: a + x))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """With columns that are worked out once a row, by a generator: others would be put in wherever they are used, in every step over an array and in keys of joins."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _name(item: Column) -> Column:
    return item["name"]


def order_edits(best: DataFrame, orders: DataFrame, name: Callable[[Column], Column] = _name) -> DataFrame:
    """(tx_id, source, splits, ok): the splits of ``order_edit_rows``, an array a match, each match of one order.

    orders: account, order_id and items, an array in order of idx with idx, cents, quantity and what ``name`` makes a name of. Items stay nested,
    so the join is the one exchange, and what it holds are orders, not a row for each item with its texts.
    """
    known = best.where("order_id is not null and tx_id is not null and tx_mu is not null").select("tx_id", "tx_mu", "account", "order_id", "item_idx")
    met = known.join(orders.select("account", "order_id", "items"), ["account", "order_id"])
    met = met.withColumn("items", F.when(F.col("item_idx").isNull(), F.col("items")).otherwise(F.filter("items", lambda x: F.array_contains("item_idx", x["idx"].cast("int"))))).where(F.size("items") > 0)
    met = _once(met, amounts=F.transform("items", lambda x: -cents_to_milliunits(x["cents"])))
    return _edits(met, "orders", lambda x: splits.memo(name(x), x["quantity"]))


def receipt_edits(matches: DataFrame, receipts: DataFrame, name: Callable[[Column], Column] = lambda item: item["title"]) -> DataFrame:
    """(tx_id, source, splits, ok): the splits of ``receipt_edit_rows``, an array a match."""
    single = matches.where(F.col("matched") & (F.size("receipt_ids") == 1) & F.col("transaction_id").isNotNull() & F.col("transaction_mu").isNotNull())
    named = single.select(F.col("transaction_id").alias("tx_id"), F.col("transaction_mu").alias("tx_mu"), F.col("receipt_ids")[0].alias("base_name"))
    met = named.join(receipts.select("base_name", "subtotal_cents", "tax_cents", "items").where(F.size("items") > 0), "base_name")
    met = _once(met, base=F.coalesce("subtotal_cents", _sum(F.transform("items", lambda x: x["cents"]))))
    met = _once(met, tax=F.when(F.col("base") == 0, F.lit(0)).otherwise(F.coalesce("tax_cents", F.lit(0))))
    met = _once(met, shares=F.transform("items", lambda x: proportional(x["cents"], F.col("base"), F.col("tax"))))
    met = _once(met, rest=F.col("tax") - F.coalesce(_sum(F.col("shares")), F.lit(0)))
    mine = lambda i: F.get("shares", i) + F.when(i == F.size("items") - 1, F.col("rest")).otherwise(0)
    met = _once(met, amounts=F.transform("items", lambda x, i: -cents_to_milliunits(x["cents"] + mine(i))))
    return _edits(met, "receipts", name)


def _edits(rows: DataFrame, source: str, memo: Callable[[Column], Column]) -> DataFrame:
    """(tx_id, source, splits, ok) of rows (tx_id, tx_mu, items, amounts)."""
    nested = F.transform("items", lambda x, i: F.struct(F.get("amounts", i).alias("amount"), memo(x).alias("memo")))
    return rows.select("tx_id", F.lit(source).alias("source"), nested.alias("splits"), (_sum(F.col("amounts")) == -F.abs("tx_mu")).alias("ok"))


def edit_batch(rows: DataFrame) -> DataFrame:
    """One edit a transaction and source: (transaction_id, source, splits), splits in item order; those that don't add up are left out."""
    nested = F.transform(F.array_sort(F.collect_list(F.struct("idx", "amount_mu", "memo"))), lambda x: F.struct(x["amount_mu"].alias("amount"), x["memo"].alias("memo")))
    return rows.where("ok").groupBy(F.col("tx_id").alias("transaction_id"), "source").agg(nested.alias("splits"))


def rejected(rows: DataFrame) -> DataFrame:
    """(tx_id, source, n_splits): matches whose items do not add up to the transaction."""
    return rows.where(~F.col("ok")).groupBy("tx_id", "source").agg(F.count("*").alias("n_splits"))


def batch_summary(edits: DataFrame) -> DataFrame:
    """How many edits come from each source, and in all: one row."""
    of = lambda source: F.count_if(F.col("source") == source)
    return edits.agg(of("orders").alias("order_matches_processed"), of("receipts").alias("receipt_matches_processed"), F.count("*").alias("total_edits"))


def retirement_edits(updates: DataFrame, accounts: DataFrame, day: Column) -> DataFrame:
    """updates (account_id, new_cents) to reconciling edits for the accounts (id, name, balance_mu) that they change.

    The balance known so far counts without its sign. Ids that no account has are left out, and so are updates that change nothing.
    """
    found = splits.balance_adjustments(updates, accounts).select("account_id", "name", "adjustment_cents")
    now = updates.select("account_id", "new_cents")
    before = F.col("new_cents") - F.col("adjustment_cents")
    return found.join(now, "account_id").select(
        "account_id", F.col("name").alias("account_name"), F.lit("create_reconciliation").alias("action"), day.alias("date"),
        F.concat(provider(F.col("name")), F.lit(" Balance Adjustment")).alias("payee"), F.lit("Investment Gains/Losses").alias("category"),
        (F.col("adjustment_cents") * 10).alias("amount_mu"), F.concat(F.lit("Balance update: "), with_symbol(before), F.lit(" → "), with_symbol(F.col("new_cents"))).alias("memo"), F.lit("cleared").alias("cleared"), F.lit(True).alias("approved"),
        F.lit("retirement").alias("source"), F.lit(1.0).alias("confidence"), provider(F.col("name")).alias("provider"), account_type(F.col("name")).alias("account_type"),
        before.alias("previous_cents"), "new_cents", "adjustment_cents",
    )
