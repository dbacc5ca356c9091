"""Files of match results read back: nested results of orders and of receipts as rows, and from them the edits' inputs.

A file is one JSON object of a run (metadata, summary, matches). Files of a folder are told apart by their names, which begin with
the run's time, so the latest is the greatest name. Amounts of items, orders and matches are in cents, of transactions in milliunits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates

ITEM = "struct<name:string,amount:bigint,quantity:int,asin:string,unit_price:bigint>"
ORDER = f"struct<order_id:string,items:array<{ITEM}>,total:bigint,order_date:string,ship_dates:array<string>,grouping_level:string>"
MATCH = f"struct<account:string,amazon_orders:array<{ORDER}>,match_method:string,confidence:double,total_match_amount:bigint,unmatched_amount:bigint,matched_item_indices:array<int>,metadata:map<string,string>>"
TRANSACTION = "struct<id:string,date:string,amount:bigint,payee_name:string,memo:string,account_name:string>"
ORDER_FILE = f"struct<matches:array<struct<ynab_transaction:{TRANSACTION},matches:array<{MATCH}>,best_match:{MATCH},message:string>>>"
RECEIPT_MATCH = (
    "struct<transaction_id:string,transaction_date:string,transaction_amount:bigint,receipt_ids:array<string>,matched:boolean,confidence:double,match_method:string,"
    "date_difference:int,amount_difference:bigint,unmatched_amount:bigint,strategy_used:string,notes:string>"
)
RECEIPT_FILE = f"struct<matches:array<{RECEIPT_MATCH}>>"


def _entries(spark: SparkSession, folder: str, pattern: str, schema: str, latest: bool) -> DataFrame:
    """(file, place, m): the matches of the files, in their order; a file that is not such an object has none."""
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", schema)["matches"].alias("matches"))
    if latest:  # names alone are read for this, and only the greatest is kept
        files = files.join(files.select("file").agg(F.max("file").alias("file")), "file", "left_semi")
    return files.select("file", F.posexplode("matches").alias("place", "m"))


def read_order_matches(spark: SparkSession, folder: str, pattern: str = "*_matching_results.json", latest: bool = True) -> DataFrame:
    """(file, place, tx_id, date, tx_mu, payee, memo, account_name, message, best, matches) for each transaction of the result files."""
    t = F.col("m.ynab_transaction")
    return _entries(spark, folder, pattern, ORDER_FILE, latest).select(
        "file", "place", t["id"].alias("tx_id"), dates.iso_date(t["date"]).alias("date"), t["amount"].alias("tx_mu"), t["payee_name"].alias("payee"), t["memo"].alias("memo"),
        t["account_name"].alias("account_name"), F.col("m.message").alias("message"), F.col("m.best_match").alias("best"), F.coalesce("m.matches", F.array().cast(f"array<{MATCH}>")).alias("matches"),
    )


def _match(c: Column) -> list[Column]:
    none, missing = F.array().cast("array<int>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return [
        c["account"].alias("account"), c["match_method"].alias("method"), c["confidence"].alias("confidence"), c["total_match_amount"].alias("matched_cents"),
        F.coalesce(c["unmatched_amount"], F.lit(0)).alias("unmatched_cents"), F.coalesce(c["matched_item_indices"], none).alias("item_idx"), F.coalesce(c["metadata"], missing).alias("metadata"),
    ]


def candidates(results: DataFrame) -> DataFrame:
    """A row for each match that a transaction had, the best one or not: tx_id, rank (its place), is_best, account, method, ..., order_ids."""
    each = results.select("tx_id", "best", F.posexplode("matches").alias("rank", "c"))
    same = F.to_json("c") == F.to_json("best")
    return each.select("tx_id", "rank", F.coalesce(same, F.lit(False)).alias("is_best"), *_match(F.col("c")), F.col("c.amazon_orders.order_id").alias("order_ids"))


def best_items(results: DataFrame) -> DataFrame:
    """(tx_id, tx_mu, idx, name, quantity, cents, order_id, account, method): the items that the best match of a transaction pays.

    The file keeps the items of the match itself, of all its orders in turn, so nothing has to be looked up.
    """
    best = results.where("best is not null and tx_id is not null").select("tx_id", "tx_mu", F.col("best.account").alias("account"), F.col("best.match_method").alias("method"), F.posexplode("best.amazon_orders").alias("of", "o"))
    items = best.select("tx_id", "tx_mu", "account", "method", "of", F.col("o.order_id").alias("order_id"), F.posexplode("o.items").alias("at", "i"))
    idx = (F.col("of") * 1_000_000 + F.col("at")).cast("int")
    return items.select("tx_id", "tx_mu", idx.alias("idx"), F.col("i.name").alias("name"), F.coalesce("i.quantity", F.lit(1)).alias("quantity"), F.col("i.amount").alias("cents"), "order_id", "account", "method")


def read_receipt_matches(spark: SparkSession, folder: str, pattern: str = "*_matching_results.json", latest: bool = True) -> DataFrame:
    """(file, place, transaction_id, date, transaction_mu, receipt_ids, matched, confidence, method, ...) as ``edits.receipt_edit_rows`` takes them."""
    m = _entries(spark, folder, pattern, RECEIPT_FILE, latest).select("file", "place", "m.*")
    return m.select(
        "file", "place", "transaction_id", dates.iso_date(F.col("transaction_date")).alias("date"), F.col("transaction_amount").alias("transaction_mu"), F.coalesce("receipt_ids", F.array().cast("array<string>")).alias("receipt_ids"),
        F.coalesce("matched", F.lit(False)).alias("matched"), "confidence", F.col("match_method").alias("method"), "date_difference", "amount_difference", "unmatched_amount", "strategy_used", "notes",
    )
