"""Readers and writers of ledgers, orders, receipts and mail."""

from __future__ import annotations

import email
import email.policy
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, money
from ..operators.accounts import categories, clean_name, mail_file_name

TRANSACTION = (
    "struct<id:string,date:string,amount:bigint,account_id:string,account_name:string,payee_id:string,payee_name:string,category_id:string,category_name:string,"
    "memo:string,cleared:string,approved:boolean,deleted:boolean,transfer_account_id:string,transfer_transaction_id:string,import_id:string,"
    "subtransactions:array<struct<id:string,transaction_id:string,amount:bigint,memo:string,payee_id:string,payee_name:string,category_id:string,category_name:string,deleted:boolean>>>"
)
ACCOUNT = "struct<id:string,name:string,type:string,on_budget:boolean,closed:boolean,balance:bigint,cleared_balance:bigint,uncleared_balance:bigint,deleted:boolean,note:string>"
CATEGORY = "struct<id:string,category_group_id:string,name:string,hidden:boolean,deleted:boolean,budgeted:bigint,activity:bigint,balance:bigint>"
GROUP = f"struct<id:string,name:string,hidden:boolean,deleted:boolean,categories:array<{CATEGORY}>>"
ITEM_COLUMNS = ("Order ID", "ASIN", "Product Name", "Quantity", "Unit Price", "Total Owed", "Order Date", "Ship Date")
RECEIPT = (
    "format_detected string, apple_id string, receipt_date string, order_id string, document_number string, subtotal long, tax long, total long, currency string, "
    "payment_method string, items array<struct<title:string,cost:bigint,quantity:int,subscription:boolean>>, base_name string"
)


def _entries(spark: SparkSession, path: str, key: str, entry: str) -> DataFrame:
    """The entries of JSON files that are an array or an object with the array under ``key``; any other shape has none."""
    text = F.trim("value")
    both = F.when(text.startswith("["), F.from_json(text, f"array<{entry}>")).otherwise(F.from_json(text, f"struct<{key}:array<{entry}>>")[key])
    return spark.read.text(path, wholetext=True).select(F.explode(both).alias("e")).select("e.*")


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    t = _entries(spark, path, "transactions", TRANSACTION)
    return t.withColumns({
        "date": dates.iso_date(F.col("date")), "cents": money.milliunits_to_cents(F.col("amount")), "account_name": clean_name(F.col("account_name")),
        "cleared": F.coalesce("cleared", F.lit("uncleared")), "approved": F.coalesce("approved", F.lit(True)), "deleted": F.coalesce("deleted", F.lit(False)),
        "is_split": F.coalesce(F.size("subtransactions") > 0, F.lit(False)), "is_transfer": F.col("transfer_account_id").isNotNull(),
    })


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    return _entries(spark, path, "accounts", ACCOUNT).withColumn("name", clean_name(F.col("name")))


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    return categories(_entries(spark, path, "category_groups", GROUP).drop("deleted", "hidden").select("id", "name", F.transform("categories", lambda c: c.dropFields("category_group_id")).alias("categories")))


def with_place(rows: DataFrame, file: str, block: str, name: str) -> DataFrame:
    """``rows`` as they were read, with the place of each in its file, from 0.

    file and block say where a row comes from: the file and the offset of the block that was read at a time. Rows of a block come in
    their order; how many rows earlier blocks of the file have is a sum over counts, one a block. So the place is the same however
    the file was cut, and no task holds more than the rows of a block.
    """
    seen = rows.withColumn("_at", F.monotonically_increasing_id())
    within = F.row_number().over(Window.partitionBy(file, block).orderBy("_at")) - 1
    counts = rows.groupBy(file, block).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(file, block, before.alias("_before"))
    return seen.withColumn("_within", within).join(starts, [file, block]).withColumn(name, F.col("_before") + F.col("_within")).drop("_at", "_within", "_before")


def read_order_items(spark: SparkSession, root: str, accounts: tuple[str, ...] = (), lines: bool = False) -> DataFrame:
    """Items of the newest export of each account under ``root``: ``YYYY-MM-DD_<account>_amazon_data/**/Retail.OrderHistory.*.csv``.

    Rows without a readable order date are left out. idx is the place in the file, from 0, the same in however many parts it is
    read. Names that hold line ends need ``lines`` False: a file is then read by one task.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "Retail.OrderHistory.*.csv").csv(root, header=True, inferSchema=False, multiLine=not lines, escape='"')
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})_([^/]+?)_amazon_data/", 1)
    owner = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})_([^/]+?)_amazon_data/", 2)
    rows = raw.select("*", folder.alias("export"), owner.alias("account"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    if accounts:
        rows = rows.where(F.col("account").isin(*accounts))
    newest = rows.groupBy("account").agg(F.min_by("file", F.struct(-F.datediff(F.col("export").cast("date"), F.lit("1970-01-01").cast("date")), "file")).alias("file"))
    rows = with_place(rows, "file", "block", "idx").join(newest, ["account", "file"], "left_semi")
    return rows.select(
        "account", F.col("Order ID").alias("order_id"), "idx", F.col("ASIN").alias("asin"), F.col("Product Name").alias("name"),
        F.coalesce(F.col("Quantity").try_cast("int"), F.lit(1)).alias("quantity"), money.lenient_cents(F.coalesce("Unit Price", F.lit(""))).alias("unit_cents"),
        money.lenient_cents(F.coalesce("Total Owed", F.lit(""))).alias("cents"), dates.iso_date(F.col("Order Date")).alias("order_date"), dates.ship_date(F.col("Ship Date")).alias("ship_date"),
    ).where("order_date is not null")


def read_receipts(spark: SparkSession, folder: str) -> DataFrame:
    return _receipts(spark.read.schema(RECEIPT).json(folder, multiLine=True, pathGlobFilter="*.json"))


def _receipts(r: DataFrame) -> DataFrame:
    return r.withColumns({"receipt_date": dates.receipt_date(F.col("receipt_date")), "total_cents": F.col("total"), "item_count": F.size("items"), "currency": F.coalesce("currency", F.lit("USD"))})


def read_receipt_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(base_name, html) of the HTML files of a folder."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.html?$", 1)
    return spark.read.option("pathGlobFilter", "*.html").text(folder, wholetext=True).select(name.alias("base_name"), F.col("value").alias("html"))


def read_mail(spark: SparkSession, folder: str) -> DataFrame:
    """(file, message_id, sender, subject, sent, html, text) of ``.eml`` files, MIME and header encodings undone."""
    schema = "file string, message_id string, sender string, subject string, sent string, html string, text string"

    def run(batches):
        for b in batches:
            rows = [_mail(p, c) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(x.split()[0], pa.string()) for x in schema.split(", ")]))

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(folder).select("path", "content").mapInArrow(run, schema)


def _mail(path: str, content: bytes) -> dict:
    m = email.message_from_bytes(content, policy=email.policy.default)
    body = lambda kind: p.get_content() if (p := m.get_body((kind,))) else None
    return {"file": path, "message_id": m["message-id"], "sender": m["from"], "subject": m["subject"], "sent": m["date"], "html": body("html"), "text": body("plain")}


def write_results(results: DataFrame, folder: str, run: str) -> None:
    """Results of one run as JSON lines under ``run_ts=<run>``, so that runs add up and the latest can be read alone."""
    results.withColumn("run_ts", F.lit(run)).write.mode("append").partitionBy("run_ts").json(folder)


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    every = spark.read.json(folder)
    return every.join(F.broadcast(every.agg(F.max("run_ts").alias("run_ts"))), "run_ts", "left_semi")


def write_match_file(results: DataFrame, folder: str, run: str, accounts: tuple[str, ...] = ()) -> None:
    """A run's matches as JSON lines, and beside them one line with its metadata and summary.

    results: transaction fields (tx_id, date, tx_mu, payee, memo, account_name), matches (an array of structs), best_match (a
    struct with a confidence) and message. Lines keep the nesting that later steps read back; nothing is gathered on the driver.
    """
    transaction = F.struct(F.col("tx_id").alias("id"), "date", F.col("tx_mu").alias("amount"), F.col("payee").alias("payee_name"), "memo", "account_name")
    write_results(results.select(transaction.alias("transaction"), "matches", "best_match", "message"), f"{folder}/matches", run)
    matched = F.col("best_match").isNotNull()
    summary = results.agg(
        F.count("*").alias("total_transactions"), F.count_if(matched).alias("matched_transactions"), F.coalesce(F.try_divide(F.count_if(matched), F.count("*")), F.lit(0.0)).alias("match_rate"),
        F.coalesce(F.round(F.avg(F.when(matched, F.col("best_match.confidence"))), 3), F.lit(0.0)).alias("average_confidence"),
    )
    meta = F.struct(F.lit(run).alias("timestamp"), F.array(*map(F.lit, accounts)).cast("array<string>").alias("accounts"))
    write_results(summary.select(meta.alias("metadata"), F.struct("*").alias("summary")), f"{folder}/summary", run)


def write_receipts(receipts: DataFrame, folder: str) -> None:
    """Receipts as JSON, a folder for each page's name; a page parsed again takes the place of what was there."""
    receipts.withColumn("name", F.col("base_name")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").json(folder)


def read_edits(spark: SparkSession, folder: str, latest_only: bool = False) -> DataFrame:
    """Edits that ``write_results`` wrote, of all runs or of the latest."""
    return read_latest(spark, folder) if latest_only else spark.read.json(folder)


def newest_folder(names: DataFrame) -> DataFrame:
    """The latest of the export folders in ``names`` (folder): names begin with their date, so the greatest is the newest."""
    return names.where(F.col("folder").rlike(r"^\d{4}-\d{2}-\d{2}_")).agg(F.max("folder").alias("folder"))


def read_newest_receipts(spark: SparkSession, root: str) -> DataFrame:
    """Receipts of the newest export under ``root`` (``YYYY-MM-DD_.../*.json``)."""
    r = spark.read.schema(RECEIPT).option("recursiveFileLookup", True).json(root, multiLine=True, pathGlobFilter="*.json")
    r = r.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{4}-\d{2}-\d{2}_[^/]+)/[^/]+$", 1))
    return _receipts(r.join(F.broadcast(newest_folder(r.select("folder").distinct())), "folder", "left_semi").drop("folder"))


def write_mail(mail: DataFrame, folder: str) -> None:
    """Messages (sent_on, subject, message_id, html, text) as text files, in a folder for each name that ``accounts.mail_file_name`` makes and each kind."""
    name = mail_file_name(F.col("sent_on"), F.coalesce("subject", F.lit("")), F.coalesce("message_id", F.lit("")))
    kinds = F.array(F.struct(F.lit("html").alias("kind"), F.col("html").alias("value")), F.struct(F.lit("text").alias("kind"), F.col("text").alias("value")))
    rows = mail.select(name.alias("name"), F.inline(kinds)).where("value is not null")
    rows.write.mode("append").partitionBy("name", "kind").text(folder)


def file_summary(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """One row: how many files match, their bytes, the latest modification time and its age in days."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("length", "modificationTime")
    return f.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.max("modificationTime").alias("latest"), F.datediff(F.current_timestamp(), F.max("modificationTime")).alias("age_days"))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file to explore with select, where, orderBy, groupBy and limit."""
    return spark.read.csv(path, header=True, inferSchema=False)


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("rank = 1").drop("rank")


def is_export_folder(name: str) -> str | None:
    m = re.fullmatch(r"\d{4}-\d{2}-\d{2}_(.+?)_amazon_data", name)
    return m[1] if m else None
