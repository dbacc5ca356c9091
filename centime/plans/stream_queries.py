"""Queries of streams, refused rows and stored runs; registered beside the others."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpoint_dir, checkpointed, remove_folder
from ..functions import money
from ..operators import receipt_matching, rejects
from ..sources.runs import RunStore
from ..streaming import consume, incremental
from . import bridge
from .queries import CASCADE, ORDERS, _cents, query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- streams

_DAYS_BACK = 2


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over the events' file: ts (taken as UTC), kind, cents."""
    e = spark.readStream.schema(bridge.table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ts = F.to_timestamp_ltz(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("Z")), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSSX"))
    return e.select(ts.alias("ts"), F.col("event_type").alias("kind"), money.from_double(F.coalesce("value", F.lit(0.0))).alias("cents"))


def _day(ts: Column) -> Column:
    """The UTC day of a timestamp, whatever the session's zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86_400).cast("int"))


def _ran(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """What a stream appends until all its files are taken up."""
    at = _folder(spark, name)
    rows.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    done = checkpointed(spark.read.schema(rows.schema).parquet(f"{at}/rows"))
    remove_folder(spark, at)
    return done


_EVENTS = f"e AS (SELECT CAST(ts AS DATE) AS day, ts, event_type AS kind, {_cents('coalesce(value, 0)')} AS cents FROM events)"
_CLOSED = f"(SELECT max(ts) - INTERVAL {_DAYS_BACK} DAY FROM e)"


@query(f"WITH {_EVENTS} SELECT day, kind, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n FROM e GROUP BY ALL HAVING day + INTERVAL 1 DAY <= {_CLOSED}")
def stream_daily_flow(spark, sf_dir):
    """Daily sums by kind from a stream, as far as the watermark has closed the days."""
    flow = _ran(spark, incremental.daily_flow(_event_stream(spark, sf_dir), f"{_DAYS_BACK} days"), "daily-flow")
    return flow.select(_day(F.col("window.start")).alias("day"), "kind", "cents", "n")


@query(f"""WITH {_EVENTS}, w AS (SELECT CAST(unnest(generate_series(day - INTERVAL 6 DAY, day, INTERVAL 1 DAY)) AS DATE) AS first_day, cents FROM e)
SELECT first_day, CAST(sum(cents) AS BIGINT) AS cents FROM w GROUP BY 1 HAVING first_day + INTERVAL 7 DAY <= {_CLOSED}""")
def stream_rolling_flow(spark, sf_dir):
    """Sums of seven days, a window a day, as far as the watermark has closed them."""
    flow = _ran(spark, incremental.rolling_flow(_event_stream(spark, sf_dir), delay=f"{_DAYS_BACK} days"), "rolling-flow")
    return flow.select(_day(F.col("window.start")).alias("first_day"), "cents")


@query(f"WITH {_EVENTS} SELECT day, kind, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n, day + INTERVAL 1 DAY <= {_CLOSED} AS final FROM e GROUP BY ALL")
def stream_flow_open_days(spark, sf_dir):
    """Daily sums of all rows that came in time, open days too, with late rows kept apart (one file: none is late)."""
    at = _folder(spark, "flow")
    incremental.flow_with_late(_event_stream(spark, sf_dir), f"{at}/rows", f"{at}/state", f"{_DAYS_BACK} days").awaitTermination()
    flow, _ = incremental.flow_tables(spark, f"{at}/rows", f"{_DAYS_BACK} days")
    flow = checkpointed(flow.select(_day(F.col("day")).alias("day"), "kind", "cents", "n", "final"))
    remove_folder(spark, at)
    return flow


@query()
def stream_use_up(spark, sf_dir):
    """The split payments as a stream, each with the order that it is known to pay; what is left of the orders is the stream's state."""
    at, setting = _folder(spark, "use-up"), "spark.sql.streaming.stateStore.providerClass"
    pay = bridge.split_payments(spark, sf_dir)
    pay.select("tx_id", "seq", F.col("date").cast("timestamp").alias("ts"), F.floor(F.col("tx_id") / 10).alias("order_id"), "cents").write.parquet(f"{at}/in")
    before = spark.conf.get(setting)
    spark.conf.set(setting, consume.STORE)
    try:
        stream = spark.readStream.schema("tx_id long, seq long, ts timestamp, order_id long, cents long").parquet(f"{at}/in")
        found = _ran(spark, consume.use_up(stream, bridge.orders(spark, sf_dir)), "use-up")
    finally:
        spark.conf.set(setting, before)
    remove_folder(spark, at)
    return found.select("tx_id", "order_id", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "code", "left_cents")


# ---- refused rows

_FAULTY = f"""{ORDERS}, tr AS (SELECT order_id AS tx_id, CASE WHEN order_id % 11 <> 0 THEN -total_cents * 10 - CASE WHEN order_id % 5 = 0 THEN 10 ELSE 0 END END AS tx_mu FROM orders_g),
sp AS (SELECT order_id AS tx_id, CASE WHEN order_id % 17 = 0 AND idx = 1 THEN NULL ELSE -cents * 10 END AS amount_mu, CASE WHEN order_id % 13 = 0 AND idx = 1 THEN '' ELSE name END AS memo FROM items WHERE order_id % 7 <> 0),
g AS (SELECT tx_id, count(*) AS n_splits, CAST(sum(amount_mu) AS BIGINT) AS total_mu, count(*) FILTER (WHERE amount_mu IS NULL) AS bare, count(*) FILTER (WHERE memo = '') AS mute FROM sp GROUP BY 1),
v AS (SELECT tr.tx_id, tx_mu, coalesce(n_splits, 0) AS n_splits, total_mu, total_mu + abs(tx_mu) AS gap_mu, CASE WHEN tx_mu IS NULL THEN 'no_amount' WHEN n_splits IS NULL THEN 'no_splits' WHEN bare > 0 THEN 'split_without_amount'
 WHEN mute > 0 THEN 'split_without_memo' WHEN total_mu + abs(tx_mu) <> 0 THEN 'sum_differs' END AS code FROM tr LEFT JOIN g USING (tx_id))"""


def _verdicts(spark, sf_dir):
    """Transactions and splits of all orders with faults of each kind."""
    items, k = bridge.order_items(spark, sf_dir), F.col("order_id")
    tr = items.groupBy("order_id").agg(F.sum("cents").alias("c")).select(k.alias("tx_id"), F.when(k % 11 != 0, F.col("c") * -10 - F.when(k % 5 == 0, 10).otherwise(0)).alias("tx_mu"))
    first = F.col("idx") == 1
    amount, memo = F.when(~((k % 17 == 0) & first), F.col("cents") * -10), F.when((k % 13 == 0) & first, "").otherwise(F.col("name"))
    return rejects.split_verdicts(tr, items.where("order_id % 7 <> 0").select(k.alias("tx_id"), amount.alias("amount_mu"), memo.alias("memo")))


@query(f"WITH {_FAULTY} SELECT * FROM v WHERE code IS NOT NULL")
def splits_refused(spark, sf_dir):
    return rejects.refused(_verdicts(spark, sf_dir))


@query(f"WITH {_FAULTY} SELECT tx_id, tx_mu, n_splits, total_mu, gap_mu FROM v WHERE code IS NULL")
def splits_accepted(spark, sf_dir):
    return rejects.accepted(_verdicts(spark, sf_dir))


@query(f"WITH {_FAULTY} SELECT coalesce(code, 'accepted') AS code, count(*) AS n FROM v GROUP BY 1")
def splits_tally(spark, sf_dir):
    """How many transactions each code refuses, counted by the pass that writes both channels."""
    rows, seen = rejects.tallied(_verdicts(spark, sf_dir), list(rejects.SPLIT_CODES))
    rows.write.format("noop").mode("overwrite").save()
    counts = seen.get
    return spark.createDataFrame([(c, counts[c]) for c in ("accepted", *rejects.SPLIT_CODES) if counts[c]], "code string, n long")


_TEXT = f"""CASE c_custkey % 7 WHEN 0 THEN '$' || x WHEN 1 THEN 'x' || x WHEN 2 THEN x || '9' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN '12345678901234567890.5' ELSE '1.2.3' END"""


@query(f"""WITH c AS (SELECT c_custkey, {_cents('c_acctbal')} AS v FROM customer), t AS (SELECT *, CASE WHEN v < 0 THEN '-' ELSE '' END || CAST(abs(v) // 100 AS VARCHAR) || '.' || lpad(CAST(abs(v) % 100 AS VARCHAR), 2, '0') AS x FROM c)
SELECT c_custkey, {_TEXT} AS text, CASE WHEN c_custkey % 7 IN (0, 2) THEN v WHEN c_custkey % 7 = 3 THEN 0 END AS cents, CASE c_custkey % 7 WHEN 1 THEN 'no_number' WHEN 4 THEN 'missing' WHEN 5 THEN 'too_large' WHEN 6 THEN 'no_number' END AS code FROM t""")
def money_refused(spark, sf_dir):
    c = bridge.table(spark, sf_dir, "customer").select("c_custkey", F.regexp_replace(money.plain(money.from_double(F.col("c_acctbal"))), ",", "").alias("x"))
    return rejects.strict_money(c.withColumn("text", F.expr(_TEXT)), "text").select("c_custkey", "text", "cents", "code")


# ---- stored runs


@query(f"""WITH {CASCADE} SELECT run, CAST(number AS BIGINT) AS number, CAST(count(*) AS BIGINT) AS n, CAST(sum(unmatched_cents) AS BIGINT) AS unmatched_cents
FROM res JOIN (VALUES ('2024-01', 2), ('2024-02', 3)) AS r(run, number) ON run = '2024-01' OR matched GROUP BY ALL""")
def stored_runs(spark, sf_dir):
    """Receipt matches written as two runs, the first of them twice and once without a commit: each run counts once."""
    at = _folder(spark, "runs")
    receipt_matching.match_receipts(bridge.receipt_transactions(spark, sf_dir), bridge.receipts(spark, sf_dir)).select("matched", "unmatched_cents").write.parquet(f"{at}/found")
    store, found = RunStore(spark, f"{at}/store"), spark.read.parquet(f"{at}/found")  # matched once, stored four times
    store.write("2024-01", {"matches": found.where("matched")})
    store.write("2024-01", {"matches": found})
    store.write("2024-02", {"matches": found.where("matched")})
    found.write.parquet(f"{at}/store/data/matches/never-committed")
    rows = store.read("matches").groupBy("run").agg(F.count("*").alias("n"), F.sum("unmatched_cents").alias("unmatched_cents"))
    told = checkpointed(rows.join(store.runs().select("run", "number"), "run").select("run", "number", "n", "unmatched_cents"))
    remove_folder(spark, at)
    return told
