"""The engine's queries over ledgers derived from the star-schema tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpoint_dir, stored
from ..functions import dates, money
from ..operators import accounts, cashflow, order_matching, orders, receipt_html, receipt_matching, scoring, splits
from ..streaming.incremental import take_up
from . import bridge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _cents(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(18,2)) * 100 AS BIGINT)"


ITEMS = f"""items AS (SELECT l_orderkey AS order_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS idx,
 {_cents("l_extendedprice")} AS cents, CAST(l_shipdate AS DATE) AS ship_date, CAST(l_orderkey % 2 AS INTEGER) AS account, CAST(l_quantity AS INTEGER) AS quantity,
 'part ' || CAST(l_partkey AS VARCHAR) AS name FROM lineitem)"""
ORDERS = f"""{ITEMS}, orders_g AS (SELECT account, order_id, CAST(sum(cents) AS BIGINT) AS total_cents, count(*) AS n_items, min(ship_date) AS first_ship,
 count(DISTINCT ship_date) AS n_dates, min_by(ship_date, idx) AS order_date FROM items GROUP BY ALL)"""
TX = f"""{ORDERS}, tx AS (SELECT order_id AS tx_id, first_ship + CAST(order_id % 10 AS INTEGER) AS date, -total_cents AS cents FROM orders_g)"""
MATCH = f"""{TX}, met AS (SELECT t.tx_id, o.account, o.order_id, CAST(min(abs(date_diff('day', i.ship_date, t.date))) AS INTEGER) AS gap, any_value(o.n_dates) AS n_dates
 FROM tx t JOIN orders_g o ON o.total_cents = abs(t.cents) JOIN items i ON i.order_id = o.order_id GROUP BY ALL),
 m AS (SELECT tx_id, account, order_id, gap, CAST(CASE WHEN n_dates > 1 THEN CASE WHEN gap <= 2 THEN 100 WHEN gap <= 3 THEN 95 WHEN gap <= 5 THEN 89 ELSE 84 END
 ELSE CASE WHEN gap = 0 THEN 100 WHEN gap = 1 THEN 98 WHEN gap = 2 THEN 95 WHEN gap = 3 THEN 90 WHEN gap <= 5 THEN 85 ELSE 80 END END AS INTEGER) AS score, 'complete' AS method FROM met WHERE gap <= 7)"""
BEST = f"""{MATCH}, best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY tx_id ORDER BY score DESC, account, order_id) = 1),
 res AS (SELECT t.tx_id, abs(t.cents) AS amount_cents, b.order_id IS NOT NULL AS matched, b.account, b.order_id, b.method, b.score,
 CASE WHEN b.order_id IS NULL THEN abs(t.cents) ELSE 0 END AS unmatched_cents, CAST(NULL AS VARCHAR) AS message FROM tx t LEFT JOIN best b USING (tx_id))"""
RECEIPTS = f"""r AS (SELECT o_orderkey AS base_name, CAST(o_orderdate AS DATE) AS receipt_date, {_cents("o_totalprice")} AS total_cents FROM orders),
 t AS (SELECT base_name AS tx_id, receipt_date + CAST(base_name % 5 AS INTEGER) AS date, -total_cents AS cents FROM r)"""
CASCADE = f"""{RECEIPTS}, met AS (SELECT tx_id, base_name, CAST(abs(date_diff('day', receipt_date, date)) AS INTEGER) AS gap FROM t JOIN r ON total_cents = abs(cents)),
 f AS (SELECT * FROM met WHERE gap <= 3 QUALIFY row_number() OVER (PARTITION BY tx_id ORDER BY gap, base_name) = 1),
 res AS (SELECT t.tx_id, abs(t.cents) AS amount_cents, f.base_name IS NOT NULL AS matched, f.base_name, f.gap,
 CASE WHEN f.gap = 0 THEN 'exact_match' WHEN f.gap IS NOT NULL THEN 'date_window_match' ELSE 'no_match' END AS method,
 CAST(CASE f.gap WHEN 0 THEN 100 WHEN 1 THEN 95 WHEN 2 THEN 85 WHEN 3 THEN 75 ELSE 0 END AS INTEGER) AS score, CASE WHEN f.base_name IS NULL THEN abs(t.cents) ELSE 0 END AS unmatched_cents FROM t LEFT JOIN f USING (tx_id))"""
_SUMMARY = """CAST(count(*) AS BIGINT) AS total_transactions, CAST(count(*) FILTER (WHERE matched) AS BIGINT) AS matched_transactions,
 round(count(*) FILTER (WHERE matched) / count(*), 6) AS match_rate, round(avg(score) FILTER (WHERE matched) / 100, 3) AS average_confidence,
 CAST(coalesce(sum(amount_cents) FILTER (WHERE matched), 0) AS BIGINT) AS matched_cents, CAST(sum(unmatched_cents) AS BIGINT) AS unmatched_cents"""
BAL = f"bal AS (SELECT c_custkey % 5 AS account, CAST(sum({_cents('c_acctbal')}) AS BIGINT) AS now FROM customer GROUP BY 1)"
EVENT_TX = f"tx AS (SELECT user_id % 5 AS account, CAST(ts AS DATE) AS date, CASE WHEN event_type IN ('purchase', 'error') THEN -{_cents('coalesce(value, 0)')} ELSE {_cents('coalesce(value, 0)')} END AS cents FROM events)"
ORDER_TX = f"tx AS (SELECT o_custkey % 5 AS account, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 2 = 0 THEN {_cents('o_totalprice')} ELSE -{_cents('o_totalprice')} END AS cents FROM orders)"


_BALANCES = """net AS (SELECT account, date, sum(cents) AS net FROM tx GROUP BY ALL), grid AS (SELECT account, now, date FROM bal, (SELECT DISTINCT date FROM tx)),
 opened AS (SELECT account, date, now - sum(coalesce(net, 0)) OVER (PARTITION BY account ORDER BY date DESC) AS balance FROM grid LEFT JOIN net USING (account, date)),
 days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM tx),
 acc AS (SELECT b.account, d.date, CAST(last_value(o.balance IGNORE NULLS) OVER (PARTITION BY b.account ORDER BY d.date) AS BIGINT) AS balance
 FROM days d CROSS JOIN bal b LEFT JOIN opened o ON o.account = b.account AND o.date = d.date),
 total AS (SELECT date, CAST(sum(balance) AS BIGINT) AS total FROM acc GROUP BY 1)"""


def _daily(tx: str) -> str:
    return f"{tx}, {BAL}, {_BALANCES}"


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = cashflow.account_balances(bridge.order_ledger(spark, sf_dir), bridge.balances(spark, sf_dir))
    return cashflow.daily_totals(days)


# ---- money and projections


@query(f"SELECT o_orderkey, {_cents('o_totalprice')} AS cents, {_cents('o_totalprice')} * 10 AS milliunits, CASE WHEN {_cents('o_totalprice')} < 0 THEN 'expense' ELSE 'income' END AS kind FROM orders")
def ledger_normalise(spark, sf_dir):
    c = money.from_double(F.col("o_totalprice"))
    return bridge.table(spark, sf_dir, "orders").select("o_orderkey", c.alias("cents"), money.cents_to_milliunits(c).alias("milliunits"), F.when(c < 0, "expense").otherwise("income").alias("kind"))


@query(f"""WITH c AS (SELECT c_custkey, {_cents('c_acctbal')} AS v FROM customer), s AS (SELECT c_custkey, v, format('{{:,}}', abs(v) // 100) || '.' || lpad(CAST(abs(v) % 100 AS VARCHAR), 2, '0') AS a FROM c)
SELECT c_custkey, CASE WHEN v < 0 THEN '-' ELSE '' END || a AS plain, '$' || CASE WHEN v < 0 THEN '-' ELSE '' END || a AS with_symbol, CASE WHEN v < 0 THEN '-' ELSE '' END || '$' || a AS signed_symbol FROM s""")
def money_format(spark, sf_dir):
    v = money.from_double(F.col("c_acctbal"))
    return bridge.table(spark, sf_dir, "customer").select("c_custkey", money.plain(v).alias("plain"), money.with_symbol(v).alias("with_symbol"), money.signed_symbol(v).alias("signed_symbol"))


@query(f"""WITH c AS (SELECT c_custkey AS k, {_cents('c_acctbal')} AS v FROM customer), t AS (SELECT k, v, CASE WHEN v < 0 THEN '-' ELSE '' END || CAST(abs(v) // 100 AS VARCHAR) || '.' || lpad(CAST(abs(v) % 100 AS VARCHAR), 2, '0') AS x FROM c)
SELECT k AS c_custkey, CASE k % 6 WHEN 0 THEN '$' || x WHEN 1 THEN 'x' || x WHEN 2 THEN x || '9' WHEN 3 THEN '' WHEN 4 THEN 'FREE' ELSE ' ' || x || ' ' END AS text,
CASE WHEN k % 6 IN (0, 2, 5) THEN v ELSE 0 END AS lenient, CASE WHEN k % 6 IN (0, 2, 5) THEN v WHEN k % 6 = 3 THEN 0 END AS strict, k % 6 IN (0, 2, 5) AS valid FROM t""")
def money_parse(spark, sf_dir):
    v, k = money.from_double(F.col("c_acctbal")), F.col("c_custkey") % 6
    x = F.regexp_replace(money.plain(v), ",", "")
    text = F.when(k == 0, F.concat(F.lit("$"), x)).when(k == 1, F.concat(F.lit("x"), x)).when(k == 2, F.concat(x, F.lit("9"))).when(k == 3, "").when(k == 4, "FREE").otherwise(F.concat(F.lit(" "), x, F.lit(" ")))
    t = bridge.table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))
    return t.select("c_custkey", "text", money.lenient_cents(F.col("text")).alias("lenient"), money.strict_cents(F.col("text")).alias("strict"), money.is_valid_currency(F.col("text")).alias("valid"))


@query(f"SELECT c_custkey, CAST(floor(({_cents('c_acctbal')} * 10 - 5) / 10.0) AS BIGINT) AS cents FROM customer")
def milliunit_floor(spark, sf_dir):
    return bridge.table(spark, sf_dir, "customer").select("c_custkey", money.milliunits_to_cents(money.from_double(F.col("c_acctbal")) * 10 - 5).alias("cents"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE contains(lower(c_mktsegment), 'build')")
def payee_filter(spark, sf_dir):
    return bridge.table(spark, sf_dir, "customer").where(accounts.payee_contains(F.col("c_mktsegment"), "Build")).select("c_custkey", "c_mktsegment")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE regexp_matches(CASE event_type WHEN 'purchase' THEN 'AMZN Mktp' WHEN 'view' THEN 'Amazon.com' ELSE event_type END, '(?i)amazon|amzn')) AS hits FROM events GROUP BY 1")
def payee_regex(spark, sf_dir):
    payee = F.when(F.col("event_type") == "purchase", "AMZN Mktp").when(F.col("event_type") == "view", "Amazon.com").otherwise(F.col("event_type"))
    return bridge.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(order_matching.is_order_payee(payee)).alias("hits"))


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING')")
def active_accounts_semi(spark, sf_dir):
    active = bridge.table(spark, sf_dir, "customer").where("c_acctbal > 0 and c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return bridge.table(spark, sf_dir, "orders").join(active, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey AS base_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def unprocessed_anti(spark, sf_dir):
    pages = bridge.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("base_name"))
    return accounts.unprocessed(pages, bridge.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("base_name")))


_NAME = "CASE s_suppkey % 6 WHEN 0 THEN 'Ann''s Vault: 401k plan' WHEN 1 THEN 'Vault: 403b' WHEN 2 THEN 'Vault: Roth IRA' WHEN 3 THEN 'Bo''s Bank: IRA' WHEN 4 THEN 'TSP fund' ELSE 'Broker: index' END"


@query(f"""SELECT s_suppkey, CASE WHEN contains(n, ':') THEN CASE WHEN contains(n, '''s ') THEN split_part(split_part(n, ':', 1), '''s ', 2) ELSE split_part(n, ':', 1) END ELSE 'Unknown' END AS provider,
CASE WHEN contains(lower(n), '401k') THEN '401(k)' WHEN contains(lower(n), '403b') THEN '403(b)' WHEN contains(lower(n), 'roth') THEN 'Roth IRA' WHEN contains(lower(n), 'ira') THEN 'IRA' WHEN contains(lower(n), 'tsp') THEN 'TSP' ELSE 'Investment' END AS account_type
FROM (SELECT s_suppkey, {_NAME} AS n FROM supplier)""")
def account_type_case(spark, sf_dir):
    named = bridge.table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_NAME.replace("''", "\\'")).alias("n"))
    return named.select("s_suppkey", accounts.provider(F.col("n")).alias("provider"), accounts.account_type(F.col("n")).alias("account_type"))


@query("SELECT r_regionkey AS group_id, n_nationkey AS id, r_name || ': ' || n_name AS full_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def category_explode(spark, sf_dir):
    n, r = bridge.table(spark, sf_dir, "nation"), bridge.table(spark, sf_dir, "region")
    groups = n.groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").alias("cid"), F.col("n_name").alias("name"))).alias("categories"))
    joined = groups.join(r, groups.n_regionkey == r.r_regionkey).select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), "categories")
    return accounts.categories(joined).select("group_id", F.col("cid").alias("id"), "full_name")


@query("SELECT event_type AS status, count(*) AS n, count(DISTINCT json_extract_string(props, '$.k')) AS kinds, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(json_extract_string(props, '$.none')) AS none FROM events GROUP BY 1")
def json_extract(spark, sf_dir):
    e = bridge.table(spark, sf_dir, "events").select("event_type", F.from_json("props", "struct<k:bigint,none:string>").alias("p"))
    return e.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.count_distinct("p.k").alias("kinds"), F.sum("p.k").alias("total"), F.count("p.none").alias("none"))


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'unapproved' END AS status, count(*) AS n FROM orders GROUP BY 1")
def approval_counts(spark, sf_dir):
    return bridge.table(spark, sf_dir, "orders").groupBy(F.when(F.col("o_orderstatus") == "F", "approved").otherwise("unapproved").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS named, last_day(CAST(o_orderdate AS DATE)) AS month_end FROM orders")
def date_parse(spark, sf_dir):
    d = F.col("o_orderdate")
    return bridge.table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.iso_date(F.date_format(d, "yyyy-MM-dd'T'HH:mm")).alias("iso"), dates.receipt_date(F.date_format(d, "MMMM d, yyyy")).alias("named"), F.last_day(d.cast("date")).alias("month_end")
    )


# ---- orders and matching


@query(f"""WITH {ORDERS} SELECT account, order_id, total_cents, n_items, order_date, string_agg(DISTINCT CAST(ship_date AS VARCHAR), ',' ORDER BY CAST(ship_date AS VARCHAR)) AS ship_dates
FROM orders_g JOIN items USING (account, order_id) GROUP BY ALL""")
def order_group(spark, sf_dir):
    return bridge.orders(spark, sf_dir).select("account", "order_id", "total_cents", "n_items", "order_date", F.array_join(F.col("ship_dates").cast("array<string>"), ",").alias("ship_dates"))


@query(f"WITH {ITEMS} SELECT account, order_id, ship_date, CAST(sum(cents) AS BIGINT) AS total_cents, count(*) AS n_items FROM items GROUP BY ALL")
def order_group_shipment(spark, sf_dir):
    return orders.group_shipments(bridge.order_items(spark, sf_dir))


@query(f"WITH {MATCH} SELECT * FROM m")
def complete_match(spark, sf_dir):
    return order_matching.complete_matches(bridge.transactions(spark, sf_dir), bridge.orders(spark, sf_dir))


def _results(spark, sf_dir):
    tx = bridge.transactions(spark, sf_dir)
    return order_matching.match_result(tx, order_matching.best_complete(tx, bridge.orders(spark, sf_dir)))


@query(f"WITH {BEST} SELECT * FROM res")
def complete_match_best(spark, sf_dir):
    return _results(spark, sf_dir)


@query(f"WITH {BEST} SELECT {_SUMMARY}, count(DISTINCT order_id) AS distinct_orders FROM res")
def match_summary(spark, sf_dir):
    return order_matching.summary(_results(spark, sf_dir))


@query(f"WITH {BEST} SELECT CASE WHEN score >= 90 THEN 'high' WHEN score >= 75 THEN 'medium' ELSE 'none' END AS level, count(*) AS n FROM res GROUP BY 1")
def confidence_level(spark, sf_dir):
    return _results(spark, sf_dir).groupBy(scoring.level(F.coalesce(F.col("score"), F.lit(0)) / 100).alias("level")).agg(F.count("*").alias("n"))


def _receipt_results(spark, sf_dir, days=3):
    return receipt_matching.match_receipts(bridge.receipt_transactions(spark, sf_dir), bridge.receipts(spark, sf_dir), days)


@query(f"WITH {CASCADE} SELECT * FROM res")
def receipt_cascade(spark, sf_dir):
    return _receipt_results(spark, sf_dir)


@query(f"WITH {CASCADE} SELECT tx_id, base_name FROM res WHERE gap = 0")
def receipt_exact(spark, sf_dir):
    return _receipt_results(spark, sf_dir, 0).where("gap = 0").select("tx_id", "base_name")


@query(f"WITH {CASCADE} SELECT tx_id, base_name, gap, score FROM res WHERE matched")
def receipt_window(spark, sf_dir):
    return _receipt_results(spark, sf_dir).where("matched").select("tx_id", "base_name", "gap", "score")


@query(f"WITH {CASCADE} SELECT method, count(*) AS n, {_SUMMARY} FROM res GROUP BY 1")
def method_breakdown(spark, sf_dir):
    r = _receipt_results(spark, sf_dir)
    return r.groupBy("method").agg(
        F.count("*").alias("n"), F.count("*").alias("total_transactions"), F.count_if("matched").alias("matched_transactions"), F.round(F.count_if("matched") / F.count("*"), 6).alias("match_rate"),
        F.round(F.avg(F.when(F.col("matched"), F.col("score"))) / 100, 3).alias("average_confidence"),
        F.coalesce(F.sum(F.when(F.col("matched"), F.col("amount_cents"))), F.lit(0)).alias("matched_cents"), F.sum("unmatched_cents").alias("unmatched_cents"),
    )


@query(f"WITH {CASCADE} SELECT {_SUMMARY} FROM res")
def receipt_summary(spark, sf_dir):
    return receipt_matching.summary(_receipt_results(spark, sf_dir))


@query(f"""WITH {RECEIPTS}, x AS (SELECT tx_id, base_name, abs(total_cents - abs(cents)) AS off FROM t JOIN r ON receipt_date = date WHERE total_cents <> abs(cents))
SELECT tx_id, base_name, off, CAST(row_number() OVER (PARTITION BY tx_id ORDER BY off, base_name) AS INTEGER) AS rank FROM x QUALIFY rank <= 5""")
def near_misses(spark, sf_dir):
    return receipt_matching.near_misses(bridge.receipt_transactions(spark, sf_dir), bridge.receipts(spark, sf_dir)).select("tx_id", "base_name", "off", "rank")


#: Payments of SQL: what bridge.split_payments makes.
PAYMENTS = f"""{ORDERS}, sums AS (SELECT order_id, sum(cents) FILTER (WHERE idx = 1) AS one, sum(cents) FILTER (WHERE idx <= 2) AS two, sum(cents) FILTER (WHERE idx >= 3) AS rest, sum(cents) + 1 AS over,
 min(ship_date) + 1 AS date FROM items GROUP BY 1),
 pay AS (SELECT order_id * 10 + i AS tx_id, date, CAST(c AS BIGINT) AS amount FROM (SELECT order_id, date, unnest([1, 2, 3, 4]) AS i, unnest([one, two, rest, over]) AS c FROM sums) WHERE c IS NOT NULL)"""
_SPLIT_SCORE = """CAST(CASE WHEN gap = 0 THEN 95 WHEN gap <= 2 THEN 90 WHEN gap <= 5 THEN 81 ELSE 71 END AS INTEGER) AS score"""


def _grouped(spark, sf_dir):
    """The orders, kept: payments are made of them too, so line items go through one exchange."""
    return stored(bridge.orders(spark, sf_dir).select("account", "order_id", "total_cents", "items", "ship_dates"))


def _found_splits(spark, sf_dir):
    grouped = _grouped(spark, sf_dir)
    return order_matching.find_splits(bridge.split_payments(spark, sf_dir, grouped), grouped)


@query(f"""WITH {PAYMENTS}, hit AS (SELECT p.tx_id, i.account, i.order_id, min(i.idx) AS idx, any_value(p.date) AS date FROM pay p JOIN items i ON i.cents = p.amount GROUP BY ALL),
gaps AS (SELECT h.*, (SELECT min(abs(date_diff('day', s.ship_date, h.date))) FROM items s WHERE s.order_id = h.order_id) AS gap FROM hit h)
SELECT tx_id, account, order_id, CAST(idx AS INTEGER) AS item, {_SPLIT_SCORE} FROM gaps""")
def split_single(spark, sf_dir):
    found = _found_splits(spark, sf_dir).where("size(items) = 1")
    return found.select("tx_id", "account", "order_id", F.col("items")[0].alias("item"), "score")


@query(f"""WITH RECURSIVE {PAYMENTS}, ranked AS (SELECT account, order_id, idx, cents, row_number() OVER (PARTITION BY order_id ORDER BY cents DESC, idx) AS k FROM items),
sub AS (SELECT account, order_id, [k] AS ks, [idx] AS ids, cents AS total, k AS last FROM ranked
 UNION ALL SELECT s.account, s.order_id, list_append(s.ks, r.k), list_append(s.ids, r.idx), s.total + r.cents, r.k FROM sub s JOIN ranked r ON r.order_id = s.order_id AND r.k > s.last),
hit AS (SELECT p.tx_id, s.account, s.order_id, arg_min(s.ids, s.ks) AS ids, any_value(p.date) AS date FROM pay p JOIN sub s ON s.total = p.amount GROUP BY ALL HAVING min(len(s.ids)) > 1),
gaps AS (SELECT h.*, (SELECT min(abs(date_diff('day', s.ship_date, h.date))) FROM items s WHERE s.order_id = h.order_id) AS gap FROM hit h)
SELECT tx_id, account, order_id, array_to_string(ids, ',') AS items, {_SPLIT_SCORE} FROM gaps""")
def split_subset(spark, sf_dir):
    found = _found_splits(spark, sf_dir).where("size(items) > 1")
    return found.select("tx_id", "account", "order_id", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "score")


@query()
def split_consume(spark, sf_dir):
    grouped = _grouped(spark, sf_dir)
    return order_matching.match_splits(bridge.split_payments(spark, sf_dir, grouped), grouped)


@query()
def order_match_best(spark, sf_dir):
    """Complete orders and splits together, in order of the payments, with the payee gate and its message."""
    grouped = _grouped(spark, sf_dir)
    pay = bridge.mixed_payments(spark, sf_dir, grouped)
    return order_matching.match_result(pay, order_matching.match_orders(pay, grouped))


# ---- splits


def _split_items(spark, sf_dir):
    return bridge.priced_items(spark, sf_dir)


SPLITS = f"""{ORDERS}, s AS (SELECT i.order_id AS tx_id, -o.total_cents * 10 - CASE WHEN i.order_id % 5 = 0 THEN 10 ELSE 0 END AS tx_mu, i.idx, -i.cents * 10 AS amount_mu, CASE WHEN quantity > 1 THEN name || ' (qty: ' || CAST(quantity AS VARCHAR) || ')' ELSE name END AS memo
 FROM items i JOIN orders_g o USING (order_id))"""


@query(f"WITH {SPLITS} SELECT tx_id, tx_mu, CAST(idx AS INTEGER) AS idx, amount_mu, memo, sum(amount_mu) OVER (PARTITION BY tx_id) = -abs(tx_mu) AS ok FROM s")
def order_splits(spark, sf_dir):
    return splits.order_splits(_split_items(spark, sf_dir))


@query(f"""WITH {ORDERS}, b AS (SELECT i.order_id AS tx_id, i.idx, i.name AS memo, i.cents, o.total_cents AS base, o.total_cents * 8 // 100 AS tax, o.n_items FROM items i JOIN orders_g o USING (order_id)),
h AS (SELECT *, CAST((CAST(cents AS HUGEINT) * tax) // base AS BIGINT) AS share FROM b)
SELECT tx_id, -(base + tax) * 10 - CASE WHEN tx_id % 4 = 0 THEN 10 ELSE 0 END AS tx_mu, CAST(idx AS INTEGER) AS idx, memo, cents, CAST(CASE WHEN idx = n_items THEN tax - sum(share) OVER (PARTITION BY tx_id) + share ELSE share END AS BIGINT) AS tax_cents,
CAST(-(cents + CASE WHEN idx = n_items THEN tax - sum(share) OVER (PARTITION BY tx_id) + share ELSE share END) * 10 AS BIGINT) AS amount_mu, tx_id % 4 <> 0 AS ok FROM h""")
def receipt_tax_splits(spark, sf_dir):
    it = bridge.order_items(spark, sf_dir)
    sums = it.groupBy("order_id").agg(F.sum("cents").alias("subtotal_cents")).withColumn("tax_cents", F.expr("subtotal_cents * 8 div 100"))
    joined = it.join(sums, "order_id").withColumn("tx_mu", -(F.col("subtotal_cents") + F.col("tax_cents")) * 10 - F.when(F.col("order_id") % 4 == 0, 10).otherwise(0)).withColumnRenamed("order_id", "tx_id")
    return splits.receipt_splits(joined)


@query(f"WITH {SPLITS} SELECT tx_id, count(*) AS n_splits, CAST(sum(amount_mu) + abs(any_value(tx_mu)) AS BIGINT) AS gap, sum(amount_mu) + abs(any_value(tx_mu)) = 0 AS valid FROM s GROUP BY 1")
def split_validate(spark, sf_dir):
    return splits.validate(splits.order_splits(_split_items(spark, sf_dir)))


@query(f"WITH {SPLITS} SELECT tx_id, CAST(idx AS INTEGER) AS idx, amount_mu, memo, CAST(row_number() OVER (PARTITION BY tx_id ORDER BY abs(amount_mu) DESC, memo, idx) AS INTEGER) AS place FROM s")
def split_sorted(spark, sf_dir):
    return splits.sorted_splits(splits.order_splits(_split_items(spark, sf_dir))).select("tx_id", "idx", "amount_mu", "memo", "place")


@query(f"""WITH {SPLITS} SELECT tx_id, count(*) AS n_splits, CAST(sum(amount_mu) AS BIGINT) AS total_mu, CAST(floor(CAST(sum(amount_mu) AS DOUBLE) / count(*)) AS BIGINT) AS average_mu, max(abs(amount_mu)) AS largest_mu, min(abs(amount_mu)) AS smallest_mu,
string_agg(substr(memo, 1, 50), '|' ORDER BY idx) FILTER (WHERE idx <= 3) AS memos FROM s GROUP BY 1""")
def split_summary(spark, sf_dir):
    return splits.summary(splits.order_splits(_split_items(spark, sf_dir)))


@query(f"""WITH {ORDERS}, b AS (SELECT order_id, list(cents // 7 ORDER BY idx) AS a, CAST(sum(cents) // 7 AS BIGINT) AS t FROM items GROUP BY 1), c AS (SELECT *, t - list_sum(a) AS gap, list_position(a, list_max(a)) AS spot FROM b)
SELECT order_id, array_to_string(CASE WHEN t = 0 THEN a ELSE list_transform(a, lambda x, i: CASE WHEN i = spot THEN CAST(x + gap AS BIGINT) ELSE x END) END, ',') AS amounts FROM c""")
def normalize_precision(spark, sf_dir):
    it = bridge.order_items(spark, sf_dir).groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.expr("cents div 7").alias("c")))).alias("s"), F.sum("cents").alias("t"))
    amounts = money.normalised(F.transform("s", lambda x: x["c"]), F.expr("t div 7"))
    return it.select("order_id", F.array_join(amounts.cast("array<string>"), ",").alias("amounts"))


@query(f"""WITH u AS (SELECT s_suppkey AS account_id, s_name AS name, {_cents('s_acctbal')} AS c FROM supplier)
SELECT account_id, name, (c + account_id % 3) - abs(c) AS adjustment_cents, 'Balance adjustment' AS memo FROM u WHERE (c + account_id % 3) - abs(c) <> 0""")
def balance_adjustment(spark, sf_dir):
    s = bridge.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), money.from_double(F.col("s_acctbal")).alias("c"))
    updates = s.select(F.col("id").alias("account_id"), (F.col("c") + F.col("id") % 3).alias("new_cents"))
    return splits.balance_adjustments(updates, s.select("id", "name", (F.col("c") * 10).alias("balance_mu")))


# ---- cash flow


@query(f"WITH {_daily(EVENT_TX)} SELECT account, date, balance FROM acc")
def balance_by_account(spark, sf_dir):
    return cashflow.account_balances(bridge.event_ledger(spark, sf_dir), bridge.balances(spark, sf_dir))


@query(f"WITH {_daily(EVENT_TX)} SELECT date, total FROM total")
def balance_walk(spark, sf_dir):
    return cashflow.daily_totals(cashflow.account_balances(bridge.event_ledger(spark, sf_dir), bridge.balances(spark, sf_dir)))


@query(f"WITH {_daily(ORDER_TX)} SELECT date, total FROM total")
def balance_daily(spark, sf_dir):
    return _totals(spark, sf_dir)


@query(f"""WITH {_daily(ORDER_TX)} SELECT date, total, round(avg(total) OVER (ORDER BY date ROWS 6 PRECEDING) / 100, 4) AS ma_7, round(avg(total) OVER (ORDER BY date ROWS 29 PRECEDING) / 100, 4) AS ma_30,
round(avg(total) OVER (ORDER BY date ROWS 89 PRECEDING) / 100, 4) AS ma_90 FROM total""")
def moving_averages(spark, sf_dir):
    return cashflow.rolling(_totals(spark, sf_dir)).select("date", "total", *[F.round(F.col(f"ma_{n}") / 100, 4).alias(f"ma_{n}") for n in (7, 30, 90)])


@query(f"""WITH {_daily(ORDER_TX)}, c AS (SELECT date, total - lag(total) OVER (ORDER BY date) AS change FROM total)
SELECT date, change, CAST(sum(change) OVER (ORDER BY date ROWS 29 PRECEDING) AS BIGINT) AS velocity_30 FROM c""")
def velocity_30(spark, sf_dir):
    return cashflow.rolling(_totals(spark, sf_dir)).select("date", "change", "velocity_30")


@query(f"""WITH {_daily(ORDER_TX)}, c AS (SELECT date, total, total - lag(total) OVER (ORDER BY date) AS change FROM total)
SELECT last_day(date) AS month_end, round(avg(total) / 100, 4) AS mean, min(total) AS least, max(total) AS most, max_by(total, date) AS end, CAST(coalesce(sum(change), 0) AS BIGINT) AS net_change FROM c GROUP BY 1""")
def monthly_rollup(spark, sf_dir):
    return cashflow.monthly(_totals(spark, sf_dir)).withColumn("mean", F.round(F.col("mean") / 100, 4))


@query(f"""WITH {_daily(ORDER_TX)}, s AS (SELECT date_diff('day', min(date) OVER (), date) AS x, total / 100 AS y FROM total)
SELECT count(*) AS n, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 2) AS intercept, round(corr(y, x), 6) AS r, round(regr_slope(y, x) * 365, 2) AS yearly FROM s""")
def trend_regression(spark, sf_dir):
    t = cashflow.trend(_totals(spark, sf_dir))
    return t.select("n", F.round(F.col("slope") / 100, 4).alias("slope"), F.round(F.col("intercept") / 100, 2).alias("intercept"), F.round("r", 6).alias("r"), F.round(F.col("yearly") / 100, 2).alias("yearly"))


@query(f"""WITH {_daily(ORDER_TX)}, c AS (SELECT date, total, total - lag(total) OVER (ORDER BY date) AS change, row_number() OVER (ORDER BY date DESC) AS back FROM total)
SELECT max_by(total, date) AS last_total, round(avg(total) / 100, 4) AS mean_total, round(stddev_samp(total) / 100, 2) AS std_total, min(total) AS least,
(SELECT min(date) FROM c WHERE total = (SELECT min(total) FROM c)) AS least_date, max(total) AS most, (SELECT min(date) FROM c WHERE total = (SELECT max(total) FROM c)) AS most_date,
count(*) FILTER (WHERE change > 0) AS up_days, count(*) FILTER (WHERE change < 0) AS down_days, round(avg(change) / 100, 4) AS mean_change,
round(avg(total) FILTER (WHERE back <= 30) / 100, 4) AS mean_30, round(avg(total) FILTER (WHERE back <= 90) / 100, 4) AS mean_90 FROM c""")
def balance_stats(spark, sf_dir):
    s = cashflow.statistics(_totals(spark, sf_dir)).drop("variation_pct")
    return s.withColumns({c: F.round(F.col(c) / 100, 2 if c == "std_total" else 4) for c in ("mean_total", "std_total", "mean_change", "mean_30", "mean_90")})


@query(f"WITH {_daily(EVENT_TX)} SELECT account, round(avg(balance) / 100, 4) AS mean_balance, CASE WHEN avg(balance) >= 0 THEN 'positive' ELSE 'negative' END AS side FROM acc GROUP BY 1")
def composition_sign(spark, sf_dir):
    return cashflow.composition(balance_by_account(spark, sf_dir)).withColumn("mean_balance", F.round(F.col("mean_balance") / 100, 4))


# ---- text, sets, graph, streams


@query("""SELECT conv_id, turn, regexp_matches(lower(text), 'the|is') AND NOT regexp_matches(lower(text), 'password|secret') AS is_receipt FROM conversations""")
def receipt_email_classify(spark, sf_dir):
    c = bridge.table(spark, sf_dir, "conversations")
    flag = accounts.matches_any(F.col("text"), ["the", "is"]) & ~accounts.matches_any(F.col("text"), ["password", "secret"])
    return c.select("conv_id", "turn", F.when(F.col("text").isNotNull(), flag).alias("is_receipt"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderpriority LIKE '1%' UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT l_orderkey FROM lineitem WHERE l_quantity > 45")
def id_union_distinct(spark, sf_dir):
    o, li = bridge.table(spark, sf_dir, "orders"), bridge.table(spark, sf_dir, "lineitem")
    ids = [o.where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("id")), o.where("o_orderstatus = 'F'").select("o_orderkey"), li.where("l_quantity > 45").select("l_orderkey")]
    return ids[0].union(ids[1]).union(ids[2]).distinct()


@query("SELECT o_orderkey AS id FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def id_except(spark, sf_dir):
    return bridge.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).subtract(bridge.table(spark, sf_dir, "lineitem").select("l_orderkey"))


@query("SELECT o_orderkey AS id FROM orders INTERSECT SELECT l_orderkey FROM lineitem")
def id_intersect(spark, sf_dir):
    return bridge.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).intersect(bridge.table(spark, sf_dir, "lineitem").select("l_orderkey"))


@query(f"WITH {SPLITS} SELECT tx_id, amount_mu, memo, 'orders' AS source FROM s UNION ALL SELECT o_orderkey, -{_cents('o_totalprice')} * 10, 'receipt', 'receipts' FROM orders")
def edits_union_all(spark, sf_dir):
    a = splits.order_splits(_split_items(spark, sf_dir)).select("tx_id", "amount_mu", "memo", F.lit("orders").alias("source"))
    r = bridge.receipts(spark, sf_dir).select(F.col("base_name").alias("tx_id"), (F.col("total_cents") * -10).alias("amount_mu"), F.lit("receipt").alias("memo"), F.lit("receipts").alias("source"))
    return a.unionByName(r)


@query(f"""WITH a AS (SELECT c_custkey AS k, replace(replace(replace(c_name, '<', ' '), '>', ' '), '&', ' ') AS name, abs({_cents('c_acctbal')}) + 1 AS first FROM customer),
b AS (SELECT *, CASE WHEN k % 2 = 0 THEN first % 997 + 5 END AS second FROM a), c AS (SELECT *, first + coalesce(second, 0) AS subtotal FROM b), d AS (SELECT *, subtotal * 6 // 100 AS tax FROM c)
SELECT CAST(k AS VARCHAR) AS base_name, CASE WHEN k % 3 = 1 THEN 'modern_format' ELSE 'table_format' END AS format_detected, 'c@example.com' AS apple_id, DATE '2020-01-01' + CAST(k % 1500 AS INTEGER) AS receipt_date,
'ORD' || lpad(CAST(k AS VARCHAR), 8, '0') AS order_id, subtotal AS subtotal_cents, tax AS tax_cents, subtotal + tax AS total_cents,
name || '|' || CAST(first AS VARCHAR) || '|' || CAST(k % 5 = 0 AS VARCHAR) || CASE WHEN second IS NULL THEN '' ELSE ';Extra & more|' || CAST(second AS VARCHAR) || '|' || CAST(k % 5 = 0 AS VARCHAR) END AS items FROM d""")
def html_extract(spark, sf_dir):
    r = receipt_html.parse_pages(bridge.receipt_pages(spark, sf_dir))
    items = F.array_join(F.transform("items", lambda x: F.concat_ws("|", x["title"], x["cents"].cast("string"), x["subscription"].cast("string"))), ";")
    return r.select("base_name", "format_detected", "apple_id", "receipt_date", "order_id", "subtotal_cents", "tax_cents", "total_cents", items.alias("items"))


@query("SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_incremental(spark, sf_dir):
    state = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = bridge.table(spark, sf_dir, "events").schema
    take_up(spark, sf_dir, schema, f"{state}/rows", f"{state}/state", "events.parquet").awaitTermination()
    return spark.read.schema(schema).parquet(f"{state}/rows").groupBy(F.col("ts").cast("date").alias("date"), "event_type").agg(F.count("*").alias("n"))
