"""Queries of the dashboard's tables over the order ledger, and of mail that may be receipts; registered beside the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts, cashflow, dashboard
from . import bridge
from .queries import ORDER_TX, _daily, query

_SERIES = _daily(ORDER_TX)
_CHANGES = f"WITH {_SERIES}, c AS (SELECT date, total, total - lag(total) OVER (ORDER BY date) AS change FROM total)"


def _board(spark, sf_dir):
    return dashboard.Dashboard(cashflow.account_balances(bridge.order_ledger(spark, sf_dir), bridge.balances(spark, sf_dir)))


def _money(*names: str, digits: int = 4):
    return [F.round(F.col(c) / 100, digits).alias(c) for c in names]


@query(f"""WITH {_SERIES}, s AS (SELECT date, total, date_diff('day', min(date) OVER (), date) AS x, total / 100 AS y FROM total), f AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM s)
SELECT date, total, round(avg(total) OVER (ORDER BY date ROWS 6 PRECEDING) / 100, 4) AS ma_7, round(avg(total) OVER (ORDER BY date ROWS 29 PRECEDING) / 100, 4) AS ma_30,
round(avg(total) OVER (ORDER BY date ROWS 89 PRECEDING) / 100, 4) AS ma_90, round(a * x + b, 2) AS fitted FROM s, f""")
def board_main_trend(spark, sf_dir):
    return _board(spark, sf_dir).main_trend().select("date", "total", *_money("ma_7", "ma_30", "ma_90"), *_money("fitted", digits=2))


@query(f"""{_CHANGES}, m AS (SELECT last_day(date) AS month_end, CAST(coalesce(sum(change), 0) AS BIGINT) AS net_change FROM c GROUP BY 1)
SELECT month_end, net_change, CASE WHEN net_change > 0 THEN 'gain' ELSE 'loss' END AS side, round(avg(net_change) OVER () / 100, 4) AS mean_net FROM m""")
def board_monthly_flow(spark, sf_dir):
    return _board(spark, sf_dir).monthly_flow().select("month_end", "net_change", "side", *_money("mean_net"))


@query(f"WITH {_SERIES} SELECT last_day(date) AS month_end, min(total) AS least, max(total) AS most, round(avg(total) / 100, 4) AS mean, max_by(total, date) AS end FROM total GROUP BY 1")
def board_volatility(spark, sf_dir):
    return _board(spark, sf_dir).volatility().select("month_end", "least", "most", *_money("mean"), "end")


@query(f"""{_CHANGES}, v AS (SELECT date, CAST(sum(change) OVER (ORDER BY date ROWS 29 PRECEDING) AS BIGINT) AS velocity FROM c)
SELECT date, velocity, CASE WHEN velocity >= 0 THEN 'up' WHEN velocity < 0 THEN 'down' END AS side FROM v""")
def board_velocity(spark, sf_dir):
    return _board(spark, sf_dir).velocity()


@query(f"""WITH {_SERIES}, k AS (SELECT account, CASE WHEN avg(balance) >= 0 THEN 'positive' ELSE 'negative' END AS side FROM acc GROUP BY 1),
t AS (SELECT date, account, balance, side, CASE WHEN side = 'positive' THEN CAST(sum(balance) OVER (PARTITION BY date, side ORDER BY account) AS BIGINT) END AS top FROM acc JOIN k USING (account))
SELECT date, account, balance, side, top - balance AS base, top FROM t""")
def board_composition(spark, sf_dir):
    return _board(spark, sf_dir).composition()


@query(f"""{_CHANGES}, b AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS back, date_diff('day', min(date) OVER (), date) AS x, total / 100 AS y FROM c),
mo AS (SELECT last_day(date) AS m, min(total) AS least, max(total) AS most, coalesce(sum(change), 0) AS net FROM c GROUP BY 1)
SELECT max_by(total, date) AS last_total, round(avg(total) FILTER (WHERE back <= 30) / 100, 4) AS mean_30, round(avg(total) FILTER (WHERE back <= 90) / 100, 4) AS mean_90, round(avg(total) / 100, 4) AS mean_total,
round(stddev_samp(total) / 100, 2) AS std_total, min(total) AS least, (SELECT min(date) FROM c WHERE total = (SELECT min(total) FROM c)) AS least_date, max(total) AS most,
(SELECT min(date) FROM c WHERE total = (SELECT max(total) FROM c)) AS most_date, count(*) FILTER (WHERE change > 0) AS up_days, count(*) FILTER (WHERE change < 0) AS down_days,
round(count(*) FILTER (WHERE change > 0) / count(*) * 100, 6) AS up_pct, round(avg(change) / 100, 4) AS mean_change, (SELECT round(avg(net) / 100, 4) FROM mo) AS mean_monthly_net,
(SELECT round((avg(most) - avg(least)) / 100, 4) FROM mo) AS mean_monthly_range, round(regr_slope(y, x), 4) AS slope, round(regr_slope(y, x) * 30, 2) AS monthly,
round(abs(corr(y, x)) * 100, 4) AS confidence_pct, CASE WHEN regr_slope(y, x) > 0 THEN 'growing' ELSE 'declining' END AS direction, round(stddev_samp(total) / avg(total) * 100, 4) AS variation_pct FROM b""")
def board_statistics(spark, sf_dir):
    s = _board(spark, sf_dir).statistics()
    return s.select(
        "last_total", *_money("mean_30", "mean_90", "mean_total"), *_money("std_total", digits=2), "least", "least_date", "most", "most_date", "up_days", "down_days", F.round("up_pct", 6).alias("up_pct"),
        *_money("mean_change", "mean_monthly_net", "mean_monthly_range", "slope"), *_money("monthly", digits=2), F.round("confidence_pct", 4).alias("confidence_pct"), "direction", F.round("variation_pct", 4).alias("variation_pct"),
    )


_WIDE = ", ".join(f'CAST(sum(balance) FILTER (WHERE account = {k}) AS BIGINT) AS "account {k}"' for k in range(5))


@query(f"WITH {_SERIES} SELECT date, CAST(sum(balance) AS BIGINT) AS total, {_WIDE} FROM acc GROUP BY 1")
def board_wide(spark, sf_dir):
    frame = _board(spark, sf_dir).wide()
    return frame.select("date", "total", *[F.col(c).alias(f"account {c}") for c in frame.columns if c not in ("date", "total")])


@query(f"""WITH {ORDER_TX}, r AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, account, CASE WHEN cents >= 0 THEN 'in' ELSE 'out' END AS side, cents FROM tx)
SELECT month, account, side, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n,
CASE WHEN GROUPING(month) = 0 AND GROUPING(account) = 0 THEN 'month-account' WHEN GROUPING(month) = 0 THEN 'month' WHEN GROUPING(account) = 0 THEN 'account' ELSE 'all' END AS level
FROM r GROUP BY GROUPING SETS ((month, account, side), (month, side), (account, side), (side))""")
def board_flow_cube(spark, sf_dir):
    return dashboard.flow_cube(bridge.order_ledger(spark, sf_dir))


# ---- mail

_LISTS = {"senders": ["user@", "billing"], "subjects": ["the", "er"], "contents": ["and", "total"], "excluded": ["secret", "ing th"]}


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


@query(f"""WITH m AS (SELECT conv_id, turn, role || '@example.com' AS sender, substr(text, 1, 60) AS subject, text AS body FROM conversations)
SELECT conv_id, turn, coalesce({_any('sender', _LISTS['senders'])}, false) AND coalesce({_any('subject', _LISTS['subjects'])}, false) AND coalesce({_any('body', _LISTS['contents'])}, false)
AND NOT {_any("concat_ws(' ', subject, body)", _LISTS['excluded'])} AS is_receipt FROM m""")
def receipt_mail(spark, sf_dir):
    """Turns of conversations as mail: sender, subject and content each hold one of their phrases, and none that is excluded occurs."""
    c = bridge.table(spark, sf_dir, "conversations")
    mail = c.select("conv_id", "turn", F.concat("role", F.lit("@example.com")).alias("sender"), F.substring("text", 1, 60).alias("subject"), F.col("text").alias("body"))
    return mail.select("conv_id", "turn", accounts.is_receipt_mail(F.col("sender"), F.col("subject"), F.col("body"), **_LISTS).alias("is_receipt"))
