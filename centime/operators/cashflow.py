"""Daily balances walked back from current ones, with rolling, monthly and trend figures. Amounts in cents."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import floor_div


def _series():
    """The daily series in order. It has one row a day however large the ledger, so one task holds it."""
    return Window.orderBy("date")


def cash_accounts(accounts: DataFrame, names: list[str]) -> DataFrame:
    return accounts.where(F.col("name").isin(names) & ~F.col("closed"))


def cash_transactions(transactions: DataFrame, accounts: DataFrame, start: str) -> DataFrame:
    kept = transactions.where((F.col("date") >= F.lit(start).cast("date")) & ~F.coalesce("deleted", F.lit(False)))
    return kept.join(accounts.select(F.col("name").alias("account")), "account", "left_semi")


def daily_net(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("account", "date").agg(F.sum("cents").alias("net"))


def account_balances(transactions: DataFrame, balances: DataFrame) -> DataFrame:
    """(account, date, balance) for every account on every day of the ledger, first to last transaction date.

    transactions (account, date, cents), balances (account, cents): current ones. The balance on a date with transactions
    is that before them; a day without carries the one before. Accounts meet all dates by an array of the distinct dates
    (a row a day, however many transactions), so each account's window has one row a day.
    """
    net = daily_net(transactions)
    days = transactions.select("date").distinct().groupBy().agg(F.array_sort(F.collect_set("date")).alias("days"))
    grid = balances.select("account", F.col("cents").alias("now")).withColumn("k", F.lit(1)).join(F.broadcast(days.withColumn("k", F.lit(1))), "k")
    dated = grid.select("account", "now", F.explode("days").alias("date")).join(net, ["account", "date"], "left")
    later = Window.partitionBy("account").orderBy(F.col("date").desc())
    opened = dated.select("account", "date", (F.col("now") - F.sum(F.coalesce("net", F.lit(0))).over(later)).alias("balance"))
    upto = F.lead("date", 1).over(Window.partitionBy("account").orderBy("date"))
    held = opened.withColumn("last", F.coalesce(F.date_sub(upto, 1), "date"))
    return held.select("account", F.explode(F.sequence("date", "last")).alias("date"), "balance")


def daily_totals(account_days: DataFrame) -> DataFrame:
    return account_days.groupBy("date").agg(F.sum("balance").alias("total"))


def rolling(totals: DataFrame, windows: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """Trailing means over rows, the change from the day before and its 30-row sum. The series has one row a day."""
    out = totals.withColumns({f"ma_{n}": F.avg("total").over(_series().rowsBetween(1 - n, 0)) for n in windows})
    out = out.withColumn("change", F.col("total") - F.lag("total").over(_series()))
    return out.withColumn("velocity_30", F.sum("change").over(_series().rowsBetween(-29, 0)))


def monthly(totals: DataFrame) -> DataFrame:
    change = totals.withColumn("change", F.col("total") - F.lag("total").over(_series()))
    return change.groupBy(F.last_day("date").alias("month_end")).agg(
        F.avg("total").alias("mean"), F.min("total").alias("least"), F.max("total").alias("most"),
        F.max_by("total", "date").alias("end"), F.coalesce(F.sum("change"), F.lit(0)).alias("net_change"),
    )


def trend(totals: DataFrame) -> DataFrame:
    """Least squares of the total on the day number: slope, intercept, r, standard error, monthly and yearly change.

    Fewer than two days, or a constant series, give zeros.
    """
    x = F.datediff("date", F.min("date").over(Window.partitionBy())).cast("double")
    s = totals.select(x.alias("x"), F.col("total").cast("double").alias("y")).agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"),
    )
    r = F.coalesce(F.try_divide("sxy", F.sqrt(F.col("sxx") * F.col("syy"))), F.lit(0.0))
    err = F.coalesce(F.sqrt(F.greatest(F.lit(0.0), 1 - r * r) * F.try_divide("syy", F.col("sxx") * (F.col("n") - 2))), F.lit(0.0))
    slope = F.coalesce("slope", F.lit(0.0))
    return s.select("n", slope.alias("slope"), F.coalesce("intercept", F.lit(0.0)).alias("intercept"), r.alias("r"), err.alias("stderr"), (slope * 30).alias("monthly"), (slope * 365).alias("yearly"))


def p_value(r: float, n: int) -> float:
    """Two-sided p of a correlation: the regularised incomplete beta function at 1 - r*r, by its continued fraction."""
    if n < 3:
        return 0.0 if n == 2 and r else 1.0
    a, b, x = (n - 2) / 2, 0.5, 1 - r * r
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x < 1 else 0.0
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def _fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the incomplete beta function's continued fraction."""
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 300):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + t * d or 1e-300)
            c = 1 + t / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return h


def statistics(totals: DataFrame) -> DataFrame:
    """Summary of the daily series in one row: extremes keep their first dates, deviations are sample ones."""
    s = totals.withColumns({"change": F.col("total") - F.lag("total").over(_series()), "back": F.row_number().over(Window.orderBy(F.col("date").desc()))})
    mean, std = F.avg("total"), F.stddev_samp("total")
    return s.agg(
        F.max_by("total", "date").alias("last_total"), mean.alias("mean_total"), std.alias("std_total"),
        F.min("total").alias("least"), F.min_by("date", F.struct("total", "date")).alias("least_date"),
        F.max("total").alias("most"), F.max_by("date", F.struct(F.col("total"), -F.datediff("date", F.lit("1970-01-01").cast("date")))).alias("most_date"),
        F.count_if(F.col("change") > 0).alias("up_days"), F.count_if(F.col("change") < 0).alias("down_days"), F.avg("change").alias("mean_change"),
        F.avg(F.when(F.col("back") <= 30, F.col("total"))).alias("mean_30"), F.avg(F.when(F.col("back") <= 90, F.col("total"))).alias("mean_90"),
        (F.try_divide(std, mean) * 100).alias("variation_pct"),
    )


def health(totals: DataFrame) -> DataFrame:
    """What the monthly figures add to ``statistics``: shares of all days, the mean monthly change and spread of extremes."""
    day = totals.withColumn("change", F.col("total") - F.lag("total").over(_series())).agg(
        (F.count_if(F.col("change") > 0) / F.count("*") * 100).alias("up_pct"), (F.count_if(F.col("change") < 0) / F.count("*") * 100).alias("down_pct")
    )
    month = monthly(totals).agg(F.avg("net_change").alias("mean_monthly_net"), (F.avg("most") - F.avg("least")).alias("mean_monthly_range"))
    return day.join(month)


def trend_line(totals: DataFrame) -> DataFrame:
    """(date, total, fitted): the least-squares line beside the series; fewer than two days give 0. The trend is one row."""
    fit = trend(totals).select("slope", "intercept", F.lit(1).alias("k"))
    x = F.datediff("date", F.min("date").over(Window.partitionBy()))
    return totals.select("date", "total", x.alias("x"), F.lit(1).alias("k")).join(F.broadcast(fit), "k").select("date", "total", (F.col("slope") * F.col("x") + F.col("intercept")).alias("fitted"))


def with_p_value(trend_row: DataFrame) -> DataFrame:
    """The two-sided p of the trend's correlation beside its one row."""

    def add(batches):
        for b in batches:
            yield b.assign(p=[p_value(r, int(n)) for r, n in zip(b["r"], b["n"])])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in trend_row.schema)
    return trend_row.mapInPandas(add, f"{kinds}, p double")


def configured(transactions: DataFrame, accounts: DataFrame, names: list[str], start: str) -> tuple[DataFrame, DataFrame]:
    """The two sides of ``account_balances`` for the open accounts of those names and their live transactions since a day.

    accounts: name, closed, balance_mu; transactions: account, date, cents, deleted. Accounts off budget count too.
    """
    mine = cash_accounts(accounts, names)
    balances = mine.select(F.col("name").alias("account"), floor_div(F.col("balance_mu"), 10).alias("cents"))
    return cash_transactions(transactions, mine, start).select("account", "date", "cents"), balances


def composition(account_days: DataFrame) -> DataFrame:
    """Mean balance of each account and its sign group; zero counts as positive."""
    mean = F.avg("balance")
    return account_days.groupBy("account").agg(mean.alias("mean_balance"), F.when(mean >= 0, "positive").otherwise("negative").alias("side"))
