"""The six tables that a cash-flow dashboard draws, and the wide frame and the cube behind it. Amounts in cents.

``Dashboard`` walks the balances once: the series by account and the total are cut off by a checkpoint, and each table is a small
plan over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from . import cashflow


class Dashboard:
    """Over account_days (account, date, balance) as ``cashflow.account_balances`` gives it."""

    def __init__(self, account_days: DataFrame):
        self.account_days = checkpointed(account_days.select("account", "date", "balance"))
        self.totals = checkpointed(cashflow.daily_totals(self.account_days))

    def main_trend(self) -> DataFrame:
        """(date, total, ma_7, ma_30, ma_90, fitted): the series, its trailing means and its least-squares line."""
        means = cashflow.rolling(self.totals).select("date", "total", "ma_7", "ma_30", "ma_90")
        return means.join(cashflow.trend_line(self.totals).select("date", "fitted"), "date")

    def monthly_flow(self) -> DataFrame:
        """(month_end, net_change, side, mean_net): a change of 0 is on the side of losses; mean_net is that of all months."""
        month = cashflow.monthly(self.totals).select("month_end", "net_change")
        mean = F.avg("net_change").over(Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return month.select("month_end", "net_change", F.when(F.col("net_change") > 0, "gain").otherwise("loss").alias("side"), mean.alias("mean_net"))

    def volatility(self) -> DataFrame:
        """(month_end, least, most, mean, end) of the total."""
        return cashflow.monthly(self.totals).select("month_end", "least", "most", "mean", "end")

    def velocity(self) -> DataFrame:
        """(date, velocity, side): the sum of the last 30 changes; the first day has none and no side."""
        v = cashflow.rolling(self.totals).select("date", F.col("velocity_30").alias("velocity"))
        return v.withColumn("side", F.when(F.col("velocity") >= 0, "up").when(F.col("velocity") < 0, "down"))

    def composition(self) -> DataFrame:
        """(date, account, balance, side, base, top): accounts of a mean of 0 or more lie on one another, in order of their names.

        base and top are the edges of an account's layer on a day; others are lines of their own, without edges.
        """
        side = cashflow.composition(self.account_days).select("account", "side")
        layer = self.account_days.join(side, "account")
        below = Window.partitionBy("date", "side").orderBy("account").rowsBetween(Window.unboundedPreceding, 0)
        top = F.when(F.col("side") == "positive", F.sum("balance").over(below))
        return layer.withColumn("top", top).select("date", "account", "balance", "side", (F.col("top") - F.col("balance")).alias("base"), "top")

    def statistics(self) -> DataFrame:
        """One row: ``cashflow.statistics``, the shares of ``health`` and the trend's figures."""
        trend = cashflow.trend(self.totals).select(F.lit(1).alias("k"), "slope", "monthly", "yearly", (F.abs("r") * 100).alias("confidence_pct"), F.when(F.col("slope") > 0, "growing").otherwise("declining").alias("direction"))
        health = cashflow.health(self.totals).withColumn("k", F.lit(1))
        return cashflow.statistics(self.totals).withColumn("k", F.lit(1)).join(health, "k").join(trend, "k").drop("k")

    def wide(self) -> DataFrame:
        """(date, total, a column for each account): the accounts are found in the data; those without a day's balance are null."""
        frame = self.account_days.groupBy("date").pivot("account").agg(F.sum("balance"))
        return frame.join(self.totals, "date")


def flow_cube(transactions: DataFrame) -> DataFrame:
    """(month, account, side, cents, n, level): sums of transactions (account, date, cents) by month, account and sign, in one pass.

    level says which of them a row is of: ``month-account``, ``month``, ``account`` or ``all``; columns that a level does not tell are
    null. side is ``in`` for amounts of 0 or more, else ``out``.
    """
    rows = transactions.select(F.trunc("date", "month").alias("month"), "account", F.when(F.col("cents") >= 0, "in").otherwise("out").alias("side"), "cents")
    sets = [[F.col("month"), F.col("account"), F.col("side")], [F.col("month"), F.col("side")], [F.col("account"), F.col("side")], [F.col("side")]]
    cube = rows.groupingSets(sets, "month", "account", "side").agg(F.sum("cents").alias("cents"), F.count("*").alias("n"), F.grouping_id("month", "account", "side").alias("g"))
    level = F.when(F.col("g") == 0, "month-account").when(F.col("g") == 2, "month").when(F.col("g") == 4, "account").otherwise("all")
    return cube.select("month", "account", "side", "cents", "n", level.alias("level"))
