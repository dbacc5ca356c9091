"""Two channels for what a check looks at: rows that pass, and rows refused with a code and what was found.

Every input row is in exactly one of them. Both come from one pass: the code is a column, and ``tallied`` counts codes while
whatever reads the rows reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import money


def judged(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """``rows`` with ``code``: the first of the reasons that holds (a null condition does not), null for rows that pass."""
    code = F.lit(None).cast("string")
    for name, holds in reversed(reasons.items()):
        code = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(code)
    return rows.withColumn("code", code)


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("code is null").drop("code")


def refused(rows: DataFrame) -> DataFrame:
    return rows.where("code is not null")


def tallied(rows: DataFrame, codes: list[str], name: str = "tally") -> tuple[DataFrame, Observation]:
    """``rows`` and the counts that are there once something has read them: rows, accepted, and one for each code."""
    seen = Observation(name)
    of = lambda c: F.count_if(F.coalesce(F.col("code"), F.lit("")) == c)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), of("").alias("accepted"), *[of(c).alias(c) for c in codes]), seen


#: Why the splits of a transaction are refused, in the order in which reasons are tried.
SPLIT_CODES = ("no_amount", "no_splits", "split_without_amount", "split_without_memo", "sum_differs")


def split_verdicts(transactions: DataFrame, splits: DataFrame, tolerance: int = 0) -> DataFrame:
    """(tx_id, tx_mu, n_splits, total_mu, gap_mu, code) for each row of transactions (tx_id, tx_mu).

    splits: tx_id, amount_mu, memo. gap_mu is how far the splits' total is from minus the amount; null where either is unknown.
    """
    of = splits.groupBy("tx_id").agg(
        F.count("*").alias("n_splits"), F.sum("amount_mu").alias("total_mu"), F.count_if(F.col("amount_mu").isNull()).alias("bare"), F.count_if(F.coalesce("memo", F.lit("")) == "").alias("mute")
    )
    met = transactions.select("tx_id", "tx_mu").join(of, "tx_id", "left").withColumn("n_splits", F.coalesce("n_splits", F.lit(0)))
    met = met.withColumn("gap_mu", F.col("total_mu") + F.abs("tx_mu"))
    reasons = dict(zip(SPLIT_CODES, (F.col("tx_mu").isNull(), F.col("n_splits") == 0, F.col("bare") > 0, F.col("mute") > 0, F.abs("gap_mu") > tolerance)))
    return judged(met, reasons).select("tx_id", "tx_mu", "n_splits", "total_mu", "gap_mu", "code")


MONEY_CODES = ("missing", "no_number", "too_large")


def strict_money(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``cents`` of the column ``text`` as ``money.strict_cents`` reads it, and the code of what it refuses.

    A null is missing; an empty text is 0; what has other characters than a sign, digits, ``$``, commas and a point is no number.
    """
    cents = money.strict_cents(F.col(text))
    digits = F.length(F.regexp_replace(F.substring_index(F.col(text), ".", 1), "[^0-9]", ""))
    reasons = {"missing": F.col(text).isNull(), "too_large": (digits > 16) & F.regexp_replace(F.trim(F.col(text)), r"[$,]", "").rlike(r"^-?[0-9]+(\.[0-9]*)?$"), "no_number": F.col("cents").isNull()}
    return judged(rows.withColumn("cents", F.when(digits <= 16, cents)), reasons)
