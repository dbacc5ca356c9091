"""Confidence of a match as a function of the day gap: literal tables, as amounts always agree exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (largest gap, confidence) in hundredths.
COMPLETE_ONE_DATE = ((0, 100), (1, 98), (2, 95), (3, 90), (5, 85), (7, 80))
COMPLETE_MORE_DATES = ((2, 100), (3, 95), (5, 89), (7, 84))
SPLIT = ((0, 95), (2, 90), (5, 81))
SPLIT_BEYOND = 71
RECEIPT = ((0, 100), (1, 95), (2, 85), (3, 75))
#: What each method adds when the best match is chosen, in hundredths.
PRIORITY = {"complete": 10, "split": 5}
#: Gaps that count for an order without ship dates.
COMPLETE_DEFAULT_GAP, SPLIT_DEFAULT_GAP, COMPLETE_LIMIT = 7, 3, 7


def by_gap(gap: Column, steps: tuple, beyond: int | None = None) -> Column:
    found = F.lit(beyond)
    for most, score in reversed(steps):
        found = F.when(gap <= most, F.lit(score)).otherwise(found)
    return found.cast("int")


def complete(gap: Column, n_dates: Column) -> Column:
    return F.when(n_dates > 1, by_gap(gap, COMPLETE_MORE_DATES)).otherwise(by_gap(gap, COMPLETE_ONE_DATE))


#: The least confidence, in hundredths, of a match of each method; others need OTHER_MIN.
METHOD_MIN, OTHER_MIN = {"complete": 75, "split": 65}, 60


def meets_threshold(score: Column, method: Column) -> Column:
    least = F.lit(OTHER_MIN)
    for name, most in METHOD_MIN.items():
        least = F.when(method == name, F.lit(most)).otherwise(least)
    return F.coalesce(score >= least, F.lit(False))


def level(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.75, "medium").when(confidence >= 0.5, "low").otherwise("none")
