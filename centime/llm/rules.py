"""Quality rules whose cutoffs labelled rows choose, so that few good documents are rejected in each stratum.

A rule compares a measure of a text with a cutoff. ``CUTOFFS`` lists cutoffs from loose to strict; level t of all rules together
is one hypothesis: "at this level more than ``risk`` of a stratum's good documents are rejected". Rules and cutoffs are fixed before
any label is looked at, so every labelled row is holdout. With k of n good rows rejected, the exact binomial chance of k or fewer at
a rate of ``risk`` decides: the hypothesis is refused if that is at most ``error / strata`` (Bonferroni over the strata). Levels are
tried from the loosest on and the first that can't be refused ends the stratum's sequence, which needs no further correction. So
with a chance of ``1 - error`` no stratum loses more than ``risk`` of its good documents. A stratum of too few labels gets no cutoff.

All of it is DataFrame functions; a text's windows are counted within its row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, quoted

_BLANK = " \\t-\\r"
WINDOW = 5
#: From loose to strict, in hundredths of the words or of the lines that have words; of word length in hundredths of code points.
CUTOFFS = {
    "symbols": (200, 150, 100, 75, 50, 40, 30, 25, 20, 15),
    "repeated_lines": (95, 90, 85, 80, 75, 70, 65, 60, 55, 50),
    "word_length": (2000, 1800, 1600, 1500, 1400, 1300, 1250, 1200, 1150, 1100),
    "doubled_words": (90, 80, 70, 60, 50, 45, 40, 35, 30, 25),
}
RISK, ERROR = 0.05, 0.05


def _next(array: str, at: str, then: str) -> Column:
    """The array's elements, each with the one after it (null for the last)."""
    return F.arrays_zip(F.col(array).alias(at), F.slice(array, F.lit(2), F.greatest(F.size(array), F.lit(0))).alias(then))


def measures(docs: DataFrame, *keep: Column | str) -> DataFrame:
    """``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (those with a word) and n_doubled.

    One row for each row of ``docs`` (text); the columns of ``keep`` have names other than those. Null and empty texts count 0
    throughout. n_doubled: words equal to the word before. Windows are told apart by 64-bit hashes within one text.
    """
    names = docs.select(*keep).columns
    text = F.coalesce("text", F.lit(""))
    t = docs.select(
        *keep,
        F.filter(F.split(text, f"[{_BLANK}]+"), lambda x: x != "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{_BLANK}]")).alias("lines"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    hashes = F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)]))
    t = t.select(
        *names, "n_symbols", F.size("w").cast("long").alias("n_words"), F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(_next("w", "a", "b"), lambda z: z["a"] == z["b"])).cast("long").alias("n_doubled"),
        F.when(F.size("w") >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    places = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    t = t.withColumn("h", F.when(F.size(F.array_distinct("h")) < F.size("h"), places))
    twice = F.filter(_next("h", "a", "b"), lambda z: z["a"]["x"] == z["b"]["x"])
    at = F.sort_array(F.array_distinct(F.flatten(F.transform(twice, lambda z: F.array(z["a"]["i"], z["b"]["i"])))))
    t = t.withColumn("at", F.when(F.col("h").isNotNull(), at)).drop("h")
    covered = F.aggregate(_next("at", "a", "b"), F.lit(0).cast("long"), lambda n, z: n + F.least(F.lit(WINDOW), z["b"] - z["a"]))
    return t.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("at")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def strictness(cutoffs: dict[str, tuple[int, ...]] = CUTOFFS) -> Column:
    """The first level at which a row of ``measures`` is rejected by a rule; as many as there are levels if none does."""
    value = {"symbols": ("n_symbols", "n_words"), "repeated_lines": ("n_dup_lines", "n_lines"), "word_length": ("word_chars", "n_words"), "doubled_words": ("n_doubled", "n_words")}
    levels = max(len(c) for c in cutoffs.values())
    firsts = []
    for rule, steps in cutoffs.items():
        of, per = value[rule]
        first = F.lit(levels)
        for t in reversed(range(len(steps))):
            first = F.when(F.col(of) * 100 > F.col(per) * steps[t], t).otherwise(first)
        firsts.append(first)
    return F.least(*firsts) if len(firsts) > 1 else firsts[0]


def binomial_at_most(k: Column, n: Column, rate: float) -> Column:
    """The chance of ``k`` or fewer of ``n`` at ``rate``; 1 where k is over the mean, which no cutoff needs exactly.

    Terms follow from one another as logarithms, so none under- or overflows before it is added.
    """
    step = math.log(rate) - math.log1p(-rate)
    first = F.struct((n * math.log1p(-rate)).cast("double").alias("log"), F.lit(0.0).alias("sum"))
    add = lambda a, i: F.struct((a["log"] + F.log((n - i).cast("double")) - F.log((i + 1).cast("double")) + step).alias("log"), (a["sum"] + F.exp(a["log"])).alias("sum"))
    chance = F.aggregate(F.sequence(F.lit(0).cast("long"), k), first, add, lambda a: a["sum"])
    return F.when(k > n * rate, F.lit(1.0)).otherwise(chance)


def certified(holdout: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, level, n_good, n_rejected): the strictest certified level of each stratum; strata without one are left out.

    holdout: stratum (not null) and strictness of good rows. Only counts of strata and levels are gathered.
    """
    counts = holdout.groupBy("stratum", "strictness").agg(F.count("*").alias("c"))
    of = counts.groupBy("stratum").agg(F.sum("c").alias("n_good"), F.array_sort(F.collect_list(F.struct("strictness", "c"))).alias("counts"))
    strata = counts.agg(F.count_distinct("stratum")).first()[0]
    upto = lambda t: F.aggregate(F.filter("counts", lambda x: x["strictness"] <= t), F.lit(0).cast("long"), lambda a, x: a + x["c"])
    levels = F.sequence(F.lit(0), F.lit(max(len(c) for c in CUTOFFS.values()) - 1))
    each = of.select("stratum", "n_good", F.posexplode(F.transform(levels, upto)).alias("level", "n_rejected"))
    tried = each.withColumn("safe", binomial_at_most(F.col("n_rejected"), F.col("n_good"), risk) <= error / max(strata, 1))
    failed = tried.groupBy("stratum").agg(F.coalesce(F.min(F.when(~F.col("safe"), F.col("level"))), F.count("*")).cast("int").alias("failed"))
    return tried.join(failed, "stratum").where("level = failed - 1").select("stratum", "level", "n_good", "n_rejected")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(doc_id, the measures, base_failed, kept) for every row of ``docs`` (doc_id, text, stratum); other columns are not read.

    labels (doc_id, quality): rows whose every label is 1 are good. Good rows that fail the base rules say nothing of the others
    and are not counted. A null stratum is one of its own. Null texts have no words and so fail the base rules. Repeated rows
    each get a row. Without labels, or with too few, only the base rules reject. An empty table gives no rows.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(quoted(stratum)).cast("string")), F.lit("-"))
    m = checkpointed(measures(docs, "doc_id", key.alias("stratum")).withColumns({"base_failed": base_failed(), "strictness": strictness()}))
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    levels = certified(m.where("not base_failed").join(good, "doc_id", "left_semi").select("stratum", "strictness"), risk, error)
    met = m.join(levels.select("stratum", "level"), "stratum", "left")
    return met.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("strictness") > F.coalesce("level", F.lit(-1)))).alias("kept"), F.col("level").alias("cutoff_level"), "strictness",
    )
