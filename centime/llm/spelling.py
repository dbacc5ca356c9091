"""Spelling variants by anagram hashing: words of one letter's difference, and the frequent form that each belongs to.

A word's anagram key is the sum of its letters' values, fifth powers, so that words of the same letters have the same key and a
changed letter changes it by the letters' values. Words differ by one added, removed or exchanged letter only if their keys differ
by that letter's value or by the difference of two. Taking each of a word's letters away in turn makes these differences an
equality: a word without one letter has the key of a word that lacks it, or of another word without the letter that it has instead.

Keys say nothing of order. One change leaves the first half of the remaining letters in place or the last, so the letters of one
half go along in the join; what meets is then checked by edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
POWER = 5


def runs(docs: DataFrame, least: int = 7) -> DataFrame:
    """(doc_id, run): every maximal run of at least ``least`` letters A-Z, a-z, U+00C0 to U+00FF in the whole texts, A-Z in lower case.

    Null and empty texts have none. Repeated rows each count.
    """
    found = F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]{%d,}+" % least), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def vocabulary(words: DataFrame, least: int = 7, seen: int = 2) -> DataFrame:
    """(word, n): the words (word) of at least ``least`` letters that occur ``seen`` times or more."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where((F.char_length("word") >= least) & (F.col("n") >= seen))


def letter_value(letter: Column) -> Column:
    """Fifth power of the letter's number: 1 to 26 for a to z, from 27 for U+00C0 on."""
    code = F.ascii(letter).cast("long")
    number, out = F.when(code < 128, code - 96).otherwise(code - 165), F.lit(1).cast("long")
    for _ in range(POWER):
        out = out * number
    return out


def anagram_key(word: Column) -> Column:
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, x: a + letter_value(x))


def _buckets(words: DataFrame) -> DataFrame:
    """(word, n, key, left, whole, side, half): each word whole and without each of its letters, under the letters of either half.

    left: how many letters remain, whole: whether that is all of them.
    """
    keyed = words.select("word", "n", anagram_key(F.col("word")).alias("full"), F.char_length("word").alias("size"), F.array_distinct(F.split("word", "")).alias("letters"))
    without = F.transform("letters", lambda x: F.struct((F.col("full") - letter_value(x)).alias("key"), (F.col("size") - 1).alias("left"), F.lit(False).alias("whole")))
    whole = F.array(F.struct(F.col("full").alias("key"), F.col("size").alias("left"), F.lit(True).alias("whole")))
    each = keyed.select("word", "n", "full", "size", F.inline(F.concat(whole, without)))
    at = F.expr("left div 2")
    halves = F.array(F.struct(F.lit(0).alias("side"), F.substr("word", F.lit(1), at).alias("half")), F.struct(F.lit(1).alias("side"), F.substr("word", F.col("size") - at + 1, at).alias("half")))
    return each.select("word", "n", "full", "key", "left", "whole", F.inline(halves))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all ordered pairs of ``words`` (word, n; distinct, without nulls) that one inserted, deleted or replaced letter parts.

    A pair has one key in common at most, as a change says which letters it concerns. Where both halves agree it is taken from
    the first, so no pair comes twice.
    """
    b = _buckets(words)
    x, y = b.where("not whole").alias("x"), b.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "left", "side", "half")]
    h = F.expr("x.left div 2")
    once = (F.col("x.side") == 0) | (F.substr("x.word", F.lit(1), h) != F.substr("y.word", F.lit(1), h))
    other = F.col("y.whole") | (F.col("x.word") < F.col("y.word")) & (F.col("x.full") != F.col("y.full"))
    close = F.levenshtein("x.word", "y.word", 1) == 1
    met = x.join(y, same).where(other & once & close).select(F.col("x.word").alias("a"), F.col("x.n").alias("an"), F.col("y.word").alias("b"), F.col("y.n").alias("bn"))
    both = F.array(F.struct("a", "b", "bn"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("an").alias("bn")))
    return met.select(F.inline(both).alias("word", "near", "near_n"))


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of ``words`` (word, n).

    form: the near word of largest n (ties: the smallest in code-point order), if it occurs ``ratio`` times as often at least;
    root: where following the forms ends, the word itself if it has none. No words give no rows.
    """
    words = checkpointed(words)
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    met = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= F.col("n") * ratio, -F.col("best.less")))
    told = checkpointed(met.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
    return told.join(_ends(told.where("form is not null").select("word", F.col("form").alias("root"))), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _ends(steps: DataFrame) -> DataFrame:
    """(word, root): where following the steps (word, root) ends; each round doubles their length. Forms grow, so there are no circles."""
    steps = checkpointed(steps)
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = checkpointed(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        steps = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return steps
