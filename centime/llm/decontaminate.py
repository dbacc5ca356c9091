"""Benchmark decontamination with DataFrame operations only.

Benchmark texts give windows of words. A bit set of the windows' hashes, a literal in the plan, passes the few positions of a
training text that can match; those windows are verified against the exact set in a hash join.
"""

from __future__ import annotations

import json
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name, quoted

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same separators in a text whose case is kept.
NOT_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Words of a window that the bit set tells it by.
FIRST_WORDS = 4
#: Up to these sizes the windows are broadcast; beyond, the join is left to exchange them.
BROADCAST_WINDOWS, BROADCAST_BYTES = 1_000_000, 128 << 20
#: Bits of the filter: a power of two, 64 for each window up to the larger bound. Past it more positions pass; none is lost.
FEWEST_BITS, MOST_BITS = 1 << 12, 1 << 20
ALL = (1 << 31) - 1


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), NOT_WORD), "")


def _positions(words: Column, size) -> Column:
    """1-based starts of the windows of that size."""
    return F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(gram, len, items): each distinct window of benchmark (item_id, text), its number of words, the ids that have it."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.select("item", "w", F.least(F.size("w"), F.lit(window)).alias("len"))
    grams = w.select("item", "len", F.explode(F.transform(_positions(F.col("w"), F.col("len")), lambda i: F.slice("w", i, F.col("len")))).alias("g"))
    sets = grams.groupBy(F.array_join("g", " ").alias("gram"), "len").agg(F.collect_set("item").alias("items"), F.first("g").alias("g"))
    first = F.coalesce(*[F.when(F.col("len") >= k, _hash([F.get("g", i) for i in range(k)])) for k in range(FIRST_WORDS, 0, -1)])
    return sets.select("gram", "len", "items", first.alias("h"))



def _bit(h: Column, bits: int, k: int) -> Column:
    return F.shiftright(h, 32 * k).bitwiseAND(F.lit(bits - 1))


def _bit_set(grams: DataFrame, n: int) -> tuple[Column, int]:
    """Two bits for the hash of each window's first words."""
    bits = FEWEST_BITS
    while bits < min(64 * n, MOST_BITS):
        bits *= 2
    at = grams.select(F.explode(F.array(_bit(F.col("h"), bits, 0), _bit(F.col("h"), bits, 1))).alias("b")).distinct()
    cells = at.groupBy(F.expr("b div 64").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v"))
    values = [0] * (bits // 64)
    for r in cells.collect():  # at most MOST_BITS / 64 rows
        values[r["cell"]] = r["v"]
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>"), bits


def _may_match(h: Column, cells: Column, bits: int) -> Column:
    def has(k: int) -> Column:
        b = _bit(h, bits, k)
        return F.bit_get(F.get(cells, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1

    return has(0) & has(1)


def _hash(words: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(words)), *words)


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, n_words, n_hit, spans (start word, words; in order), items (sorted).

    Words are runs of ASCII letters or digits (A-Z lower-cased) and of all characters beyond ASCII. A window is that many
    consecutive words of an item; an item of fewer, but not none, is one window. Null texts have no words. Repeated rows
    stay. Empty tables give no rows, or no hits. A null item_id is not listed, its windows still count.
    """
    grams = checkpointed(benchmark_windows(benchmark, window))
    n, octets, sizes = grams.agg(F.count("*"), F.coalesce(F.sum(F.length("gram") + 40), F.lit(0)), F.array_sort(F.collect_set("len"))).first()
    w, pos = F.col("w"), F.col("pos")
    tokens = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("w"))
    # A row for each position with its first words: generated code all through, and the word array stays where it is.
    # Every document keeps its row at position 0, which carries what holds for the whole document.
    follow = F.arrays_zip(*[(w if k == 0 else F.slice(w, k + 1, ALL)).alias(f"w{k}") for k in range(FIRST_WORDS)])
    spots = tokens.select("doc_id", "text_hash", "w", F.posexplode_outer(follow).alias("pos", "first"))
    none, gram = F.array().cast("array<struct<len:int,gram:string>>"), F.struct(F.lit(0).alias("len"), F.lit(None).cast("string").alias("gram"))
    found = none
    if n:
        cells, bits = _bit_set(grams, n)
        lead = sorted({min(size, FIRST_WORDS) for size in sizes})
        may = reduce(lambda a, b: a | b, [_may_match(_hash([F.col(f"first.w{i}") for i in range(k)]), cells, bits) for k in lead])
        spots = spots.where((F.coalesce(pos, F.lit(0)) == 0) | may)
        fits = [F.when(pos + size <= F.size(w), F.struct(F.lit(size).alias("len"), F.concat_ws(" ", *[F.get(w, pos + k) for k in range(size)]).alias("gram"))) for size in sizes]
        found = F.array_compact(F.array(*fits))
    else:
        spots = spots.where(F.coalesce(pos, F.lit(0)) == 0)
    grams_here = F.when(F.coalesce(pos, F.lit(0)) == 0, F.concat(F.array(gram), found)).otherwise(found)
    rows = spots.select("doc_id", "text_hash", F.size(w).alias("n_words"), F.coalesce(pos + 1, F.lit(1)).alias("pos"), F.inline(grams_here))
    known = grams.select("gram", "items")
    if n <= BROADCAST_WINDOWS and octets <= BROADCAST_BYTES:
        known = F.broadcast(known)
    met = rows.join(known, "gram", "left").where("len = 0 or items is not null")
    by_row = met.groupBy("doc_id", "text_hash", "n_words").agg(
        F.count_if(F.col("len") == 0).cast("int").alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("len") > 0, F.struct("pos", "len")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    last = lambda s: s["pos"] + s["len"] - 1
    n_hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["hit"] + F.greatest(F.lit(0), last(s) - F.greatest(a["end"], s["pos"] - 1))).alias("hit"), F.greatest(a["end"], last(s)).alias("end")),
    )["hit"]
    return by_row.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), "spans", "items", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``."""
    return find_hits(docs, benchmark, window).select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated rows; all columns stay.

    Rows are told apart by doc_id and a hash of the text: of repeated ids only the rows with a hit go, null ids included. Null
    and empty texts stay. Empty tables take nothing away.
    """
    at, digest = free_name(docs, "hit_id"), free_name(docs, "hit_hash")
    bad = find_hits(docs, benchmark, window).where("n_hit > 0").select(F.col("doc_id").alias(at), F.col("text_hash").alias(digest)).distinct()
    return docs.join(bad, docs.doc_id.eqNullSafe(F.col(at)) & (F.xxhash64(docs.text) == F.col(digest)), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the hit words cut from ``text``; what separates words stays, and so do all columns and rows."""
    at, digest, spans, words, gaps, lead = (free_name(docs, f"hit_{c}") for c in ("id", "hash", "spans", "words", "gaps", "lead"))
    bad = find_hits(docs, benchmark, window).where("n_hit > 0").select(F.col("doc_id").alias(at), F.col("text_hash").alias(digest), F.col("spans").alias(spans))
    joined = docs.join(bad.dropDuplicates([at, digest]), docs.doc_id.eqNullSafe(F.col(at)) & (F.xxhash64(docs.text) == F.col(digest)), "left")
    between = F.regexp_extract_all("text", F.lit(NOT_WORD_ANY_CASE), F.lit(0))
    parts = joined.withColumns({words: F.array_remove(F.split("text", NOT_WORD_ANY_CASE), ""), gaps: between, lead: F.col("text").rlike("^" + NOT_WORD_ANY_CASE)})
    hit = lambda i: F.exists(spans, lambda s: (s["pos"] <= i) & (i < s["pos"] + s["len"]))
    word = lambda i: F.when(hit(i), F.lit("")).otherwise(F.element_at(words, i))
    gap = lambda i: F.coalesce(F.get(gaps, i), F.lit(""))
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.concat(word(i), gap(i - 1 + F.col(lead).cast("int")))), "")
    cut = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.concat(F.when(F.col(lead), gap(F.lit(0))).otherwise(F.lit("")), body))
    return parts.withColumn("text", cut).select(*[F.col(quoted(c)) for c in docs.columns])
