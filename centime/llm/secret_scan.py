"""Secret scans with DataFrame operations only: spans of single patterns, and credentials linked from several parts.

Base patterns give spans of their own. Two weak patterns are reported only beside what completes them: a bare secret if an
access identifier lies within the scope around it, an endpoint if an access identifier and a secret of either kind do. The
parts are linked by an interval join on bins as wide as the scope, against the extent of the complementary parts of each bin.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

# The base patterns; kind, pattern, the group whose length counts and the least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
WEAK = (
    ("linked_secret", r"(?<![A-Za-z0-9+/=_.-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", 0, 40),
    ("linked_endpoint", r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?|[a-z0-9.-]+\.amazonaws\.com", 0, 8),
)
KINDS = [k for k, *_ in (*BASE, *WEAK)]
#: Code points between the nearest ends of two parts that belong together.
SCOPE = 400
_PART = "array<struct<gap:int,len:int,counts:boolean>>"


def _found(text: Column, pattern: str, group: int, least: int) -> Column:
    """Each match in order: code points since the match before it, its own, and whether it is long enough."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sized = F.zip_with(matches, measured, lambda m, s: F.struct(F.length(m).alias("len"), (F.length(s) >= least).alias("counts")))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
    parts = F.zip_with(gaps, sized, lambda g, m: F.struct(F.length(g).alias("gap"), m["len"].alias("len"), m["counts"].alias("counts")))
    return F.when(text.rlike(pattern), parts.cast(_PART)).otherwise(F.array().cast(_PART))


def _spans(matches: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end) in code points from matches (doc_id, h, kind, parts), those that count."""
    each = matches.select("doc_id", "h", "kind", F.posexplode("parts").alias("i", "p")).select("doc_id", "h", "kind", "i", "p.*")
    before = Window.partitionBy("doc_id", "h", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("len")).over(before)
    return each.withColumn("end", end.cast("int")).where("counts").select("doc_id", "h", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def _within(parts: DataFrame, others: DataFrame, scope: int, name: str) -> DataFrame:
    """``parts`` with a boolean: does one of ``others`` in the same document lie within ``scope`` code points?

    Parts and others lie in the bins that their start and their exclusive end fall in and in those between. All that comes
    within the scope of a part is in one of its bins or the next on either side, where only the least start and the greatest
    end matter: what lies in a bin before the part's own starts before it, what lies in one after it ends after it.
    """
    bin_of = lambda c: F.floor(F.col(c) / F.lit(scope)).cast("int")
    extent = others.select("doc_id", "h", "start", "end", F.explode(F.sequence(bin_of("start"), bin_of("end"))).alias("bin"))
    extent = extent.groupBy("doc_id", "h", "bin").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    mine = parts.select("doc_id", "h", "kind", "start", "end", F.explode(F.sequence(bin_of("start") - 1, bin_of("end") + 1)).alias("bin"))
    x, y = mine.alias("x"), extent.alias("y")
    met = x.join(y, F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.bin") == F.col("y.bin")), "left")
    near = (F.col("last") >= F.col("start") - scope) & (F.col("first") <= F.col("end") + scope)
    return met.groupBy(*(F.col(f"x.{c}").alias(c) for c in ("doc_id", "h", "kind", "start", "end"))).agg(F.coalesce(F.bool_or(near), F.lit(False)).alias(name))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, h (hash of the text) and spans, an array of (kind, start, end) in order.

    Starts and ends are code points, ends exclusive; order is by start, then by kind as in KINDS. Null and empty texts have
    none. Repeated rows stay, each with its spans. Base spans are those of the patterns alone; linked ones come on top.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.xxhash64("text").alias("h"), text.alias("t"))
    found = base.select("doc_id", "h", "t", *[_found(F.col("t"), p, g, n).alias(k) for k, p, g, n in BASE])
    none = F.array().cast(_PART)
    weak = [F.when(F.exists("access", lambda x: x["counts"]), _found(F.col("t"), p, g, n)).otherwise(none).alias(k) for k, p, g, n in WEAK]
    held = checkpointed(found.select("doc_id", "h", *KINDS[: len(BASE)], *weak))
    some = held.where(reduce(lambda a, b: a | b, [F.size(k) > 0 for k in KINDS])).dropDuplicates(["doc_id", "h"])
    by_kind = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("parts")) for k in KINDS])
    spans = checkpointed(_spans(some.select("doc_id", "h", F.inline(by_kind))))
    access, secrets = spans.where("kind = 'access'"), spans.where("kind in ('assign', 'linked_secret')")
    weak_secrets = _within(spans.where("kind = 'linked_secret'"), access, scope, "ok").where("ok").drop("ok")
    known = secrets.where("kind = 'assign'").unionByName(weak_secrets)
    by_access = _within(spans.where("kind = 'linked_endpoint'"), access, scope, "ok").where("ok").drop("ok")
    endpoints = _within(by_access, known, scope, "ok").where("ok").drop("ok")
    every = spans.where(~F.col("kind").startswith("linked_")).unionByName(weak_secrets).unionByName(endpoints)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    per_text = every.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))
    x, y = held.select("doc_id", "h").alias("x"), per_text.alias("y")
    joined = x.join(y, F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.h") == F.col("y.h")), "left")
    return joined.select("x.doc_id", "x.h", F.coalesce("spans", F.array().cast("array<struct<start:int,rank:bigint,kind:string,end:int>>")).alias("spans"))


def report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) for each row of ``docs``."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["rank"] <= len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scan(docs, scope).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k, *_ in BASE],
        F.sha2(told(base).cast("binary"), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["rank"] > len(BASE))).cast("long").alias("n_linked"),
    )
