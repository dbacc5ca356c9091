"""Merkle manifest of a table: a radix-ranked trie of row digests, with a proof for every row.

Each row is a leaf. The leaves of a group stand in order of their id; every ``fanout`` consecutive nodes have a parent, until one
is left, the group's subroot. The subroots, in order of the group, likewise have the root over them.

No sort of a whole group gives the places: histograms of the id's digits, each made from the next finer one, tell how many rows
come before every prefix. A window sees the digits below one prefix only, ``2 ** DIGIT_BITS`` at most. The rank's digits in base
``fanout`` are then the keys of the trie's nodes: a node's rows share all but the last digits, so a level is one hash aggregation,
and all its groups have ``fanout`` rows at most, whatever the groups of the table are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, quoted

FANOUT = 8
DIGIT_BITS, ID_DIGITS = 13, 5
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts joined, as lower-case hex."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(values: list[Column]) -> Column:
    return digest(*[field(v) for v in values])


def id_digits(id_: Column) -> dict[str, Column]:
    """The digits of an integer in an order that keeps its own, the highest first; null comes before all."""
    bits = id_.cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    low = (1 << DIGIT_BITS) - 1
    cut = lambda i: F.shiftrightunsigned(bits, DIGIT_BITS * i).bitwiseAND(F.lit(low).cast("long")).cast("int")
    return {f"d{ID_DIGITS - 1 - i}": F.coalesce(cut(i), F.lit(-1)) for i in reversed(range(ID_DIGITS))}


def ranked(rows: DataFrame, of: list[str], digits: list[str], last: str) -> DataFrame:
    """``rows`` with ``start``, how many rows of its group ``of`` come before, and ``n``, how many the group has.

    rows: of, digits, last and copies (how many rows each stands for), none of them null. Order is by the digits, then ``last``.
    """
    hists, finer = [], rows
    for k in range(len(digits), -1, -1):
        finer = checkpointed(finer.groupBy(*of, *digits[:k]).agg(F.sum("copies").alias("copies")))
        hists.append(finer)
    starts = hists.pop().select(*of, F.lit(0).cast("long").alias("start"), F.col("copies").alias("n"))
    for k in range(1, len(digits) + 1):
        starts = _after(hists.pop(), starts, of + digits[: k - 1], digits[k - 1]).drop("copies")
    return _after(rows, starts, of + digits, last)


def _after(rows: DataFrame, starts: DataFrame, prefix: list[str], by: str) -> DataFrame:
    """``rows`` with the start of their prefix and what comes before them in it."""
    before = F.sum("copies").over(Window.partitionBy(*prefix).orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    met = rows.withColumn("before", F.coalesce(before, F.lit(0))).join(starts, prefix)
    return met.withColumn("start", F.col("start") + F.col("before")).drop("before")


class Trie:
    """The nodes over leaves (of, rank, n, digest and what else they carry): the ranks of a group run from 0 to n - 1.

    runs[l] holds the parents' runs at level l: (of, parent, digest, n, run), where run has the nodes of level l below a parent.
    """

    def __init__(self, leaves: DataFrame, of: list[str], fanout: int = FANOUT):
        self.leaves, self.of, self.fanout, self.runs = leaves, of, fanout, []
        most, nodes = leaves.agg(F.max("n")).first()[0] or 0, leaves
        while most > 1:
            extra = [c for c in nodes.columns if c not in (*of, "rank", "n", "digest")]
            grouped = nodes.where("n > 1").groupBy(*of, F.expr(f"rank div {fanout}").alias("parent"), "n")
            runs = grouped.agg(F.array_sort(F.collect_list(F.struct("rank", "digest", *extra))).alias("run"))
            runs = runs.withColumn("digest", F.sha2(F.array_join(F.col("run.digest"), "").cast("binary"), 256))
            self.runs.append(checkpointed(runs.withColumn("n", F.expr(f"(n + {fanout - 1}) div {fanout}"))))
            nodes, most = self.runs[-1].select(*of, F.col("parent").alias("rank"), "n", "digest"), -(-most // fanout)

    def subroots(self) -> DataFrame:
        """(of, digest) of each group."""
        found = self.leaves.where("n = 1").select(*self.of, "digest")
        for runs in self.runs:
            found = found.unionByName(runs.where("n = 1").select(*self.of, "digest"))
        return found

    def paths(self, tops: DataFrame) -> DataFrame:
        """The leaves with ``path`` and the other columns of ``tops`` (of, path, ...), which says how subroots go on.

        path has a struct (before, after) for each level from the leaf up: the digests of the other nodes of its run, joined.
        """
        of, with_path = self.of, [c for c in tops.columns if c not in self.of]
        heads = None
        for runs in reversed(self.runs):
            ends = runs.where("n = 1").select(*of, "parent").join(tops, of)
            heads = ends if heads is None else heads.unionByName(ends)
            each = runs.select(*of, "parent", F.col("run.digest").alias("members"), F.posexplode("run").alias("at", "node")).join(heads, [*of, "parent"])
            beside = F.struct(F.array_join(F.slice("members", F.lit(1), F.col("at")), "").alias("before"), F.array_join(F.slice("members", F.col("at") + 2, F.lit(self.fanout)), "").alias("after"))
            below = each.withColumn("path", F.concat(F.array(beside), "path")).select(*of, "node.*", *with_path)
            if runs is not self.runs[0]:
                heads = checkpointed(below.select(*of, F.col("rank").alias("parent"), *with_path))
        alone = self.leaves.where("n = 1").drop("n").join(tops, of)
        return below.unionByName(alone) if self.runs else alone


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda a, x: F.sha2(F.concat(x["before"], a, x["after"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all other nodes of the path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), "").cast("binary"), 256)


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", id_: str = "doc_id", carry: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """(id, group, rank, leaf, subroot, root, path, carried columns): one row for each row of ``docs``; other columns are not read.

    ``carry`` are columns to compute from a row beside its leaf; texts themselves go no further than their digest. The id is an
    integer. Null ids come first in a group, and a null group before all others. Rows of one id stand in order of their leaf;
    repeated rows each have a leaf, and which of them has which place makes no difference. An empty table gives no rows.
    """
    names = list(carry or {})
    key = F.coalesce(F.concat(F.lit("="), F.col(quoted(group)).cast("string")), F.lit("-"))
    rows = docs.select(F.col(quoted(id_)).alias("id"), key.alias("g"), leaf([F.col(quoted(c)) for c in columns]).alias("leaf"), *[c.alias(f"carry_{i}") for i, c in enumerate((carry or {}).values())])
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    digits = id_digits(F.col("id")) | {"leaf_digit": F.conv(F.substring("leaf", 1, 3), 16, 10).cast("int")}
    placed = ranked(checkpointed(rows.withColumns(digits)), ["g"], list(digits), "leaf")
    places = F.explode(F.sequence("start", F.col("start") + F.col("copies") - 1)).alias("rank")
    leaves = checkpointed(placed.select("g", places, "n", F.col("leaf").alias("digest"), "id", *[f"carry_{i}" for i in range(len(names))]))
    trie = Trie(leaves, ["g"], fanout)
    subroots = checkpointed(trie.subroots())
    prefix = lambda at: F.conv(F.rpad(F.substring(F.hex("g"), at, 4), 4, "0"), 16, 10).cast("int")
    groups = subroots.select(F.lit(0).alias("whole"), "g", F.col("digest").alias("subroot"), F.lit(1).cast("long").alias("copies"), prefix(1).alias("g0"), prefix(5).alias("g1"))
    of_groups = Trie(checkpointed(ranked(groups, ["whole"], ["g0", "g1"], "g").select("whole", F.col("start").alias("rank"), "n", F.col("subroot").alias("digest"), "g")), ["whole"], fanout)
    roots = of_groups.subroots().select("whole", F.col("digest").alias("root"), F.array().cast("array<struct<before:string,after:string>>").alias("path"))
    tops = checkpointed(of_groups.paths(roots).select("g", "path", F.col("digest").alias("subroot"), "root"))
    out = trie.paths(tops)
    named = [F.col(f"carry_{i}").alias(c) for i, c in enumerate(names)]
    return out.select("id", F.when(F.col("g") != "-", F.substring("g", 2, 1 << 30)).alias("group"), "rank", F.col("digest").alias("leaf"), "subroot", "root", "path", *named)


def verified(rows: DataFrame, claimed: str) -> DataFrame:
    """``manifest`` rows with ``folded_root``, recomputed from the leaf in column ``claimed``, and whether it is the root."""
    out = rows.withColumn("folded_root", fold(F.col(claimed), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
