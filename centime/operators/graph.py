"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node that can be reached.

    Large-star and small-star rounds in turn, until every node points at its root. A round sends each edge a bounded number
    of times whatever the degrees are. The least neighbour of each node is written apart from the neighbour lists, so that the
    join of the two has plain exchanges on both sides and adaptive execution can split a node that has very many neighbours.
    Null ends, loops and repeated edges are dropped. No edges: no rows.
    """
    pairs = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct())
    for _ in range(most_rounds):
        both = pairs.union(pairs.select("b", "a").toDF("a", "b"))
        large = _star(both, "b > a")
        small = _star(large, "true", with_self=True)
        pairs = checkpointed(small)
        if _settled(pairs):
            return pairs.toDF("node", "root").union(pairs.select("b", "b").distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _settled(pairs: DataFrame) -> bool:
    """Whether every node points at one other at most, and those that are pointed at point at none."""
    ends = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))))
    of = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return of.where("up > 1 or up = 1 and least = 0").agg(F.count("*")).first()[0] == 0


def _star(pairs: DataFrame, keep: str, with_self: bool = False) -> DataFrame:
    """Point the neighbours b of each a (those that ``keep`` admits) at the least node among a and all its neighbours."""
    least = checkpointed(pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
    moved = pairs.join(least, "a").where(keep).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if with_self:
        moved = moved.union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
