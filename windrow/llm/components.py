"""Connected components of a large graph by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import discard, written


def connected_components(edges: DataFrame) -> DataFrame:
    """v, root for every vertex of ``edges`` (a, b, whole numbers): equal roots, same component.

    Each round gives every vertex the neighbour that comes first in an order drawn anew by hash,
    follows such pointers two steps, and merges vertices with what they point to, so long paths
    and hubs both shrink by a fixed share a round. The rounds' pointers are composed backwards at
    the end. Edges are one row each and joined by vertex, never gathered.
    """
    current = written(edges.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    levels, turn = [], 0
    while current.limit(1).count():
        turn += 1
        def order(c):
            return F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("v"))
        ends = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = ends.groupBy(F.col("a").alias("v")).agg(F.min(order("b")).alias("best"))
        first = first.select("v", F.least("best", order("v"))["v"].alias("p"))
        first = written(first, "pointers")
        jump = first.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        pointers = written(first.join(jump, "p").select("v", F.col("pp").alias("p")), "pointers")
        discard(first)
        levels.append(pointers)
        for c in ("a", "b"):
            to = pointers.select(F.col("v").alias(c), F.col("p").alias(f"p{c}"))
            current = (current if c == "a" else moved).join(to, c)
            moved = current
        left = moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct()
        current = written(left, "edges")
    if not levels:
        return edges.select(F.col("a").alias("v"), F.col("a").alias("root")).limit(0)
    found = levels[-1].withColumnRenamed("p", "root")
    for pointers in reversed(levels[:-1]):
        up = found.select(F.col("v").alias("p"), "root")
        found = written(pointers.join(up, "p", "left").select("v", F.coalesce("root", "p").alias("root")), "roots")
    return found
