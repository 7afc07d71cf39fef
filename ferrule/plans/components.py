"""Connected components of an edge table by alternating star contractions.

Each round links every node to the smallest node it has seen: first the
larger neighbours of a node, then the smaller ones.  The edge count never
grows, the number of rounds is logarithmic in practice, and all work is
aggregation and equi-joins, so a hub with millions of edges is only a skewed
join that adaptive execution splits.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .staging import drop_staged, staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, root)``: each node that has an edge, and the smallest node reachable from it.

    ``edges`` holds two columns of one orderable type; self-links and rows with
    a null end are ignored, repeats are harmless.
    """
    e = edges.where((F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, seen = staged(e, "cc"), None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (mark.n, mark.x) == seen or not mark.n:
            break
        seen = (mark.n, mark.x)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Staged, so that the join has a shuffle of its own on either side and a hub's rows can be split over tasks.
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc")
        wide = staged(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "cc")
        low = wide.groupBy("u").agg(F.min("v").alias("m"))
        tight = wide.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = staged(tight.union(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        for t in (now, least, wide):
            drop_staged(t)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", F.col("v").alias("r")).distinct())
