"""Clustering and diversity selection over distances.

The greedy algorithms select in a fixed order.  Leader is solved in parallel
rounds: an item all of whose earlier neighbours are settled is itself settled,
which gives the sequential result without a sequential pass.  Taylor-Butina
depends on counts that change with every choice, but only inside a connected
component, so each component is one task.  Spread keeps one distance per item
and updates all of them after each choice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ferrule.plans.components import connected_components
from ferrule.plans.staging import drop_staged, staged


def leader(items: DataFrame, edges: DataFrame, id_column: str = "id", order: str = "ord", max_rounds: int = 200) -> DataFrame:
    """Rows ``(id, leader, d)``: sphere exclusion in the order of ``order``, unique per item.

    ``edges``: (a, b, d), pairs within the threshold in either direction.  The
    first unselected item leads and takes all unselected ones within the
    threshold; leaders have d = 0.
    """
    o = items.select(F.col(id_column).alias("id"), F.col(order).alias("o"))
    both = edges.select("a", "b", "d").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).where("a <> b")
    oa, ob = o.select(F.col("id").alias("a"), F.col("o").alias("oa")), o.select(F.col("id").alias("b"), F.col("o").alias("ob"))
    # Each item with its earlier neighbours: the only ones that can take it.
    early = staged(both.join(oa, "a").join(ob, "b").where("ob < oa").select("a", "b", "d", "ob").distinct(), "early")
    # state: 1 leads, 0 taken; absent: open.
    first = o.join(early.select(F.col("a").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(1).alias("state"))
    done = staged(first, "leader")
    total = o.count()
    for _ in range(max_rounds):
        if done.count() == total:
            break
        known = early.join(done.select(F.col("id").alias("b"), "state"), "b", "left")
        open_ = known.join(done.select(F.col("id").alias("a")), "a", "left_anti")
        verdict = open_.groupBy("a").agg(F.max(F.coalesce("state", F.lit(0))).alias("hit"), F.sum(F.col("state").isNull().cast("int")).alias("waiting"))
        # A leading earlier neighbour takes the item at once; without one it leads when no neighbour is open.
        settled = verdict.where("hit = 1 or waiting = 0").select(F.col("a").alias("id"), (1 - F.col("hit")).alias("state"))
        after = staged(done.union(settled), "leader")
        drop_staged(done)
        done = after
    else:
        raise RuntimeError("leader did not settle")
    leaders = done.where("state = 1").select(F.col("id").alias("b"))
    taken = early.join(done.where("state = 0").select(F.col("id").alias("a")), "a").join(leaders, "b")
    pick = taken.groupBy("a").agg(F.min(F.struct("ob", "b", "d")).alias("p")).select(F.col("a").alias("id"), F.col("p.b").alias("leader"), F.col("p.d").alias("d"))
    return pick.union(done.where("state = 1").select("id", F.col("id").alias("leader"), F.lit(0.0).alias("d")))


def limit_clusters(clusters: DataFrame, most: int) -> DataFrame:
    """The first members of each cluster, nearest first."""
    return clusters.withColumn("__r", F.row_number().over(W.partitionBy("leader").orderBy("d", "id"))).where(F.col("__r") <= most).drop("__r")


def without_previous(items: DataFrame, to_previous: DataFrame, id_column: str = "id") -> DataFrame:
    """Items that no previously selected one is within the threshold of; ``to_previous`` has their ids as ``a``."""
    return items.join(to_previous.select(F.col("a").alias(id_column)).distinct(), id_column, "left_anti")


def single_linkage(items: DataFrame, edges: DataFrame, id_column: str = "id") -> DataFrame:
    """Rows ``(id, cluster)``: components of the threshold graph, named by their least item."""
    roots = connected_components(edges)
    return items.select(F.col(id_column).alias("id")).join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))


def _butina(frame: pd.DataFrame) -> pd.DataFrame:
    """Greedy choice within one component: (a, b, d, oa), both directions."""
    near: dict = {}
    order: dict = {}
    for a, b, d, oa in frame.itertuples(index=False):
        order[a] = oa
        if b is not None and b == b:
            near.setdefault(a, {})[b] = d
    left, out = set(order), []
    count = {x: len(near.get(x, {})) for x in order}
    while left:
        best = min(left, key=lambda x: (-count[x], order[x]))
        members = [x for x in near.get(best, {}) if x in left]
        out.append((best, best, 0.0))
        out += [(x, best, near[best][x]) for x in members]
        for x in [best, *members]:
            left.discard(x)
            for y in near.get(x, {}):
                count[y] -= 1
    return pd.DataFrame(out, columns=["id", "leader", "d"])


def taylor_butina(items: DataFrame, edges: DataFrame, id_column: str = "id", order: str = "ord") -> DataFrame:
    """Rows ``(id, leader, d)``: again and again the item with most unselected neighbours, ties by order.

    One task holds the edges of a connected component of the threshold graph.
    """
    kind = items.schema[id_column].dataType.simpleString()
    o = items.select(F.col(id_column).alias("id"), F.col(order).cast("long").alias("o"))
    both = edges.select("a", "b", "d").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).where("a <> b").groupBy("a", "b").agg(F.min("d").alias("d"))
    roots = connected_components(edges)
    rows = both.join(roots.withColumnRenamed("node", "a"), "a").join(o.select(F.col("id").alias("a"), F.col("o").alias("oa")), "a")
    clustered = rows.groupBy("root").applyInPandas(lambda f: _butina(f[["a", "b", "d", "oa"]]), f"id {kind}, leader {kind}, d double")
    alone = o.join(roots.select(F.col("node").alias("id")), "id", "left_anti")
    return clustered.union(alone.select("id", F.col("id").alias("leader"), F.lit(0.0).alias("d")))


def jarvis_patrick(items: DataFrame, near: DataFrame, n: int, shared: int, id_column: str = "id") -> DataFrame:
    """Rows ``(id, cluster)``: items are merged if their first ``n`` neighbours have ``shared`` in common.

    ``near``: (needle, hay, rank)."""
    head = near.where(F.col("rank") <= n).select(F.col("needle").alias("id"), "hay")
    pairs = head.withColumnRenamed("id", "a").join(head.withColumnRenamed("id", "b"), "hay").where("a < b")
    return single_linkage(items, pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= shared).select("a", "b"), id_column)


def spread(items: DataFrame, distance: Callable[[Column], Column], point: str, n: int, id_column: str = "id", order: str = "ord", scale: str | None = None, stop_below: float | None = None, previous: DataFrame | None = None, every: int = 8) -> DataFrame:
    """Rows ``(pick, id, nearest, d)``: max-min diversity.

    Begins with the first item by ``order``, or with the one furthest from
    ``previous`` (same columns); then always takes the item whose scaled
    distance to the nearest selected one is largest, ties by order.
    ``distance`` gives the distance of column ``point`` to a literal point.
    Each pick is one pass over the items; the state is staged every few picks.
    """
    spark = items.sparkSession
    s = F.col(scale) if scale else F.lit(1.0)
    state = items.select(F.col(id_column).alias("id"), F.col(order).alias("o"), F.col(point).alias("p"), s.cast("double").alias("s"), F.lit(None).cast("double").alias("d"), F.lit(None).cast(items.schema[id_column].dataType).alias("nearest"))

    def update(state: DataFrame, who, where) -> DataFrame:
        d = distance(F.lit(where))
        closer = F.col("d").isNull() | (d < F.col("d"))
        return state.select("id", "o", "p", "s", F.when(closer, d).otherwise(F.col("d")).alias("d"), F.when(closer, F.lit(who)).otherwise(F.col("nearest")).alias("nearest"))

    if previous is not None:
        for r in previous.select(id_column, point).collect():  # the caller's own selection
            state = update(state, r[0], r[1])
    state, picks = staged(state, "spread"), []
    for k in range(n):
        far = F.when(F.col("d").isNull(), F.lit(float("inf"))).otherwise(F.col("d") * F.col("s"))
        best = state.select("id", "o", "p", "d", "nearest", far.alias("f")).orderBy(F.desc("f"), "o").limit(1).collect()
        if not best or (stop_below is not None and best[0].d is not None and best[0].f < stop_below):
            break
        b = best[0]
        picks.append((k, b.id, b.nearest, b.d))
        state = update(state.where(F.col("id") != F.lit(b.id)), b.id, b.p)
        if k % every == every - 1:
            state = staged(state, "spread")
    kind = items.schema[id_column].dataType.simpleString()
    return spark.createDataFrame(picks, f"pick int, id {kind}, nearest {kind}, d double")


def leader_thresholds(items: DataFrame, edges: DataFrame, thresholds: Sequence[float], id_column: str = "id", order: str = "ord") -> DataFrame:
    """Rows (threshold, id, leader, d): sphere exclusion at several thresholds over edges made for the largest."""
    out = None
    for t in thresholds:
        part = leader(items, edges.where(F.col("d") <= t), id_column, order).withColumn("threshold", F.lit(float(t)))
        out = part if out is None else out.unionByName(part)
    return out.select("threshold", "id", "leader", "d")


def spread_buckets(items: DataFrame, distance: Callable[[Column], Column], point: str, bucket: str, n: int, least: float = 0.5, id_column: str = "id", order: str = "ord") -> DataFrame:
    """Rows (pick, id, bucket, d): as ``spread``, the distance lowered by how many of the bucket are taken already."""
    spark = items.sparkSession
    buckets = items.select(bucket).distinct().count()
    state = staged(items.select(F.col(id_column).alias("id"), F.col(order).alias("o"), F.col(point).alias("p"), F.col(bucket).cast("string").alias("b"), F.lit(None).cast("double").alias("d")), "spread")
    taken: dict[str, int] = {}
    picks = []
    for k in range(n):
        blocked = F.lit(0)
        for name, count in taken.items():
            blocked = F.when(F.col("b") == name, F.lit(min(count, buckets))).otherwise(blocked)
        far = F.when(F.col("d").isNull(), F.lit(float("inf"))).otherwise(bucket_penalty(F.col("d"), blocked, buckets, least))
        best = state.select("id", "o", "p", "b", "d", far.alias("f")).orderBy(F.desc("f"), "o").limit(1).collect()
        if not best:
            break
        x = best[0]
        picks.append((k, x.id, x.b, x.d))
        taken[x.b] = taken.get(x.b, 0) + 1
        d = distance(F.lit(x.p))
        state = state.where(F.col("id") != F.lit(x.id)).withColumn("d", F.least(F.coalesce("d", d), d))
        if k % 8 == 7:
            state = staged(state, "spread")
    kind = items.schema[id_column].dataType.simpleString()
    return spark.createDataFrame(picks, f"pick int, id {kind}, bucket string, d double")


def bucket_penalty(d: Column, blocked: Column, buckets: int, least: float) -> Column:
    """A distance lowered for an item in whose bucket many are selected: d (f + (1-f)/n (n - blocked))."""
    return d * (least + (1 - least) / buckets * (buckets - blocked))


def cluster_table(clusters: DataFrame) -> DataFrame:
    """Rows ``(leader, size, members)``: members nearest first."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("d", "id"))), lambda x: x["id"])
    return clusters.groupBy("leader").agg(F.count(F.lit(1)).alias("size"), members.alias("members"))
