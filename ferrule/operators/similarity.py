"""Similarity joins over sparse counted fingerprints in long form (id, bit, cnt).

A bounded set of needles is held by every task and meets the haystack's
records where they are; more needles meet them through an inverted index: an
equi-join on bits, then a sum per pair.  Joins with a distance threshold first
order bits by rarity; two fingerprints within the threshold share a bit among
the rarest few of each, so only those prefixes are joined and frequent bits
never are.  Candidates are then measured in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ferrule.plans.ranking import ranked
from ferrule.plans.staging import staged

from .bags import bags_of, pairs_within


def sizes(fp: DataFrame) -> DataFrame:
    return fp.groupBy("id").agg(F.sum("cnt").cast("long").alias("n"))


def _distance(bic: Column, na: Column, nb: Column) -> Column:
    return 1 - bic / (na + nb - bic)


def pair_distances(needles: DataFrame, haystack: DataFrame, same: bool = False) -> DataFrame:
    """Rows ``(needle, hay, d)`` of all pairs that share a bit.  ``same``: one file, each pair once, needle < hay."""
    a = needles.select(F.col("id").alias("needle"), "bit", F.col("cnt").alias("c1"))
    b = haystack.select(F.col("id").alias("hay"), "bit", F.col("cnt").alias("c2"))
    both = a.join(b, "bit")
    if same:
        both = both.where("needle < hay")
    bic = both.groupBy("needle", "hay").agg(F.sum(F.least("c1", "c2")).alias("bic"))
    na = sizes(needles).select(F.col("id").alias("needle"), F.col("n").alias("na"))
    nb = sizes(haystack).select(F.col("id").alias("hay"), F.col("n").alias("nb"))
    return bic.join(na, "needle").join(nb, "hay").select("needle", "hay", _distance(F.col("bic"), F.col("na"), F.col("nb")).alias("d"))


#: Rows of a needle table that every task may hold; more needles go through the inverted index.
NEEDLE_ROWS = 1 << 18


class _Needles:
    """Counted needles by bit, to be met by many records at once."""

    def __init__(self, rows: pd.DataFrame):
        self.ids, owner = np.unique(rows["id"].to_numpy(), return_inverse=True)
        cnt = rows["cnt"].to_numpy(np.int64)
        self.n = np.bincount(owner, cnt, len(self.ids))
        order = np.argsort(rows["bit"].to_numpy(np.int64), kind="stable")
        bits = rows["bit"].to_numpy(np.int64)[order]
        self.owner, self.cnt = owner[order], cnt[order]
        self.bits, self.start = np.unique(bits, return_index=True)
        self.size = np.diff(np.append(self.start, len(bits)))

    def common(self, record: np.ndarray, bit: np.ndarray, cnt: np.ndarray, records: int) -> np.ndarray:
        """Sums of lesser counts, records x needles, of records given as rows."""
        place = np.searchsorted(self.bits, bit)
        ok = place < len(self.bits)
        ok[ok] = self.bits[place[ok]] == bit[ok]
        record, place, cnt = record[ok], place[ok], cnt[ok]
        size = self.size[place]
        post = np.repeat(self.start[place] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        key = np.repeat(record, size) * len(self.ids) + self.owner[post]
        return np.bincount(key, np.minimum(np.repeat(cnt, size), self.cnt[post]), records * len(self.ids)).reshape(records, -1)


def _met(needles: DataFrame, haystack: DataFrame, pick: Callable[[np.ndarray], np.ndarray]) -> DataFrame | None:
    """Rows ``(needle, hay, d)`` that ``pick`` marks in each block of distances (records x needles; 1 where no bit is
    shared, rows in order of hay id).  None if there are too many needles to hold."""
    rows = needles.select("id", "bit", "cnt").limit(NEEDLE_ROWS + 1).toPandas()
    if len(rows) > NEEDLE_ROWS:
        return None
    known = _Needles(rows)
    block = max(1, (1 << 21) // max(1, len(known.ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                b = batch.slice(at, block)
                hay = b.column(0).to_numpy(zero_copy_only=False)
                order = np.argsort(hay, kind="stable")
                per = np.diff(b.column(2).offsets.to_numpy())
                record = np.repeat(np.arange(b.num_rows), per)
                cells = b.column(2).flatten()
                c = known.common(record, cells.field("bit").to_numpy(), cells.field("cnt").to_numpy().astype(np.int64), b.num_rows)
                n = b.column(1).to_numpy(zero_copy_only=False)
                d = np.where(c > 0, 1 - c / (n[:, None] + known.n[None, :] - c), np.inf)[order]
                r, k = np.nonzero(pick(d) & np.isfinite(d))
                yield pa.record_batch([pa.array(known.ids[k]), pa.array(hay[order][r]), pa.array(d[r, k])], ["needle", "hay", "d"])

    kinds = [x.schema["id"].dataType.simpleString() for x in (needles, haystack)]
    # Only the bits of needles leave the records' own rows.
    bits = F.broadcast(needles.select("bit", F.lit(True).alias("wanted")).distinct())
    cell = F.when(F.col("wanted"), F.struct("bit", "cnt"))
    records = haystack.join(bits, "bit", "left").groupBy("id").agg(F.sum("cnt").cast("long").alias("n"), F.collect_list(cell).alias("cells"))
    return records.mapInArrow(run, f"needle {kinds[0]}, hay {kinds[1]}, d double")


def closest(needles: DataFrame, haystack: DataFrame, k: int, lower: float = -1.0, upper: float = 2.0, least: int = 0) -> DataFrame:
    """Rows ``(needle, hay, d)`` among which are the ``k`` nearest per needle with lower < d < upper, and the ``least``
    nearest of all.  Each block of records keeps its own nearest, so few rows are shuffled."""

    def few(d: np.ndarray, most: int) -> np.ndarray:
        if most >= len(d):
            return np.isfinite(d)
        nth = np.partition(d, most - 1, axis=0)[most - 1]
        return d <= nth  # ties stay

    def pick(d: np.ndarray) -> np.ndarray:
        out = few(np.where((d > lower) & (d < upper), d, np.inf), k)
        out &= (d > lower) & (d < upper)
        return out | few(d, least) if least else out

    got = _met(needles, haystack, pick)
    return pair_distances(needles, haystack) if got is None else got


def nearest(pairs: DataFrame, k: int, lower: float = -1.0, upper: float = 2.0, no_self: bool = False) -> DataFrame:
    """The ``k`` nearest per needle with lower < d < upper, ties by hay id; ``no_self`` skips a needle's own zero."""
    rows = pairs.where((F.col("d") > lower) & (F.col("d") < upper))
    if no_self:
        rows = rows.where(~((F.col("d") == 0) & (F.col("needle") == F.col("hay"))))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("needle").orderBy("d", "hay"))).where(F.col("rank") <= k)


def nearest_at_least(pairs: DataFrame, k: int, least: int, lower: float = -1.0, upper: float = 2.0) -> DataFrame:
    """As ``nearest``; a needle with fewer than ``least`` in the window takes its nearest ``least`` regardless of it."""
    inside = (F.col("d") > lower) & (F.col("d") < upper)
    w = W.partitionBy("needle")
    rows = pairs.withColumn("inside", inside).withColumn("n", F.sum(inside.cast("int")).over(w))
    rows = rows.withColumn("rank", F.row_number().over(w.orderBy(F.when((F.col("n") >= least) & ~F.col("inside"), 1).otherwise(0), "d", "hay")))
    return rows.where(F.when(F.col("n") >= least, F.col("inside") & (F.col("rank") <= k)).otherwise(F.col("rank") <= least)).select("needle", "hay", "d", "rank")


def coded(fp: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """Each fingerprint table as staged rows ``(id, n, codes)``: sets of 64-bit codes in place of counted bits.

    The k-th copy of a bit is a code of its own, so that common codes of two
    records are the sum of their lesser counts.  Codes sort by the rarity of
    their bit over all tables given.  Up to 2^32 distinct bits.
    """
    every = [x.select("id", "bit", "cnt") for x in (fp, *others)]
    both = every[0]
    for x in every[1:]:
        both = both.union(x)
    counts = both.groupBy("bit").agg(F.count(F.lit(1)).alias("df"))
    place = staged(ranked(counts, [], ["df", "bit"]).select("bit", "rank"), "rarity")
    # Later copies are rarer than the first and come first.
    copy = F.shiftleft("rank", 31).bitwiseOR
    codes = F.transform(F.sequence(F.lit(1), F.col("cnt")), lambda k: copy(F.lit((1 << 31) - 1) - k.cast("long")))
    out = []
    for x in every:
        rows = x.join(place, "bit").groupBy("id").agg(F.array_sort(F.flatten(F.collect_list(codes))).alias("codes"))
        out.append(staged(rows.select("id", F.size("codes").cast("long").alias("n"), "codes"), "coded"))
    return out


def within(fp: DataFrame, threshold: float, other: DataFrame | None = None) -> DataFrame:
    """Rows ``(a, b, d)`` with d <= threshold < 1, exact: pairs of ``fp`` once each (a < b), or of ``fp`` and ``other``.

    A pair at this distance shares at least t n codes of each side, t = 1 -
    threshold.  It thus shares one among the first n - ceil(t n) + 1 codes of
    each, the rarest ones, and the first that it shares lies early enough in
    both for the rest to reach the overlap.  Only such pairs are compared, by
    an intersection of code sets.  Pairs of one table are found in ``bags``.
    """
    if not 0 <= threshold < 1:
        raise ValueError("the threshold must be below 1")
    if other is None:
        return pairs_within(staged(bags_of(fp), "bags"), threshold)
    t = 1.0 - threshold
    left, right = coded(fp, other)

    def prefix(x: DataFrame, key: str, n: str, at: str) -> DataFrame:
        long_enough = (F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1).cast("int")
        return x.select(F.col("id").alias(key), F.col("n").alias(n), F.posexplode(F.slice("codes", 1, long_enough)).alias(at, "code"))

    cand = prefix(left, "a", "na", "ia").join(prefix(right, "b", "nb", "ib"), "code")
    least = t / (1 + t) * (F.col("na") + F.col("nb")) - 1e-9
    cand = cand.where((F.least("na", "nb") >= t * F.greatest("na", "nb") - 1e-9) & (F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= least))
    cand = cand.select("a", "b").distinct()
    both = cand.join(left.toDF("a", "na", "ca"), "a").join(right.toDF("b", "nb", "cb"), "b")
    common = F.size(F.array_intersect("ca", "cb"))
    return both.select("a", "b", _distance(common, F.col("na"), F.col("nb")).alias("d")).where(F.col("d") <= threshold + 1e-12)


def distance_filter(fp: DataFrame, pool: DataFrame, too_close: float, at_least: int = 1, ignore_zero: bool = False) -> DataFrame:
    """Per record of ``fp``: id, n_close (pool members with d < too_close), nearest, rejected (n_close >= at_least)."""
    near = within(fp, too_close, pool).where(F.col("d") < too_close)
    if ignore_zero:
        near = near.where("d > 0")
    hits = near.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_close"), F.min("d").alias("nearest"))
    out = fp.select("id").distinct().join(hits, "id", "left")
    return out.select("id", F.coalesce("n_close", F.lit(0)).cast("long").alias("n_close"), "nearest", (F.coalesce("n_close", F.lit(0)) >= at_least).alias("rejected"))


def near_any(needles: DataFrame, haystack: DataFrame, threshold: float) -> DataFrame:
    """Needles within a distance of any member of the haystack."""
    return needles.select("id").distinct().join(within(needles, threshold, haystack).select(F.col("a").alias("id")).distinct(), "id", "left_semi")


def nearest_needle(needles: DataFrame, haystack: DataFrame) -> DataFrame:
    """Rows (id, needle, d): the needle nearest to each haystack member, ties by needle; null where none shares a bit."""
    met = _met(needles, haystack, lambda d: d <= d.min(axis=1, initial=np.inf)[:, None])
    met = pair_distances(needles, haystack) if met is None else met
    best = met.groupBy(F.col("hay").alias("id")).agg(F.min(F.struct("d", "needle")).alias("b"))
    return haystack.select("id").distinct().join(best, "id", "left").select("id", F.col("b.needle").alias("needle"), F.col("b.d").alias("d"))


def listed_pairs(pairs: DataFrame, maps: DataFrame, metric: Column, most: float | None = None) -> DataFrame:
    """Distance of each listed pair (id1, id2), both looked up in ``maps`` (id, fp); pairs beyond ``most`` or with an
    unknown id go.  ``metric`` is a similarity of columns a and b."""
    a, b = maps.select(F.col("id").alias("id1"), F.col("fp").alias("a")), maps.select(F.col("id").alias("id2"), F.col("fp").alias("b"))
    out = pairs.join(a, "id1").join(b, "id2").select("id1", "id2", (1 - metric).alias("d"))
    return out if most is None else out.where(F.col("d") <= most)


def natoms_window(df: DataFrame, n1: Column, n2: Column, width: int) -> DataFrame:
    """Only pairs whose sizes differ by at most ``width``."""
    return df.where(F.abs(n1 - n2) <= width)


def neighbour_lists(near: DataFrame) -> DataFrame:
    """Rows ``(id, n, neighbours array<struct<d,id>>)`` of (needle, hay, d), nearest first."""
    return near.groupBy(F.col("needle").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("d", F.col("hay").alias("id")))).alias("neighbours"))


def trim_lists(lists: DataFrame, most: int | None = None, min_distance: float | None = None, max_distance: float | None = None, least: int = 0) -> DataFrame:
    """Neighbour lists cut to a number and a distance range; lists shorter than ``least`` go."""
    n = F.col("neighbours")
    if min_distance is not None:
        n = F.filter(n, lambda x: x["d"] >= min_distance)
    if max_distance is not None:
        n = F.filter(n, lambda x: x["d"] <= max_distance)
    if most is not None:
        n = F.slice(n, 1, most)
    return lists.withColumn("neighbours", n).withColumn("n", F.size("neighbours").cast("long")).where(F.col("n") >= least)


def three_columns(lists: DataFrame) -> DataFrame:
    """Rows ``(id1, id2, d)`` of neighbour lists."""
    return lists.select(F.col("id").alias("id1"), F.explode("neighbours").alias("x")).select("id1", F.col("x.id").alias("id2"), F.col("x.d").alias("d"))


def nearest_histogram(lists: DataFrame, dx: float = 0.1) -> DataFrame:
    """Rows ``(bucket, n)`` of the distance to the nearest neighbour."""
    return lists.where("n > 0").groupBy(F.floor(F.element_at("neighbours", 1)["d"] / dx + 1e-9).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
