"""Mixing sources to target weights by hash-threshold histograms.

The mix takes every document of a source floor(target / size) times and one
more copy of those whose hash lies under the source's threshold.  Thresholds
come from histograms of words by source and hash bucket: the bucket in which
the running sum passes the budget is found, only that bucket is split into
finer buckets, and so on down to single hash values.  What budget is left
under the document at the threshold goes to nested thresholds over the
smaller documents above it, and the rest to the one whose size is nearest.
No documents are sorted, and a rerun takes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ferrule.plans.ranking import ranked
from ferrule.plans.staging import drop_staged, staged

from .common import utf8

#: Bits of the hash that one histogram resolves, and how many refinements follow: 63 bits in all.
LEVEL_BITS = (12, 17, 17, 17)
NESTED = 3


def _hash() -> F.Column:
    """63 hash bits of doc_id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), 1)


def sizes(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, source, size, h)``: words of each text (null: 0) and 63 hash bits of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([len(t.split()) for t in utf8(b.column(3))], pa.int64())
            yield pa.record_batch([b.column(0), b.column(1), n, b.column(2)], ["doc_id", "source", "size", "h"])

    text = F.col("text").cast("string")
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _hash().alias("h"), text.alias("text"))
    return cols.mapInArrow(run, "doc_id long, source string, size long, h long")


def _threshold(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source k with a budget: ``cut``, such that documents with h < cut hold at most the budget, and ``left``, what they leave of it."""
    state = budgets.select("k", F.lit(0).cast("long").alias("low"), F.col("budget").alias("left"))
    shift = sum(LEVEL_BITS)
    running = W.partitionBy("k").orderBy("bucket")
    for bits in LEVEL_BITS:
        shift -= bits
        inside = docs.select("k", "h", "size").join(state, "k").where(F.shiftright("h", shift + bits) == F.shiftright("low", shift + bits))
        hist = inside.groupBy("k", "low", "left", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        seen = hist.withColumn("upto", F.sum("n").over(running))
        fits = F.col("upto") <= F.col("left")
        under = seen.groupBy("k", "low", "left").agg(F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("under"), F.min(F.when(~fits, F.col("bucket"))).alias("edge"))
        # Without an edge all that is inside fits: low is null from then on.
        after = under.select("k", F.shiftleft("edge", shift).alias("low"), (F.col("left") - F.col("under")).alias("left"))
        state = staged(after.union(state.where("low is null")), "cut")
    return state.select("k", F.coalesce("low", F.lit((1 << 63) - 1)).alias("cut"), "left")


def source_targets(sized: DataFrame, most: int, cycle: Sequence[float]) -> DataFrame:
    """One row per source, staged: k (its place by code point, null last), s, source_size, target, whole, rest.

    The sum of all sizes is shared by weight; no target is above ``most`` times
    its source's size, and the excess is reshared until none is.  Sources stay
    in a table: a round sums over those still free, and those it fills are full."""
    per = sized.groupBy(F.col("source").alias("s")).agg(F.sum("size").alias("source_size"))
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    placed = ranked(per, [], [F.asc_nulls_last("s")]).withColumn("k", F.col("rank") - 1)
    own = F.element_at(weights, (F.col("k") % len(cycle) + 1).cast("int"))
    rows = staged(placed.select("k", "s", "source_size", own.alias("weight"), F.lit(False).alias("full")), "sources")
    top = F.lit(most) * F.col("source_size")
    while True:
        free = F.when(~F.col("full"), F.col("weight"))
        sums = rows.agg(F.sum(free).alias("w"), F.sum("source_size").alias("all"), F.sum(F.when(F.col("full"), top)).alias("taken"), F.sum(F.col("full").cast("int")).alias("n")).first()
        unit = (float(sums["all"]) - float(sums["taken"] or 0)) / sums["w"] if sums["w"] else 0.0
        filled = F.col("full") | (F.col("weight") * unit > top)
        after = staged(rows.withColumn("full", filled), "sources")
        drop_staged(rows)
        rows = after
        if rows.where("full").count() == (sums["n"] or 0):
            break
    target = F.when(F.col("full"), top.cast("double")).otherwise(F.col("weight") * unit)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(target / F.col("source_size")))).otherwise(0).cast("int")
    out = rows.select("k", "s", "source_size", target.alias("target"), whole.alias("whole"))
    return staged(out.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets")


def plan_mix(sized: DataFrame, most: int, cycle: Sequence[float]) -> DataFrame:
    """One row per source: s, source_size, target, whole, and of each nested level cut and left."""
    sources = source_targets(sized, most, cycle)
    known = sized.where("size > 0").join(sources.select("k", "s"), F.col("source").eqNullSafe(F.col("s"))).select("k", "h", "size")
    rest = known
    budgets = sources.where("rest >= 1 and source_size > 0").select("k", F.col("rest").alias("budget"))
    out = sources
    for level in range(NESTED):
        found = _threshold(rest, budgets)
        out = out.join(found.select("k", F.col("cut").alias(f"cut{level}"), F.col("left").alias(f"left{level}")), "k", "left")
        budgets = found.where("left >= 1").select("k", F.col("left").alias("budget"))
        rest = rest.join(found, "k").where("h >= cut and size <= left").drop("cut", "left")
    out = staged(out, "levels")
    # What is left goes to the one hash above the thresholds whose words come nearest to it, if that is nearer than none.
    short = F.least(*[F.coalesce(F.col(f"left{i}"), F.lit(float("inf"))) for i in range(NESTED)])
    spare = known.join(out, "k").where((copies(most) == F.col("whole")) & (F.col("whole") < most) & (F.col("rest") >= 1))
    # Rows of one hash are copies of one size, so a size that is too large rules out its whole group before the shuffle.
    spare = spare.where(F.col("size") < 2 * short).groupBy("k", "h", short.alias("short")).agg(F.sum("size").alias("words")).where(F.col("words") < 2 * F.col("short"))
    pick = spare.groupBy("k").agg(F.min(F.struct(F.abs(F.col("words") - F.col("short")).alias("off"), "h"))["h"].alias("last"))
    return staged(out.join(pick, "k", "left").drop("k", "rest"), "mixplan")


def copies(most: int, with_last: bool = False) -> F.Column:
    """How often a row with ``size`` and ``h`` beside its source's plan is taken."""
    take, outside = F.lit(False), F.lit(True)
    for level in range(NESTED):
        outside = outside & (F.col("size") <= F.col(f"left{level - 1}")) if level else outside
        under = F.coalesce(outside & (F.col("h") < F.col(f"cut{level}")), F.lit(False))
        take, outside = take | under, outside & ~under
    if with_last:
        take = take | F.coalesce(F.col("h") == F.col("last"), F.lit(False))
    return (F.col("whole") + F.when(take & (F.col("size") > 0) & (F.col("whole") < most), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, most: int = 3, cycle: Sequence[float] = (1, 2, 3)) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, taken (words, repeats counted), copies.

    Sources in code-point order, null last, weigh ``cycle`` over and over and
    share the words of all documents; a null text has size 0.  Targets stop at
    ``most`` times a source's size.  A source's taken words differ from its
    target by less than one document that is left out.  Rows repeating doc_id
    and text, or without a doc_id and of one text, share a hash and are taken
    together.  An empty table gives no rows.
    """
    sized = staged(sizes(docs), "sizes")
    out = sized.join(plan_mix(sized, most, cycle), F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", copies(most, True))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, most: int = 3, cycle: Sequence[float] = (1, 2, 3)) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    A row's copies follow from its source's plan, its hash and its size, so
    texts are not shuffled."""
    plan = plan_mix(staged(sizes(docs), "sizes"), most, cycle)

    @F.pandas_udf("long")
    def count(text: pd.Series) -> pd.Series:
        return pd.Series([len(x.encode().split()) if x else 0 for x in text], dtype="int64")

    named = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("source"), _hash().alias("h"), count(F.col("text").cast("string")).alias("size"))
    out = named.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", copies(most, True)).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
