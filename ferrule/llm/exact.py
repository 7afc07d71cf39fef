"""Exact dedup over counting quotient filters.

Every partition hashes its normalised texts to 64 bits and packs the sorted
fingerprints into counting quotient filters: a fingerprint's high bits are its
quotient and give its run, its low bits are the stored remainder, and each
slot has a counter.  Filters of one quotient range meet in one task and merge
without loss, since quotient and remainder are the whole fingerprint.  A
fingerprint counted once proves its text unique; the others are only
candidates, and their texts are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ferrule.plans.bitmap import only_keys
from ferrule.plans.staging import staged

from .common import ascii_lower, one_row_per_text, utf8

#: Rows that one merged filter counts on average: 16 MB of fingerprints and counts, and few, large filters to a partition.
RANGE_ROWS = 1 << 20
#: The seed of Spark's own xxhash64, so that both sides hash alike.
SEED = 42


@dataclass
class CountingQuotientFilter:
    """A canonical (sorted, run-packed) counting quotient filter of distinct ``bits``-bit values.

    ``occupied``: bit per quotient that has a run; ``run_ends``: bit per slot
    that ends a run; ``remainders`` and ``counts``: one entry per slot.
    """

    bits: int
    q: int
    occupied: np.ndarray
    run_ends: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """``values``: sorted distinct uint64 below 2**bits."""
        q = min(bits, max(1, int(len(values)).bit_length()))
        shift = np.uint64(bits - q)
        quotient = values >> shift
        ends = np.append(quotient[1:] != quotient[:-1], True) if len(values) else np.zeros(0, bool)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient.astype(np.int64)] = True
        low = values & np.uint64((1 << (bits - q)) - 1)
        return cls(bits, q, np.packbits(occupied), np.packbits(ends), low, counts.astype(np.int64))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The values, sorted, and their counts."""
        n = len(self.remainders)
        ends = np.unpackbits(self.run_ends, count=n).astype(np.int64)
        runs = np.flatnonzero(np.unpackbits(self.occupied, count=1 << self.q)).astype(np.uint64)
        quotient = runs[np.cumsum(ends) - ends]
        return (quotient << np.uint64(self.bits - self.q)) | self.remainders, self.counts

    def pack(self) -> tuple[int, bytes, bytes, bytes, bytes]:
        width = max(1, (self.bits - self.q + 7) // 8)
        low = np.ascontiguousarray(self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
        many = np.flatnonzero(self.counts > 1)
        return self.q, self.occupied.tobytes(), self.run_ends.tobytes(), low.tobytes(), np.stack([many, self.counts[many]]).astype("<i8").tobytes()

    @classmethod
    def unpack(cls, bits: int, q: int, occupied: bytes, run_ends: bytes, low: bytes, many: bytes) -> CountingQuotientFilter:
        width = max(1, (bits - q + 7) // 8)
        part = np.frombuffer(low, np.uint8).reshape(-1, width)
        full = np.zeros((len(part), 8), np.uint8)
        full[:, :width] = part
        counts = np.ones(len(part), np.int64)
        at, n = np.frombuffer(many, "<i8").reshape(2, -1)
        counts[at] = n
        return cls(bits, q, np.frombuffer(occupied, np.uint8), np.frombuffer(run_ends, np.uint8), full.view("<u8").ravel(), counts)


Run = tuple[np.ndarray, np.ndarray]


def _merge_two(a: Run, b: Run) -> Run:
    """Two sorted runs of (value, count) as one: every entry's place is its own plus that among the other run's."""
    (v1, c1), (v2, c2) = a, b
    at1 = np.arange(len(v1)) + np.searchsorted(v2, v1, "left")
    at2 = np.arange(len(v2)) + np.searchsorted(v1, v2, "right")
    v, c = np.empty(len(v1) + len(v2), np.uint64), np.empty(len(v1) + len(v2), np.int64)
    v[at1], v[at2], c[at1], c[at2] = v1, v2, c1, c2
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
    return v[first], np.add.reduceat(c, first) if len(v) else c


def merge_runs(runs: list[Run]) -> Run:
    """Sorted runs merged in pairs, smallest first; counts of equal values add up."""
    heap = [(len(r[0]), i, r) for i, r in enumerate(runs)]
    heapify(heap)
    while len(heap) > 1:
        _, i, a = heappop(heap)
        _, _, b = heappop(heap)
        out = _merge_two(a, b)
        heappush(heap, (len(out[0]), i, out))
    return heap[0][2]


def merge(filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
    """The filter of all their values, counts added.  Runs of remainders are sorted, and stay so: nothing is sorted again."""
    values, counts = merge_runs([f.items() for f in filters])
    return CountingQuotientFilter.build(values, counts, filters[0].bits)


def digests(docs: DataFrame, width: int = 64) -> DataFrame:
    """Per row: doc_id, fp (the text's ``width``-bit fingerprint as a long), sha (SHA-256 of the normalised text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = [t.lower() for t in utf8(b.column(1))]
            fp = np.fromiter((xxhash.xxh64_intdigest(t, SEED) >> (64 - width) for t in low), np.uint64, len(low))
            sha = pa.array([hashlib.sha256(t).digest() for t in low], pa.binary())
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64)), sha], ["doc_id", "fp", "sha"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long, sha binary")


def repeated_fingerprints(marks: DataFrame, rows: int, width: int = 64) -> DataFrame:
    """Column ``fp``: the values of ``marks.fp`` that occur more than once, by merged quotient filters."""
    if not rows:
        return marks.select("fp")
    cut = max(0, min(width - 1, (max(1, rows) // RANGE_ROWS).bit_length()))
    bits = width - cut

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def filters() -> pd.DataFrame:
            v, c = merge_runs(held)
            block = (v >> np.uint64(bits)) if bits < 64 else np.zeros(len(v), np.uint64)
            starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(v) else []
            out = []
            for s, e in zip(starts, [*starts[1:], len(v)]):
                low = v[s:e] & np.uint64((1 << bits) - 1) if bits < 64 else v[s:e]
                out.append((int(block[s]), *CountingQuotientFilter.build(low, c[s:e], bits).pack()))
            return pd.DataFrame(out, columns=["block", "q", "occupied", "run_ends", "low", "many"])

        for f in frames:
            v = f["fp"].to_numpy().view(np.uint64)
            held.append(np.unique(v, return_counts=True))
            if sum(len(x) for x, _ in held) > 1 << 22:
                yield filters()
                held.clear()
        if held:
            yield filters()

    def joined(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        parts = [CountingQuotientFilter.unpack(bits, *r) for r in frame[["q", "occupied", "run_ends", "low", "many"]].itertuples(index=False)]
        v, c = merge(parts).items()
        v = v[c > 1] | (np.uint64(int(key[0]) << bits) if bits < 64 else np.uint64(0))
        return pd.DataFrame({"fp": v.view(np.int64)})

    packed = marks.select("fp").mapInPandas(local, "block long, q int, occupied binary, run_ends binary, low binary, many binary")
    return packed.groupBy("block").applyInPandas(joined, "fp long")


def exact_duplicates(docs: DataFrame, width: int = 64) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty.  The largest doc_id of a group stays.  A null doc_id is a member,
    never the one that stays unless the group has no other (then keep_id is
    null and no row of it is kept).  Of repeated rows with one doc_id each
    counts in group_size and each says kept.  ``width`` shortens the
    fingerprints; tests use it to make them collide.
    """
    marks = staged(digests(docs, width), "digests")
    again = staged(repeated_fingerprints(marks, marks.count(), width), "again")
    norm = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    low = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"))
    low = low.withColumn("fp", F.shiftrightunsigned(F.xxhash64("norm"), 64 - width))
    # Grouping by the text itself compares bytes; copies fold together before
    # they are shuffled.  The digest then routes each row to its class.
    classes = only_keys(low, again, "fp").groupBy("fp", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = staged(classes.where("group_size > 1").select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"), "classes")
    out = marks.join(classes, ["fp", "sha"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(alone, F.lit(True)).otherwise(F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one_per_text(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs``, all columns, of each text: that with the largest doc_id, one without only where the text has
    no other.

    Only rows that may have to go are shuffled."""
    per = exact_duplicates(docs, **options).where("group_size > 1")
    chosen = per.select(F.unhex("text_sha256").alias("digest"), F.col("keep_id").alias("doc_id"), F.lit(True).alias("keep"))
    return one_row_per_text(docs, staged(chosen.distinct(), "kept"))
