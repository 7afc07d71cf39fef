"""Near-duplicates by word shingles: SimHash and min-hash blocks propose, exact Jaccard similarity decides.

At a Jaccard similarity of 0.8 two 64-bit SimHashes differ in about ten bits,
too many for pigeonhole blocks alone.  So beside those, texts that agree on
any of BANDS blocks of ROWS minima become candidates: a pair exactly at 0.8 is
missed with probability (1 - 0.8**6)**24, about 0.0007, closer pairs less.
Candidates are linked to the least text of their block, never paired.  The
texts of a candidate component then meet once, in one task, where an inverted
index of their shingles gives the true components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ferrule.plans.bitmap import bitmap, may_hold
from ferrule.plans.components import connected_components
from ferrule.plans.staging import staged

from .common import may_be_among, one_row_per_text, text_digest, utf8
from .simhash import SEED, fingerprint_links

ROWS, BANDS = 6, 24
#: Shingles hashed by all functions at once.
CHUNK = 1024
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (3, ROWS * BANDS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, n: int) -> np.ndarray:
    """Hashes of all n-word shingles of ASCII-lower-cased words; a shorter text is one shingle."""
    words = text.lower().split()
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1).tolist()
    stops = ends[n - 1 :].tolist() if len(words) >= n else [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, stops)), np.uint64, len(stops))


def simhash_of(h: np.ndarray) -> int:
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(h), bitorder="little").tobytes(), "little")


def blocks(h: np.ndarray) -> np.ndarray:
    """One key a band: equal where all minima of the band are."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), CHUNK):
        x = h[at : at + CHUNK, None] * _ODD[0] + _ODD[1]
        x ^= x >> np.uint64(32)
        np.minimum(least, x.min(axis=0), out=least)
    return (least * _ODD[2]).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)


def _marks(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, keys = np.zeros(b.num_rows, np.uint64), np.zeros((b.num_rows, BANDS), np.uint64)
            nodes = []
            for i, text in enumerate(utf8(b.column(1))):
                nodes.append(hashlib.sha256(text.lower()).digest())
                h = shingles(text, n)
                fps[i], keys[i] = simhash_of(h), blocks(np.unique(h))
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, np.int32), pa.array(keys.ravel().view(np.int64)))
            yield pa.record_batch([b.column(0), pa.array(nodes, pa.binary()), pa.array(fps.view(np.int64)), lists], ["doc_id", "node", "fp", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, node binary, fp long, keys array<long>")


def groups(sets: list[np.ndarray], share: float) -> np.ndarray:
    """For each of the sets the first one that a chain of pairs of at least this Jaccard similarity reaches."""
    size, out = np.array([len(s) for s in sets]), np.arange(len(sets))
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.zeros(2, int) if both >= share * (size.sum() - both) - 1e-9 else out
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    owner, starts = np.repeat(out, size)[order], np.append(0, np.cumsum(np.bincount(code)))
    cuts = np.append(0, np.cumsum(size))
    rest = np.ones(len(sets), bool)
    for first in range(len(sets)):
        if not rest[first]:
            continue
        rest[first], front = False, [first]
        while front and rest.any():
            i = front.pop()
            both = np.bincount(np.concatenate([owner[starts[c] : starts[c + 1]] for c in code[cuts[i] : cuts[i + 1]]]), minlength=len(sets))
            found = np.flatnonzero(rest & (both >= share * (size + size[i] - both) - 1e-9))
            rest[found], out[found] = False, first
            front += found.tolist()
    return out


def _surplus(members: DataFrame, n: int, share: float) -> DataFrame:
    """Of ``members`` (root, doc_id, node, text) the nodes that are not the least of their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, nodes, sets = None, [], []

        def settled() -> pa.RecordBatch:
            of = groups(sets, share) if len(sets) > 1 else np.arange(len(sets))
            return pa.record_batch([pa.array([x for i, x in enumerate(nodes) if of[i] != i], pa.binary())], ["node"])

        for b in batches:
            for r, node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2))):
                if r != root:
                    yield settled()
                    root, nodes, sets = r, [], []
                nodes.append(node)
                sets.append(np.unique(shingles(text, n)))
        yield settled()

    dealt = members.repartition("root").sortWithinPartitions("root", F.col("doc_id").asc_nulls_last(), "node")
    return dealt.select("root", "node", "text").mapInArrow(run, "node binary")


def _candidates(marks: DataFrame, most: int) -> DataFrame:
    """Links ``(a, b)`` of texts to look at: near SimHashes, and the least text of each min-hash block."""
    reps = staged(marks.groupBy("fp").agg(F.min("node").alias("b")), "reps")
    same = marks.select("fp", F.col("node").alias("a")).join(reps, "fp").select("a", "b").where("a <> b")
    links = fingerprint_links(reps.select("fp"), most).withColumnsRenamed({"a": "x", "b": "y"})
    near = links.join(reps.select(F.col("fp").alias("x"), F.col("b").alias("a")), "x").join(reps.select(F.col("fp").alias("y"), "b"), "y").select("a", "b")
    keyed = marks.select("node", F.posexplode("keys").alias("t", "key"))
    least = staged(keyed.groupBy("t", "key").agg(F.min("node").alias("b"), F.max("node").alias("c")).where("b <> c").select("t", "key", "b"), "blocks")
    held = keyed.where(may_hold(bitmap(least, "t", "key"), "t", "key"))
    return same.union(near).union(held.join(least, ["t", "key"]).where("node <> b").select("node", "b").distinct())


def keep_one_per_group(docs: DataFrame, shingle: int = 5, share: float = 0.8, most: int = 3) -> DataFrame:
    """One row of ``docs``, all columns, of each group of texts that pairs of at least ``share`` Jaccard similarity of
    ``shingle``-word shingles connect: that with the smallest doc_id, one without only where the group has no other.

    Only rows that may have to go are shuffled."""
    marks = staged(_marks(docs, shingle), "near")
    per = marks.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    roots = staged(connected_components(_candidates(marks, most), "a", "b"), "roots")
    texts = docs.where(F.coalesce(may_be_among(roots, "node"), F.lit(False))).select(text_digest().alias("node"), F.col("text").cast("string").alias("text"))
    members = texts.join(roots, "node").dropDuplicates(["node"]).join(per.select("node", "doc_id"), "node")
    drop = staged(_surplus(members.select("root", "doc_id", "node", "text"), shingle, share).distinct(), "surplus")
    gone = drop.select(F.col("node").alias("digest"), F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("keep"))
    once = per.where("n > 1").join(drop, "node", "left_anti").select(F.col("node").alias("digest"), "doc_id", F.lit(True).alias("keep"))
    return one_row_per_text(docs, staged(gone.union(once), "chosen"))
