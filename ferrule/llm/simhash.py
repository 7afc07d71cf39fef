"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

A fingerprint has 64 bits.  Two that differ in at most three bits agree on all
but three of any k blocks, so they share the key made of some k-3 blocks.
Fingerprints are made distinct first, so copies never meet as pairs.  Each key
bucket is compared exactly and yields only a spanning forest of its links,
never its pairs.  k grows with the number of distinct fingerprints so that a
bucket of unrelated fingerprints stays small.  A bucket larger than
``bucket_limit`` is not compared in one task: its fingerprints are keyed again
by 13 of 16 blocks, where a bucket holds at most 2**12 distinct fingerprints
by construction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ferrule.plans.components import connected_components
from ferrule.plans.staging import staged

from .common import utf8

SEED = 42
#: Shingles hashed at once; bounds memory on a text of any length.
CHUNK = 1 << 16


def simhash(text: bytes, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of ASCII-lower-cased words; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(words) - shingle + 1)
    lo, hi = starts[:n].tolist(), (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        h = np.array([digest(line[s:e], SEED) for s, e in zip(lo[at : at + CHUNK], hi[at : at + CHUNK])], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Rows ``(doc_id, fp)`` of ``docs``, one per row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t, shingle) for t in utf8(b.column(1))), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_masks(k: int, drop: int) -> list[int]:
    """For every choice of k - drop of k blocks: the mask of their bits, as a signed long."""
    cuts = [round(64 * i / k) for i in range(k + 1)]
    blocks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(k)]
    masks = [sum(blocks[i] for i in keep) for keep in combinations(range(k), k - drop)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(n: int, drop: int) -> int:
    """The fewest blocks whose key space leaves at most 64 unrelated fingerprints a bucket."""
    for k in range(drop + 1, 16):
        if n <= 64 * 2 ** (64 * (k - drop) // k):
            return k
    return 16


def forest(f: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph on distinct ``f`` that joins values at most ``most`` bits apart."""
    # In signed order, as Spark compares them, so that the least node is the root: hubs then have low numbers.
    f = np.unique(f.view(np.int64)).view(np.uint64)
    if len(f) <= 512:
        near = np.bitwise_count(f[:, None] ^ f[None, :]) <= most
        if np.count_nonzero(near) == len(f):
            return f[:0], f[:0]
    a, b, rest = [], [], f
    while len(rest) > 1:
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            hit = (np.bitwise_count(front[:128, None] ^ rest[None, :]) <= most).any(axis=0)
            found, rest, front = rest[hit], rest[~hit], front[128:]
            front = np.concatenate([front, found])
            a.append(np.full(len(found), root))
            b.append(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (f[:0], f[:0])


def _compare(keyed: DataFrame, most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0)
            flat, off = np.asarray(col.values).view(np.uint64), np.asarray(col.offsets)
            a, b = [], []
            for i in range(len(off) - 1):
                x, y = forest(flat[off[i] : off[i + 1]], most)
                if len(x):
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    lists = keyed.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    return lists.mapInArrow(run, "a long, b long")


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    return fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))


def fingerprint_links(fps: DataFrame, most: int = 3, bucket_limit: int = 4096) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the distinct values of ``fps.fp`` that a chain of near pairs connects."""
    keyed = _keyed(fps, block_masks(blocks_for(fps.count(), most), most))
    hot = staged(keyed.groupBy("t", "key").count().where(F.col("count") > bucket_limit).select("t", "key"), "hot")
    if hot.isEmpty():
        return _compare(keyed, most)
    crowded = keyed.join(hot, ["t", "key"]).select("fp").distinct()
    return _compare(keyed.join(hot, ["t", "key"], "left_anti"), most).union(_compare(_keyed(crowded, block_masks(16, most)), most))


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 3, bucket_limit: int = 4096) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null text counts as empty; texts without words have fingerprint zero and
    link with one another like any other.  A null doc_id stays a row and links
    others, but is never a component's id.  Repeated rows come back as often
    as they came; other columns are not looked at.
    """
    marks = staged(fingerprints(docs, shingle), "simhash")
    reps = staged(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "reps")
    roots = connected_components(fingerprint_links(reps.select("fp"), most, bucket_limit))
    grouped = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    byfp = grouped.join(least, "root").select("fp", "component_id")
    return marks.join(byfp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
