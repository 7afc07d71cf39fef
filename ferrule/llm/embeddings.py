"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are scaled to length one, so cosine c means distance sqrt(2 - 2c).
Each of L tables hashes a vector by K quantised Gaussian projections.  K grows
with the logarithm of the row count, so that unrelated vectors rarely meet;
L follows from K and the wanted chance that a pair exactly at the threshold
meets in some table.  Equal vectors are folded first.  Bucket keys are counted
before vectors are moved, and a bucket of one moves none.  In a bucket all
cosines are exact; a pair is counted only in the first table in which it
meets, so a vector's links are summed without listing pairs.  A large bucket
is cut into blocks, and each pair of blocks is a task row of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ferrule.plans.components import connected_components
from ferrule.plans.staging import staged

#: Quantisation step of a projection of a unit vector.
STEP = 2.0
BLOCK = 1024


def meeting_chance(distance: float, step: float = STEP) -> float:
    """Chance that one quantised projection of two points at this distance agrees."""
    r = step / distance
    normal = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """(K, L): projections a table, tables."""
    far, near = meeting_chance(math.sqrt(2)), meeting_chance(math.sqrt(max(1e-12, 2 - 2 * threshold)))
    k = max(1, math.ceil(math.log(30 * max(2, rows)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log1p(-(near**k))))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows ``(vec_id, v)``: v is the vector as little-endian float64, null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1):
                v = None
                if x.is_valid and len(x.values) and not x.values.null_count:
                    a = np.asarray(x.values, "<f8") + 0.0
                    with np.errstate(over="ignore"):
                        v = a.tobytes() if np.isfinite(a).all() and 0 < float(np.linalg.norm(a)) < math.inf else None
                out.append(v)
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).mapInArrow(run, "vec_id long, v binary")


def _signatures(nodes: DataFrame, k: int, tables: int, seed: int) -> DataFrame:
    """Rows ``(node, many, v, sig)``: sig holds one 32-bit key per table, little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for b in batches:
            out: list[bytes] = [b""] * b.num_rows
            raw = [x.as_py() for x in b.column(2)]
            for dim in {len(r) // 8 for r in raw}:
                if dim not in made:
                    rng = np.random.default_rng([seed, dim])
                    made[dim] = rng.normal(size=(dim, k * tables)), rng.uniform(0, STEP, k * tables), rng.integers(1, 1 << 62, size=(k, tables), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                a, offset, mix = made[dim]
                at = [i for i, r in enumerate(raw) if len(r) == dim * 8]
                for s in range(0, len(at), 1024):
                    part = at[s : s + 1024]
                    x = _unit(np.frombuffer(b"".join(raw[i] for i in part), "<f8").reshape(-1, dim))
                    cell = np.floor((x @ a + offset) / STEP).astype(np.int64).astype(np.uint64).reshape(len(part), tables, k)
                    key = np.zeros((len(part), tables), np.uint64)
                    for j in range(k):
                        key = (key ^ cell[:, :, j]) * mix[j]
                        key ^= key >> np.uint64(31)
                    sig = (key >> np.uint64(32)).astype("<u4")
                    for i, r in zip(part, sig):
                        out[i] = r.tobytes()
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], ["node", "many", "v", "sig"])

    return nodes.select("node", "many", "v").mapInArrow(run, "node long, many long, v binary, sig binary")


def _keys(marked: DataFrame) -> DataFrame:
    """Rows ``(node, t, key)``, one per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = [np.frombuffer(s.as_py(), "<u4") for s in b.column(1)]
            if sig:
                n = len(sig[0])
                node = np.repeat(b.column(0).to_numpy(zero_copy_only=False), n)
                yield pa.record_batch([pa.array(node), pa.array(np.tile(np.arange(n), len(sig)), pa.int32()), pa.array(np.concatenate(sig).astype(np.int64))], ["node", "t", "key"])

    return marked.select("node", "sig").mapInArrow(run, "node long, t int, key long")


def _links(buckets: DataFrame, threshold: float) -> DataFrame:
    """Per bucket row: ``(a, b, n)``; b null: node a has n more links; else a link between a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n = [], [], []
            for row in batch.to_pylist():
                t, lo, hi, members = row["t"], row["lo"], row["hi"], row["members"]
                for dim in {len(m["v"]) for m in members}:
                    own = sorted((m for m in members if len(m["v"]) == dim), key=lambda m: m["node"])
                    if len(own) < 2:
                        continue
                    node = np.array([m["node"] for m in own])
                    many = np.array([m["many"] for m in own])
                    side = np.array([m["block"] for m in own])
                    v = _unit(np.frombuffer(b"".join(m["v"] for m in own), "<f8").reshape(len(own), -1))
                    sig = np.frombuffer(b"".join(m["sig"] for m in own), "<u4").reshape(len(own), -1)[:, :t]
                    near = v @ v.T >= threshold
                    np.fill_diagonal(near, False)
                    if lo != hi:
                        near &= side[:, None] != side[None, :]
                    i, j = np.nonzero(np.triu(near))
                    if not len(i):
                        continue
                    fresh = np.ones(len(i), bool)
                    for s in range(0, len(i), 65536):
                        fresh[s : s + 65536] = ~(sig[i[s : s + 65536]] == sig[j[s : s + 65536]]).any(axis=1)
                    more = np.bincount(i[fresh], many[j[fresh]], len(own)) + np.bincount(j[fresh], many[i[fresh]], len(own))
                    got = np.flatnonzero(more)
                    a.extend(node[got].tolist())
                    b.extend([None] * len(got))
                    n.extend(more[got].astype(int).tolist())
                    # A spanning forest is enough for components.
                    left = np.arange(len(own))
                    seen = np.zeros(len(own), bool)
                    for root in left:
                        if seen[root]:
                            continue
                        seen[root], front = True, [root]
                        while front:
                            new = np.flatnonzero(near[front].any(axis=0) & ~seen)
                            seen[new] = True
                            a.extend([int(node[root])] * len(new))
                            b.extend(node[new].tolist())
                            n.extend([0] * len(new))
                            front = new.tolist()
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    return buckets.mapInArrow(run, "a long, b long, n long")


def near_vectors(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.97, seed: int = 11) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing.  Rows are vectors of their own even if vec_id repeats;
    vectors of different lengths never link.  A null vec_id links others but is
    no component's id; its own row says kept = false.  ``recall`` is the least
    chance to find a pair whose cosine is just the threshold; closer pairs are
    found more surely, and none below the threshold is linked.
    """
    rows = staged(_usable(vectors), "vectors")
    folded = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("many"))
    nodes = staged(folded.withColumn("node", F.monotonically_increasing_id()), "nodes")
    k, tables = plan_tables(nodes.count(), threshold, recall)
    marked = staged(_signatures(nodes, k, tables, seed), "signatures")
    keys = _keys(marked)
    crowded = keys.groupBy("t", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    home = keys.join(crowded.select("t", "key", blocks.alias("blocks")), ["t", "key"])
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = home.withColumn("block", block).withColumn("other", other).select("node", "t", "key", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    members = dealt.join(marked, "node").groupBy("t", "key", "lo", "hi").agg(F.collect_list(F.struct("node", "many", "v", "sig", "block")).alias("members"))
    found = staged(_links(members.select("t", "lo", "hi", "members"), threshold), "links")
    degree = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("degree"))
    roots = connected_components(found.where("b is not null"))
    grouped = nodes.select("node", "v", "first", "many").join(roots, "node", "left").join(degree, "node", "left")
    grouped = staged(grouped.select("v", "first", F.coalesce("root", "node").alias("root"), (F.coalesce("degree", F.lit(0)) + F.col("many") - 1).alias("n_links")), "grouped")
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    known = grouped.join(least, "root").select("v", "n_links", "component_id")
    out = rows.join(known, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
