"""Row filters by key sets of any size that move only the rows in question.

A bitmap of key hashes is summed over the key set and sent to every task.  It
has about ten bits a key, but never more than MOST_BITS, 32 MB: the bound does
not depend on the data.  Rows whose bits are clear are surely not in the set
and stay where they are; only the others, the members and a few chance hits,
are shuffled for an exact join.  Beyond some 30 million keys the share of
chance hits grows; results are the same, and more rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BITS_A_KEY = 10
LEAST_BITS, MOST_BITS = 16, 28
_PARTS = 16


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    u = h.view(np.uint64)
    return (u >> np.uint64(64 - bits)).astype(np.int64), (u & np.uint64((1 << bits) - 1)).astype(np.int64)


def digest_hashes(digests: list[bytes]) -> np.ndarray:
    """The first eight bytes of each digest, which serve as its hash."""
    return np.frombuffer(b"".join(x[:8] for x in digests), "<i8")


def bitmap(keys: DataFrame, *columns: str, digest: bool = False, hashed: bool = False) -> np.ndarray:
    """The bitmap of a key set: or-ed by partition, then by range, then brought to the driver.  Reads ``keys`` twice.

    ``digest``: the one column holds digests, whose own bytes are the hash;
    ``hashed``: it holds longs that are hashes themselves."""
    bits = min(MOST_BITS, max(LEAST_BITS, (keys.count() * BITS_A_KEY - 1).bit_length()))
    width = (1 << bits) // 8 // _PARTS

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for b in batches:
            h = digest_hashes(b.column(0).to_pylist()) if digest else b.column(0).to_numpy(zero_copy_only=False)
            seen = np.unique(np.concatenate([seen, *_places(h, bits)]))
        part = seen // (width * 8)
        for k in range(_PARTS):
            # Few places travel as numbers, many as a bitmap.
            mine = (seen[part == k] - k * width * 8).astype("<u4")
            if len(mine):
                dense = mine.nbytes > width
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([dense]), pa.array([(_packed(mine, width) if dense else mine).tobytes()], pa.binary())], ["part", "dense", "bits"])

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(width, np.uint8)
        for dense, r in zip(rows["dense"], rows["bits"]):
            out |= np.frombuffer(r, np.uint8) if dense else _packed(np.frombuffer(r, "<u4"), width)
        return pd.DataFrame({"part": [key[0]], "bits": [out.tobytes()]})

    rows = keys.select(*columns) if digest or hashed else keys.select(F.xxhash64(*columns).alias("h"))
    got = rows.mapInArrow(local, "part int, dense boolean, bits binary").groupBy("part").applyInPandas(merge, "part int, bits binary").collect()
    out = np.zeros((_PARTS, width), np.uint8)
    for r in got:
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _packed(places: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(width, np.uint8)
    np.bitwise_or.at(out, places >> 3, (128 >> (places & 7)).astype(np.uint8))
    return out


def held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    hit = np.ones(len(h), bool)
    for p in _places(h, len(bits).bit_length() + 2):
        hit &= (bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
    return hit


def may_hold(bits: np.ndarray, *columns: str | Column) -> Column:
    """False where a key is surely not in the set."""

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(held(bits, h.to_numpy(np.int64)))

    return test(F.xxhash64(*columns))


def without_keys(rows: DataFrame, key: str, drop: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """``rows`` less those whose key is in ``drop``; of rows whose key is in ``once`` (all keys that repeat) one.

    Rows with a null key stay."""
    marked = drop.select(key) if once is None else drop.select(key).union(once.select(key))
    bits = bitmap(marked, key)
    if not bits.any():
        return rows
    hit = F.col(key).isNotNull() & may_hold(bits, key)
    doubtful = rows.where(hit).join(drop.select(key), key, "left_anti")
    if once is not None:
        doubtful = doubtful.dropDuplicates([key])
    return rows.where(~hit).unionByName(doubtful)


def only_keys(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Semi-join of ``rows`` with a key set, of which only possible members are shuffled."""
    return rows.where(may_hold(bitmap(keys, *columns), *columns)).join(keys.select(*columns), list(columns), "left_semi")
