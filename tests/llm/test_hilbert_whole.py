"""Hilbert shards against plain Python: strings count whole, every row has its place."""

import math
import random
import zlib

import numpy as np
import pytest
import xxhash

from ferrule.llm import hilbert, queries

SF = "/root/testdata/sf0.001"


def _string_cuts(values, steps=256):
    values = sorted(v for v in values if v is not None)
    n, out = len(values), []
    for i, v in enumerate(values):
        if i + 1 == n or values[i + 1] != v:
            first = values.index(v)
            if (i + 1) * steps // n > first * steps // n:
                out.append(v)
    return out


def _number_cuts(values, steps=256):
    values = sorted(v for v in values if v is not None)
    return sorted({values[max(0, math.ceil(i / steps * len(values)) - 1)] for i in range(1, steps)}) if values else []


def _spark_hash(text):
    h = xxhash.xxh64_intdigest(text, 42)
    return h - (1 << 64) if h >> 63 else h


def brute(rows, shards):
    """rows: (doc_id, text, source, lang)."""
    data = [(i, (t or "").encode(), s, g) for i, t, s, g in rows]
    low = {}
    first = lambda a, b: b if a is None else a if b is None else min(a, b)
    for _, t, s, g in data:
        h = _spark_hash(t)
        old = low.get(h, (None, None, None))
        low[h] = (first(old[0], s), first(old[1], g), len(t) + 1)
    cuts = [_string_cuts([r[2] for r in data]), _string_cuts([r[3] for r in data]), _number_cuts([float(len(r[1]) + 1) for r in data])]

    def cell(key):
        code = []
        for v, cut, words in zip(key, cuts, (True, True, False)):
            below = sum(c < v for c in cut) if words and v is not None else sum(c <= v for c in cut) if v is not None else 0
            code.append(0 if v is None else min(below + 1, 255))
        return int(hilbert.hilbert_index(np.array([code]))[0])

    cells = {h: cell(k) for h, k in low.items()}
    order = sorted(data, key=lambda r: (cells[_spark_hash(r[1])], _spark_hash(r[1]), r[0]))
    base, extra = divmod(len(order), shards)
    out, at = [], 0
    for shard in range(shards):
        for slot in range(base + (shard < extra)):
            r = order[at]
            out.append((r[0], len(r[1]) + 1, zlib.crc32(r[1]), shard, slot))
            at += 1
    return sorted(out)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries.QUERIES["op5_hilbert"](spark, SF).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == brute([(r.doc_id, r.text, r.source, r.lang) for r in docs], 16)
    assert {r.law for r in got} == {"rows"} and all(r.grown_shard is None for r in got)


@pytest.mark.parametrize("names", [[f"s{i}" for i in range(4)], [f"https://example.org/archive/crawl-{i}" for i in range(4)]])
def test_names_count_whole(spark, names):
    rows = [(i, f"text {i} " + "x" * (i % 50), names[i % 4]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = hilbert.hilbert_shards(docs, 4, dims=("source",)).join(docs.select("doc_id", "source"), "doc_id").collect()
    held = {k: {r.source for r in got if r.shard == k} for k in range(4)}
    assert all(len(v) == 1 for v in held.values()) and set.union(*held.values()) == set(names)
    assert len({r.cell for r in got}) == 4


def test_more_names_than_cells_keep_their_order(spark):
    rng = random.Random(2)
    names = [f"common-prefix-{i:04d}" for i in range(1000)]
    rng.shuffle(names)
    docs = spark.createDataFrame([(i, f"t{i}", n) for i, n in enumerate(names)], "doc_id long, text string, source string")
    got = hilbert.hilbert_shards(docs, 10, dims=("source",)).join(docs.select("doc_id", "source"), "doc_id").collect()
    by_shard = [sorted(r.source for r in got if r.shard == k) for k in range(10)]
    # A shard's names reach into the next one's by no more than one step of 256.
    for a, b in zip(by_shard, by_shard[1:]):
        assert sum(x >= b[0] for x in a) <= 4


def test_rows_with_null_ids_and_names(spark):
    rows = [(None, None, None), (None, "a", None), (3, "", "b"), (3, "a", "b"), (4, "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as lang", "'y' as cell", "'z' as h", "1 as part")
    got = hilbert.hilbert_shards(docs, 2).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    assert sorted(str(r.doc_id) for r in got) == ["3", "3", "4", "None", "None"]
