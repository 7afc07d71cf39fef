"""The mix of the registered query against plain Python, and awkward rows."""

import random
from collections import defaultdict

import pytest

from ferrule.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def plain_targets(totals, weights, most=3):
    left, out, free = float(sum(totals)), [0.0] * len(totals), set(range(len(totals)))
    while free:
        unit = left / sum(weights[i] for i in free)
        full = {i for i in free if weights[i] * unit > most * totals[i]}
        for i in full or free:
            out[i] = float(most * totals[i]) if full else weights[i] * unit
        if not full:
            break
        left -= sum(out[i] for i in full)
        free -= full
    return out


def check(rows, got):
    """rows: (doc_id, source, text)."""
    size = defaultdict(int)
    for _, s, t in rows:
        size[s] += len((t or "").encode().split())
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(order, plain_targets([size[s] for s in order], [1 + i % 3 for i in range(len(order))])))
    assert len(got) == len(rows)
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source], abs=1e-6)
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s in order:
        assert abs(taken[s] - target[s]) <= most[s]
    return taken, target


def test_query_against_plain_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.collect()}
    got = queries.QUERIES["op10_mixing"](spark, SF).collect()
    rows = [type("R", (), {**r.asDict(), "source": source[r.doc_id]}) for r in got]
    taken, target = check([(r.doc_id, r.source, r.text) for r in docs.collect()], rows)
    assert sum(abs(taken[s] - target[s]) for s in target) <= 0.05 * sum(target.values())
    again = queries.QUERIES["op10_mixing"](spark, SF).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_plain_targets():
    assert plain_targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    assert plain_targets([10, 100, 1000], [1, 2, 3]) == [30, 300, 780]
    assert plain_targets([0, 5], [1, 2]) == [0, 5]


@pytest.mark.parametrize("seed", range(3))
def test_random_sources(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "Z", "a", "é", "b" * 50, "zero"]
    rows = [(i if rng.random() < 0.9 else None, rng.choice(names[:-1] + ["a"] * 6), " ".join("w" * rng.randint(1, 5) for _ in range(int(rng.paretovariate(0.8) * 3) % 400))) for i in range(400)]
    rows += [(i, "zero", None if i % 2 else " ") for i in range(5)] + rows[:20]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "'x' as s", "1 as k", "2L as h", "3 as rest")
    check(rows, mixing.mix(docs).collect())
    assert mixing.mix(docs.limit(0)).count() == 0
