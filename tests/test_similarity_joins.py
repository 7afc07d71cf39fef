"""Similarity joins against all pairs in plain Python."""

import random

import pytest

from ferrule.operators import similarity


def _table(seed, count, first=0):
    rng = random.Random(seed)
    out = {}
    for i in range(first, first + count):
        words = rng.choices(range(30), [1 / (w + 1) for w in range(30)], k=rng.randrange(1, 25))
        out[i] = {w * (1 << 40): words.count(w) for w in set(words)}
        if rng.random() < 0.2 and i > first:
            out[i] = dict(out[rng.randrange(first, i)])
    return out


def _frame(spark, table):
    return spark.createDataFrame([(i, b, c) for i, x in table.items() for b, c in x.items()], "id long, bit long, cnt int")


def _distance(x, y):
    common = sum(min(c, y.get(b, 0)) for b, c in x.items())
    return 1 - common / (sum(x.values()) + sum(y.values()) - common)


@pytest.mark.parametrize("threshold", [0.0, 0.2, 0.5, 0.9])
def test_within_against_all_pairs(spark, threshold):
    x, y = _table(1, 60), _table(2, 50, 100)
    one = {(r.a, r.b): r.d for r in similarity.within(_frame(spark, x), threshold).collect()}
    want = {(a, b): _distance(x[a], x[b]) for a in x for b in x if a < b}
    assert one == pytest.approx({k: d for k, d in want.items() if d <= threshold + 1e-12})
    two = {(r.a, r.b): r.d for r in similarity.within(_frame(spark, x), threshold, _frame(spark, y)).collect()}
    want = {(a, b): _distance(x[a], y[b]) for a in x for b in y}
    assert two == pytest.approx({k: d for k, d in want.items() if d <= threshold + 1e-12})


@pytest.mark.parametrize("held", [True, False])
def test_nearest_against_all_pairs(spark, monkeypatch, held):
    if not held:
        monkeypatch.setattr(similarity, "NEEDLE_ROWS", 3)
    x, y = _table(3, 20), _table(4, 120, 100)
    a, b = _frame(spark, x), _frame(spark, y)
    all_ = {i: sorted((d, j) for j in y if (d := _distance(x[i], y[j])) < 1) for i in x}
    got = similarity.nearest(similarity.closest(a, b, 4, upper=0.7), 4, upper=0.7).collect()
    want = {(i, r): j for i in x for r, (d, j) in enumerate([p for p in all_[i] if p[0] < 0.7][:4], 1)}
    assert {(r.needle, r["rank"]): r.hay for r in got} == want
    got = similarity.nearest_at_least(similarity.closest(a, b, 4, upper=0.4, least=2), 4, 2, upper=0.4).collect()
    want = set()
    for i in x:
        inside = [p for p in all_[i] if p[0] < 0.4]
        want |= {(i, j) for _, j in (inside[:4] if len(inside) >= 2 else all_[i][:2])}
    assert {(r.needle, r.hay) for r in got} == want
    best = {r.id: r.needle for r in similarity.nearest_needle(a, b).collect()}
    for j in y:
        near = min(((d, i) for i in x if (d := _distance(x[i], y[j])) < 1), default=(1, None))
        assert best[j] == near[1]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "id long, bit long, cnt int")
    full = _frame(spark, _table(5, 5))
    assert similarity.within(empty, 0.5).count() == 0
    assert similarity.closest(empty, full, 3).count() == 0
    assert similarity.nearest_needle(empty, full).where("needle is not null").count() == 0
