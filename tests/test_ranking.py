"""Known values of the ranking statistics, and ranks against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from ferrule.operators import aggregate
from ferrule.plans.ranking import ranked


def test_ranks_and_running_values_against_python(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "x", None]), rng.randrange(50), i, rng.choice([None, 1, 2, 5])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, i int, v long")
    got = {r.i: (r["rank"], r.s, r.m) for r in ranked(df, ["g"], [F.desc("o"), "i"], sums={"s": "v"}, peaks={"m": "v"}).collect()}
    for g in {r[0] for r in rows}:
        total, most = 0, None
        for k, (_, _, i, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            total += v or 0
            most = v if most is None else most if v is None else max(most, v)
            assert got[i] == (k, total, most)


def test_no_rows_have_no_ranks(spark):
    assert ranked(spark.createDataFrame([], "g string, o int"), ["g"], ["o"]).count() == 0


def _b2(spark, observed):
    rows = [("g", float(o), float(-k), k) for k, o in enumerate(observed)]
    return spark.createDataFrame(rows, "g string, o double, p double, i int")


@pytest.mark.parametrize("observed,want", [([5, 4, 3, 2, 1], 1.0), ([1, 2, 3, 4, 5], -1.0), ([3, 1, 5, 2, 4], -0.625), ([2, 2, 2], 0.0)])
def test_b_squared_known_values(spark, observed, want):
    row = aggregate.b_squared(_b2(spark, observed), "o", "p", "i", "g").first()
    assert row.n == len(observed) and row.b2 == pytest.approx(want)


def test_b_squared_curve_by_hand(spark):
    # Means 3, 2, 3, 2.75, 3 about 3; spans 4, 3, 2, 1; the last span is carried as 1.
    got = [r.b2 for r in aggregate.b_squared_curve(_b2(spark, [3, 1, 5, 2, 4]), "o", "p", "i", "g").orderBy("rank").collect()]
    assert got == pytest.approx([0, -2 / 7, -2 / 7, -2.5 / 10, -2.5 / 10])


@pytest.mark.parametrize("n,k", [(2, 1), (10, 3), (100, 10)])
def test_perfect_ranking_has_area_one(spark, n, k):
    df = spark.createDataFrame([("g", float(-i), int(i < k), i) for i in range(n)], "g string, s double, a int, i int")
    row = aggregate.enrichment(df, "s", "a", "i", "g").first()
    assert row.roc == pytest.approx(1.0) and row.auac == pytest.approx(1 - k / n / 2)
    # The top tenth is cut to whole rows.
    assert row.ef == pytest.approx(min(n // 10, k) / k / 0.1)


def test_fuzzy_histogram_by_hand(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.5,), (3.0,), (3.1,), (None,)], "x double")
    rows = lambda **o: {r.bucket: r.n for r in aggregate.fuzzy_histogram(df, "x", 0, 3, 1, **o).collect()}
    assert rows() == {0: 2, 2: 1, 3: 1}
    assert rows(minus=1) == {0: 2, 1: 1, 2: 2, 3: 1}
    assert rows(plus=2) == {0: 2, 1: 2, 2: 1, 3: 2}
