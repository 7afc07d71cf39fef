"""Near pairs of bags of many sizes, copies among them, against all pairs; sketches fold to one another."""

import random

import numpy as np
import pytest

from ferrule.operators import bags


def test_sketches_differ_in_no_more_buckets_than_codes():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    made, codes = [], []
    for n in (1, 70, 500, 600, 3000, 5000, 9000, 20000):
        one = rng.choice(1 << 40, n, replace=False)
        for cut in (0, n // 9):
            codes.append(set((c := bags._codes(np.sort(one[cut:]), np.ones(n - cut, np.int64))).tolist()))
            made.append(bags._sketch(c, 0))
    known = bags._Known(pa.table({"id": range(len(made)), "n": [len(c) for c in codes], "sketch": made}))
    a, b = (x.ravel() for x in np.indices((len(made), len(made))))
    apart = np.array([len(codes[i] ^ codes[j]) for i, j in zip(a, b)])
    differ = known.differ(a, b)
    assert (differ <= apart).all()
    # Unlike long records are told apart.
    assert (differ[(a // 2 != b // 2) & (np.minimum(a, b) >= 8)] > 1000).all()


def test_long_and_short_bags_against_all_pairs(spark):
    rng = random.Random(11)
    table = {}
    for i in range(60):
        if i % 3 and i > 3:
            near = list(table[rng.randrange(max(0, i - 4), i)].elements() if i % 3 == 1 else table[i - 1].elements())
            table[i] = bags.Counter(rng.sample(near, len(near) - rng.randrange(len(near) // 4 + 1)))
        else:
            table[i] = bags.Counter(rng.choices(range(3000), k=rng.choice((3, 40, 300, 3000, 9000))))
    fp = spark.createDataFrame([(i, b, c) for i, x in table.items() for b, c in x.items()], "id long, bit long, cnt int")
    got = {(r.a, r.b): r.d for r in bags.pairs_within(bags.staged(bags.bags_of(fp)), 0.3).collect()}
    want = {(a, b): 1 - (x & y).total() / (x | y).total() for a, x in table.items() for b, y in table.items() if a < b}
    assert got == pytest.approx({k: d for k, d in want.items() if d <= 0.3 + 1e-12}) and len(got) > 20
