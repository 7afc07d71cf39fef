"""The pipeline stage by stage against plain Python, and the registered queries against their SQL."""

import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import corpus_pipeline
from ferrule.llm import mixing, quality, queries
from oracle import database, expected, rows
from test_near_copies import least_of_groups

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def test_stages_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "packing"]
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
    first, exact, near, mix, packed = kept
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.classify(spark.read.parquet(f"{SF}/documents.parquet"), labels).where("predicted = 1").collect()
    assert sorted(r.doc_id for r in first) == sorted(r.doc_id for r in scored)
    best = {}
    for r in first:
        best[lower(r.text)] = max(r.doc_id, best.get(lower(r.text), -1))
    assert sorted(r.doc_id for r in exact) == sorted(best.values())
    assert sorted(r.doc_id for r in near) == least_of_groups([(r.doc_id, r.text) for r in exact])
    want = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(near)).collect() if r.copies}
    assert Counter(r.doc_id for r in mix) == Counter(want)
    tokens = Counter()
    for r in packed:
        tokens[r.doc_id] += r.length
    size = {r.doc_id: r.doc_tokens for r in packed}
    assert tokens == Counter({d: n * size[d] for d, n in want.items()})


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "pipeline"])
def test_registered_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name in queries.ORACLES:
        columns, want = expected(database(SF), queries.ORACLES[name])
        assert sorted(df.columns) == columns and rows(got, df.columns) == want


def test_query_scores_against_brute_force(spark):
    """The fit by hand: normal equations of all labelled rows outside the held-out part, folds, and the isotonic map."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = {r.doc_id: float(r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None}
    out = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 4 == 2 for d in docs}
    x = {d.doc_id: np.array(quality.statistics((d.text or "").encode()), np.float32).astype(float) for d in docs}
    ids = [i for i in x if i in labels and not out[i]]
    train, y = np.array([x[i] for i in ids]), np.array([labels[i] for i in ids])
    mean, scale = train.mean(0), train.std(0)
    scale[train.var(0) <= 1e-12] = 1
    rng = np.random.default_rng(7)
    omega, phase = rng.normal(size=(quality.N_STATS, 160)) / (2 * quality.N_STATS**0.5), rng.uniform(0, 2 * np.pi, 160)

    def phi(v):
        z = np.clip((v - mean) / scale, -6, 6)
        return np.hstack([np.cos(z @ omega + phase) * (2 / 160) ** 0.5, z / 6, np.ones((len(z), 1))])

    a = phi(train)
    solve = lambda p, t: np.linalg.solve(p.T @ p + 0.3 * np.eye(p.shape[1]), p.T @ t)
    fold = {r.doc_id: r.f for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").selectExpr("doc_id", "pmod(xxhash64(doc_id), 4) as f").collect()}
    f = np.array([fold[i] for i in ids])
    raw = np.concatenate([a[f == k] @ solve(a[f != k], y[f != k]) for k in range(4)])
    order = np.concatenate([np.flatnonzero(f == k) for k in range(4)])
    place = np.minimum(((np.clip(raw, -0.5, 1.5) + 0.5) / 2 * 1000).astype(int), 999)
    bins = sorted(set(place))
    n = np.array([(place == b).sum() for b in bins])
    at, value = quality.pool_adjacent(np.array([y[order][place == b].mean() for b in bins]), n, np.array([np.clip(raw, -0.5, 1.5)[place == b].mean() for b in bins]))
    at, value = np.concatenate([[min(-0.5, at[0]) - 1], at, [max(1.5, at[-1]) + 1]]), np.concatenate([[0.0], value, [1.0]])
    want = np.clip(np.interp(phi(np.array([x[d.doc_id] for d in docs])) @ solve(a, y), at, value), 0, 1)
    got = {r.doc_id: r for r in queries.QUERIES["op4_quality"](spark, SF).collect()}
    for d, w in zip(docs, want):
        r = got[d.doc_id]
        assert r.held_out == out[d.doc_id] and abs(r.score - w) < 1e-6 and r.predicted == int(r.score >= 0.7)
    known = [r for i, r in got.items() if out[i] and i in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in known]) >= 0.9


STAGES = dict(corpus_pipeline.STAGES)


def _awkward(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, "  "), (None, None), (None, "lone words in a row"), (5, long), (5, long), (6, long + " end"), (7, "lone words in a row"), (8, "LONE words in a row"), (8, "another text")]
    frame = spark.createDataFrame([(i, t, "en", None if k % 3 == 0 else "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    # Names that the operators use themselves.
    return frame.selectExpr("*", "1 as keep", "'d' as digest", "2L as h", "3 as size", "4 as fp", "'n' as node", "5 as copies", "6 as score", "7 as k", "8 as row")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES if n != "packing"])
def test_stages_on_awkward_rows(spark, name):
    docs = _awkward(spark)
    out = STAGES[name](spark, docs, SF)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    given = Counter((r.doc_id, r.text) for r in docs.collect())
    if name == "quality classifier":
        assert not got - given and len({n for k, n in got.items() if k[0] == 5}) <= 1
    elif name == "exact dedup":
        assert sorted(lower(t) for _, t in got) == sorted({lower(t) for _, t in given}) and got[(8, "LONE words in a row")] == 1
    elif name == "SimHash near-dedup":
        texts = [t for _, t in got if t and t.strip()]
        assert sorted(len(t.split()) for t in texts) == [2, 5, 3000] and sum(got.values()) == 4
    else:
        assert set(got) <= set(given) and all(n <= 3 * given[k] for k, n in got.items())
    empty = STAGES[name](spark, docs.limit(0), SF)
    assert empty.columns == docs.columns and empty.count() == 0


def test_packing_stage_on_awkward_rows(spark):
    docs = _awkward(spark)
    got = STAGES["packing"](spark, docs, SF).collect()
    assert sum(r.start == 0 for r in got) == docs.count()
    assert STAGES["packing"](spark, docs.limit(0), SF).count() == 0
