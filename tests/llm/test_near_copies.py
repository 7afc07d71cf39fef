"""The near-duplicate stage against exact Jaccard similarity of five-word shingles."""

import random
import sys
from itertools import combinations
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import corpus_pipeline
from test_corpus_ops import components

STAGE = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]


def five(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def least_of_groups(rows):
    sets = [five(t) for _, t in rows]
    near = [(i, j) for i, j in combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    least = {}
    for (d, _), c in zip(rows, components(len(rows), near)):
        least[c] = min(d, least.get(c, d))
    return sorted(least.values())


def test_planted_near_copies_go(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    rows = []
    for i in range(300):
        text = [word() for _ in range(rng.randint(60, 400))]
        rows.append((3 * i, " ".join(text)))
        for k in (1, 2):
            # Changing c words far apart leaves (n - 5c) of (n + 5c) shingles.
            copy = list(text)
            for at in rng.sample(range(len(text)), rng.randint(1, max(1, len(text) // 35))):
                copy[at] = word()
            rows.append((3 * i + k, " ".join(copy)))
    got = sorted(r.doc_id for r in STAGE(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(7), "").collect())
    assert got == least_of_groups(rows)
    assert 300 <= len(got) < 450


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = corpus_pipeline.drop_exact_copies(spark, docs, "").collect()
    got = STAGE(spark, spark.createDataFrame(first, docs.schema), "").collect()
    want = least_of_groups([(r.doc_id, r.text) for r in first])
    assert sorted(r.doc_id for r in got) == want and len(want) < len(first)


def test_rows_without_a_number_and_with_a_repeated_one(spark):
    words = [f"w{i}" for i in range(200)]
    near = " ".join(words[:-1] + ["end"])
    rows = [(None, " ".join(words)), (7, near), (7, "quite another text of several words"), (None, "lone text"), (None, "LONE text"), (9, "quite another text of several words")]
    got = STAGE(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id or 0, r.text.lower()) for r in got) == sorted([(0, "lone text"), (7, near), (7, "quite another text of several words")])
