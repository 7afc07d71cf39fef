"""The exact stage on rows that share a doc_id or have none: every distinct text keeps one row."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import corpus_pipeline


def test_every_text_keeps_one_row(spark):
    rows = [(5, "A a"), (5, "B"), (9, "a A"), (9, "a A"), (None, "C"), (None, "c"), (None, "D"), (4, "d"), (None, "E")]
    rows += [(100 + i, f"t{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 5):
        out = corpus_pipeline.drop_exact_copies(spark, docs.repartition(parts), "")
        assert out.columns == ["doc_id", "text"]
        got = sorted((r.doc_id or 0, r.text.lower()) for r in out.collect())
        assert got == sorted([(5, "b"), (9, "a a"), (0, "c"), (4, "d"), (0, "e"), *rows[9:]])
