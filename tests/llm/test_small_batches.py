"""The stages of the pipeline leave whole texts in Arrow batches of bounded size, and lose no row by it."""

import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import corpus_pipeline

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
ROWS, LENGTH = 3000, 8000


@pytest.fixture
def unset(spark):
    spark.conf.unset(KEY)
    yield
    spark.conf.unset(KEY)


def batches(spark):
    """Rows and bytes of each batch in which long texts reach a worker."""

    def seen(got):
        for b in got:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    docs = spark.range(ROWS).coalesce(1).select("id", F.repeat(F.lit("x"), LENGTH).alias("text"))
    return docs.mapInArrow(seen, "n long, size long").collect()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_long_texts_travel_in_small_batches(spark, unset, name, stage):
    docs = spark.createDataFrame([(1, "a b c", "en", "web"), (2, "d e f", "en", "web")], "doc_id long, text string, lang string, source string")
    stage(spark, docs, "/root/testdata/sf0.001")
    got = batches(spark)
    assert sum(r.n for r in got) == ROWS
    assert max(r.size for r in got) <= 5 << 20


def test_a_smaller_bound_of_the_session_stays(spark, unset):
    spark.conf.set(KEY, "1m")
    dict(corpus_pipeline.STAGES)["packing"](spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), "")
    assert max(r.size for r in batches(spark)) <= 2 << 20


def test_one_text_beyond_the_bound_is_whole(spark, unset):
    long = " ".join(f"word{i}" for i in range(900_000))
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, "").collect()}
    assert got == {1: long, 2: "short", 3: None}
