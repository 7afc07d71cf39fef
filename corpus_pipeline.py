"""From raw documents to packed training sequences: filter, dedup twice, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers as P
from pyspark.sql import DataFrame, SparkSession, functions as F

from ferrule.llm import exact, mixing, near, packing, quality
from ferrule.llm.common import table
from ferrule.plans.batches import in_small_batches
from ferrule.plans.shipping import shipped
from ferrule.plans.staging import staged


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; its labels are the table's, learned on this stage's own rows."""
    return quality.keep_accepted(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest doc_id."""
    return exact.keep_one_per_text(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard 0.8), that with the smallest doc_id."""
    return near.keep_one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows repeat where a source is short of its target."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with a digest of their token ids."""
    pieces = packing.pack(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality classifier", shipped(in_small_batches(accept_quality))),
    ("exact dedup", shipped(in_small_batches(drop_exact_copies))),
    ("SimHash near-dedup", shipped(in_small_batches(drop_near_copies))),
    ("mixing sources to target weights", shipped(in_small_batches(mix_sources))),
    ("packing", shipped(in_small_batches(pack_sequences))),
]

#: Hashing, tokenising and the trained classifier are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
