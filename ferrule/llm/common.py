"""What the corpus operators share: words, table access, Arrow helpers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ferrule.plans.bitmap import bitmap, digest_hashes, held
from ferrule.plans.spreading import spread

#: Words are runs of anything but the ASCII white space 0x20 and 0x09-0x0D;
#: ``bytes.split()`` splits at exactly these bytes.
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; one of few files is dealt over all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()):
        yield x.as_py() or b""


def ascii_lower(c: Column | str) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def fixed_long(c: Column | str) -> Column:
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


def text_digest(c: Column | str = "text") -> Column:
    """SHA-256 of a text after lower-casing A-Z, as bytes; null counts as empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unhex(F.sha2(ascii_lower(F.coalesce(c.cast("string"), F.lit(""))), 256))


def may_be_among(digests: DataFrame, key: str, c: Column | str = "text") -> Column:
    """False where the digest of a text is surely not in ``digests.key``.  Digests are made and looked up in one pass."""
    bits = bitmap(digests, key, digest=True)

    @F.arrow_udf("boolean")
    def test(texts: pa.Array) -> pa.Array:
        return pa.array(held(bits, digest_hashes([hashlib.sha256(t.lower()).digest() for t in utf8(texts)])))

    return test((F.col(c) if isinstance(c, str) else c).cast("string"))


def one_row_per_text(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``docs`` without surplus rows.  ``chosen`` holds (digest, doc_id, keep) of each text that repeats or is to go: one
    row of that text and doc_id stays if ``keep``, none otherwise.  Only rows of such texts are shuffled."""
    hit = F.coalesce(may_be_among(chosen, "digest"), F.lit(False))
    own = F.col("doc_id").cast("long")
    # Which rows go is found from digests and numbers alone.
    narrow = docs.where(hit).select(text_digest().alias("digest"), own.alias("id")).distinct()
    want = chosen.select("digest", F.col("doc_id").alias("by"), "keep")
    surplus = narrow.join(want, "digest").where(~(F.col("keep") & F.col("id").eqNullSafe(F.col("by"))))
    surplus = surplus.select(F.col("digest").alias("d"), F.col("id").alias("i"))
    # The row travels as one value, so that its columns may have any names; by digest and number, so that the copies of one
    # text spread over all tasks.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    doubtful = docs.where(hit).select(whole, text_digest().alias("digest"), own.alias("id"))
    stay = doubtful.join(surplus, (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("i")), "left_anti")
    # A chance hit has a text of its own, so it is not touched here.
    return docs.where(~hit).unionByName(stay.dropDuplicates(["digest", "id"]).select("row.*"))
