"""Duplicate removal and set operations that keep the first of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ferrule.functions.strings import strip_leading_zeros

from .filters import Split


def row_key(columns: Sequence[str], ignore_case: bool = False, strip_zeros: bool = False, truncate_at: str | None = None, subset: str | None = None) -> Column:
    """The compared form of some columns, joined; empty if all are null or empty."""
    cells = []
    for name in columns:
        c = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        c = F.lower(c) if ignore_case else c
        c = strip_leading_zeros(c) if strip_zeros else c
        c = F.substring_index(c, truncate_at, 1) if truncate_at else c
        cells.append(F.regexp_extract(c, subset, 1) if subset else c)
    joined = F.concat_ws("\x1f", *cells)
    blank = F.lit(True)
    for c in cells:
        blank = blank & (c == "")
    return F.when(blank, F.lit("")).otherwise(joined)


def unique_rows(df: DataFrame, columns: Sequence[str], order: str, keep: int = 1, seen: DataFrame | None = None, **normal) -> Split:
    """The first ``keep`` rows of each key by ``order``, and the others.  Rows with an empty key are in neither; keys in
    ``seen`` (same columns) count as met before."""
    rows = df.withColumn("__key", row_key(columns, **normal)).where("__key <> ''")
    rows = rows.withColumn("__r", F.row_number().over(W.partitionBy("__key").orderBy(order)))
    if seen is not None:
        old = seen.select(row_key(columns, **normal).alias("__key")).distinct().withColumn("__old", F.lit(True))
        rows = rows.join(old, "__key", "left").withColumn("__r", F.when(F.col("__old"), keep + 1).otherwise(F.col("__r"))).drop("__old")
    return Split(rows.where(F.col("__r") <= keep).drop("__key", "__r"), rows.where(F.col("__r") > keep).drop("__key", "__r"))


def keep_some_duplicates(df: DataFrame, columns: Sequence[str], order: str, chance: float, seed: int = 0, **normal) -> DataFrame:
    """First rows of each key, and later ones with a chance."""
    rows = df.withColumn("__key", row_key(columns, **normal)).where("__key <> ''").withColumn("__r", F.row_number().over(W.partitionBy("__key").orderBy(order)))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(order).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(16.0**8)
    return rows.where((F.col("__r") == 1) | (u < chance)).drop("__key", "__r")


def union_by_name(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def except_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def intersect_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_semi")


def drop_variants(items: DataFrame, products: DataFrame, key: str, order: str) -> DataFrame:
    """Items none of whose transformed forms was seen earlier in the order.  ``products``: (key, product)."""
    by = items.select(F.col(key).alias("product"), F.col(order).alias("po"))
    hit = products.join(by, "product").join(items.select(key, F.col(order).alias("o")), key).where("po < o").select(key).distinct()
    return items.join(hit, key, "left_anti")
