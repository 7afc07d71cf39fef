"""Keyed joins of record files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ferrule.functions.strings import strip_leading_zeros


def join_key(c: Column, ignore_case: bool = False, truncate_at: str | None = None, strip_zeros: bool = False) -> Column:
    """An identifier as it is compared."""
    c = c.cast("string")
    if truncate_at:
        c = F.substring_index(c, truncate_at, 1)
    if strip_zeros:
        c = strip_leading_zeros(c)
    return F.lower(c) if ignore_case else c


class DuplicateIdentifiers(ValueError):
    """A file beyond the first has an identifier twice."""


def concat_files(tables: Sequence[DataFrame], key: str, order: str, how: str = "left", duplicates: str = "first", distinct_first: bool = False, fill: str | None = ".", unique_columns: bool = False, **normal) -> DataFrame:
    """Tables side by side by identifier.

    ``how``: ``left`` keeps the first table's rows, ``inner`` those found
    everywhere, ``full`` all identifiers.  Later tables must have unique
    identifiers: ``first`` takes the first row by ``order``, ``error`` raises.
    The first may repeat them unless ``distinct_first``.  Cells of absent rows
    hold ``fill`` (as strings) or null.  Column names that repeat get a
    counting suffix, or are an error if ``unique_columns``.  ``order`` is an
    input-order column of every table and is not returned.
    """
    if how not in ("left", "inner", "full"):
        raise ValueError(how)
    out, names = None, {key}
    for i, t in enumerate(tables):
        k = join_key(F.col(key), **normal)
        t = t.withColumn("__key", k)
        if i and duplicates == "error" and not t.groupBy("__key").count().where("count > 1").isEmpty():
            raise DuplicateIdentifiers(f"table {i + 1}")
        if i or distinct_first:
            t = t.withColumn("__r", F.row_number().over(W.partitionBy("__key").orderBy(order))).where("__r = 1").drop("__r")
        cols = []
        for c in t.columns:
            if c in (key, order, "__key"):
                continue
            n = c
            if c in names:
                if unique_columns:
                    raise ValueError(f"column {c!r} in two tables")
                n = next(f"{c}_{j}" for j in range(2, 10_000) if f"{c}_{j}" not in names)
            names.add(n)
            cell = F.col(f"`{c}`")
            cols.append((cell.cast("string") if fill is not None else cell).alias(n))
        t = t.select("__key", F.col(key).alias(f"__id{i}"), *cols)
        out = t if out is None else out.join(t, "__key", how)
    ids = F.coalesce(*[F.col(f"__id{i}") for i in range(len(tables))]).alias(key)
    value = [c for c in out.columns if not c.startswith("__")]
    return out.select(ids, *[F.coalesce(F.col(f"`{c}`"), F.lit(fill)).alias(c) if fill is not None else F.col(f"`{c}`") for c in value])


def lost_rows(tables: Sequence[DataFrame], key: str, **normal) -> DataFrame:
    """Identifiers of the first table that another one lacks: what an inner join loses."""
    keys = [t.select(join_key(F.col(key), **normal).alias(key)).distinct() for t in tables]
    out = None
    for t in keys[1:]:
        gone = keys[0].join(t, key, "left_anti")
        out = gone if out is None else out.union(gone)
    return out.distinct()


def join_items(left: DataFrame, right: DataFrame, tag: str, how: str = "left", drop_repeats: bool = False) -> DataFrame:
    """Tagged records joined on a tag's value: the right record's other items follow the left's.

    Both have ``items``, an array of (tag, value); of several right records
    with one value the least is taken.  ``drop_repeats`` leaves out right items
    whose tag the left has.
    """
    value = lambda items: F.try_element_at(F.filter(items, lambda x: x["tag"] == tag), F.lit(1))["value"]
    l = left.withColumn("__v", value(F.col("items")))
    r = right.select(value(F.col("items")).alias("__v"), F.filter("items", lambda x: x["tag"] != tag).alias("__more")).where("__v is not null").groupBy("__v").agg(F.min("__more").alias("__more"))
    out = l.join(r, "__v", "inner" if how == "inner" else "left")
    more = F.coalesce("__more", F.slice("items", 1, 0))
    if drop_repeats:
        have = F.transform("items", lambda x: x["tag"])
        more = F.filter(more, lambda x: ~F.array_contains(have, x["tag"]))
    return out.withColumn("items", F.concat("items", more)).drop("__v", "__more")
