"""Column selection, reordering and renaming of descriptor tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def _resolve(df: DataFrame, wanted: Sequence[int | str], pad: str | None) -> list[tuple[str, str | None]]:
    """(source, pad) per requested column: numbers count from 1, negative from the end, ``a-b`` is a range, ``/rx/`` a pattern."""
    cols, out = df.columns, []
    for w in wanted:
        if isinstance(w, str) and re.fullmatch(r"-?\d+--?\d+", w):
            a, b = map(int, re.fullmatch(r"(-?\d+)-(-?\d+)", w).groups())
            a, b = (x + len(cols) + 1 if x < 0 else x for x in (a, b))
            found = [cols[i - 1] for i in range(a, b + 1)]
        elif isinstance(w, int):
            i = w - 1 if w > 0 else len(cols) + w
            found = [cols[i]] if 0 <= i < len(cols) else []
        elif len(w) > 2 and w[0] == w[-1] == "/":
            found = [c for c in cols if re.search(w[1:-1], c)]
        else:
            found = [w] if w in cols else []
        if not found:
            if pad is None:
                raise ValueError(f"no column {w!r}")
            out.append((str(w), pad))
        out += [(c, None) for c in found]
    return out


def cut(df: DataFrame, wanted: Sequence[int | str], id_column: str | None = None, invert: bool = False, pad: str | None = None, drop_blank: bool = False) -> DataFrame:
    """Columns in the order of the request, repeats allowed.

    ``id_column`` is put first; ``invert`` takes the others in table order;
    ``pad`` is the value of columns that do not exist; ``drop_blank`` drops
    rows with a null or empty cell.  A repeated column gets a counting suffix.
    """
    found = _resolve(df, wanted, pad)
    if invert:
        gone = {c for c, p in found if p is None}
        found = [(c, None) for c in df.columns if c not in gone]
    if id_column is not None:
        found = [(id_column, None), *[x for x in found if x[0] != id_column]]
    seen: dict[str, int] = {}
    cols = []
    for name, p in found:
        seen[name] = seen.get(name, 0) + 1
        alias = name if seen[name] == 1 else f"{name}_{seen[name]}"
        cols.append((F.col(f"`{name}`") if p is None else F.lit(p)).alias(alias))
    out = df.select(*cols)
    if drop_blank:
        out = out.where(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`").cast("string") != "") for c in out.columns]))
    return out


def cut_matching(df: DataFrame, column: str, pattern: str, sep: str = r"\s+") -> DataFrame:
    """Each record's tokens that match a pattern, which may be others in every record."""
    return df.withColumn(column, F.array_join(F.filter(F.split(column, sep), lambda w: w.rlike(pattern)), " "))


def rename(df: DataFrame, names: dict[str, str] | None = None, strip_prefix: str = "", valid: bool = False) -> DataFrame:
    """New column names by map, without a prefix, and with only letters, digits and ``_.-`` if ``valid``."""
    out = []
    for c in df.columns:
        n = (names or {}).get(c, c.removeprefix(strip_prefix))
        out.append(re.sub(r"[^A-Za-z0-9_.\-]", "_", n) if valid else n)
    return df.toDF(*out)


def rearrange(tables: Sequence[DataFrame], id_column: str, like: Sequence[str] | None = None, fill: str | None = None, extra: str = "append", common_rows: bool = False, common_columns: bool = False) -> DataFrame:
    """Several tables merged by identifier, columns in the order of a template.

    The template is ``like`` or all headers in order of appearance; columns
    beyond it are ``append``ed or ``drop``ped, missing ones hold ``fill``.
    Identifiers come once: the first table that has a value gives it, a
    repeated identifier within a table counts with its first row by value
    order.  ``common_rows``/``common_columns`` keep what all tables have.
    """
    order = list(dict.fromkeys(c for t in tables for c in t.columns if c != id_column))
    if common_columns:
        order = [c for c in order if all(c in t.columns for t in tables)]
    template = [c for c in like if c != id_column] if like is not None else order
    columns = template + ([c for c in order if c not in template] if extra == "append" and not common_columns else [])
    long = None
    for k, t in enumerate(tables):
        have = [(F.col(f"`{c}`").cast("string") if c in t.columns else F.lit(None).cast("string")).alias(c) for c in columns]
        part = t.select(id_column, *have, F.lit(k).alias("__k"))
        long = part if long is None else long.unionByName(part)
    firsts = [F.min(F.when(F.col(f"`{c}`").isNotNull(), F.struct("__k", F.col(f"`{c}`").alias("v"))))["v"].alias(c) for c in columns]
    out = long.groupBy(id_column).agg(*firsts, F.count_distinct("__k").alias("__n"))
    if common_rows:
        out = out.where(F.col("__n") == len(tables))
    return out.select(id_column, *[(F.coalesce(F.col(f"`{c}`"), F.lit(fill)) if fill is not None else F.col(f"`{c}`")).alias(c) for c in columns])
