"""Row and column filters of descriptor tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ferrule.functions.expressions import compile_filter


@dataclass
class Split:
    """Rows that pass and rows that do not, of one scan each."""

    passed: DataFrame
    rejected: DataFrame


def descriptor_filter(df: DataFrame, expression: str, missing_passes: bool = False, missing: str = ".", absent: str = "error", others_zero: bool = False, id_column: str | None = None) -> Split:
    """Rows for which ``expression`` holds, and the rest; ``others_zero``: all columns it does not name must be 0."""
    test = compile_filter(expression, df.columns, missing_passes, missing, absent)
    if others_zero:
        named = [c for c in df.columns if c in expression]
        rest = [c for c in df.columns if c not in named and c != id_column]
        for c in rest:
            test = test & F.coalesce(F.col(f"`{c}`").try_cast("double") == 0, F.lit(False))
    return Split(df.where(test), df.where(~test))


def is_missing(c: Column, missing: str = ".") -> Column:
    return c.isNull() | (c.cast("string") == missing)


def missing_counts(df: DataFrame, columns: Sequence[str], missing: str = ".") -> DataFrame:
    """Rows ``(column, missing, present)`` in one pass."""
    one = df.agg(*[F.sum(is_missing(F.col(f"`{c}`"), missing).cast("long")).alias(c) for c in columns], F.count(F.lit(1)).alias("__n"))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing"), (F.col("__n") - F.col(f"`{c}`")).alias("present")) for c in columns]))
    return one.select(pairs.alias("p")).select("p.*")


def row_missing(df: DataFrame, columns: Sequence[str], missing: str = ".") -> Column:
    """How many of the columns are missing in a row."""
    return reduce(lambda a, b: a + b, [is_missing(F.col(f"`{c}`"), missing).cast("int") for c in columns])


def few_missing(df: DataFrame, columns: Sequence[str], most: int, missing: str = ".") -> Split:
    n = row_missing(df, columns, missing)
    return Split(df.where(n <= most), df.where(n > most))


@dataclass
class Fetched:
    found: DataFrame
    not_in_identifiers: DataFrame
    identifiers_not_found: DataFrame


def fetch(haystack: DataFrame, identifiers: DataFrame, key: str, order: str, id_key: str | None = None, append: bool = False, every: bool = False) -> Fetched:
    """Haystack rows whose key is among the identifiers, and what is left on both sides.

    Only the first instance of a key by ``order`` is found unless ``every``;
    ``append`` adds the identifier table's other columns.
    """
    id_key = id_key or key
    ids = identifiers.withColumnRenamed(id_key, key)
    ids = ids.dropDuplicates([key])
    hit = haystack.join(ids, key) if append else haystack.join(ids.select(key), key, "left_semi")
    if not every:
        hit = first_rows(hit, [key], order, 1)
    return Fetched(hit, haystack.join(ids.select(key), key, "left_anti"), ids.join(haystack.select(key), key, "left_anti"))


def first_rows(df: DataFrame, keys: Sequence[str | Column], order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return df.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")


def token_counts(df: DataFrame, column: str, sep: str | None = None) -> DataFrame:
    """Rows ``(tokens, records)``."""
    return df.groupBy(tokens(F.col(column), sep).alias("tokens")).agg(F.count(F.lit(1)).alias("records"))


def tokens(c: Column, sep: str | None = None) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")) if sep is None else F.size(F.split(c, f"\\Q{sep}\\E", -1))


def irregular(df: DataFrame, column: str, order: str, group: str, sep: str | None = None, against: str = "previous") -> DataFrame:
    """Records whose token count differs from the previous or the first record of their group (a file)."""
    w = W.partitionBy(group).orderBy(order)
    n = tokens(F.col(column), sep)
    base = F.lag(n).over(w) if against == "previous" else F.first(n).over(w)
    return df.withColumn("tokens", n).withColumn("expected", base).where("expected is not null and tokens <> expected")


def column_profile(df: DataFrame, columns: Sequence[str], missing: str = ".") -> DataFrame:
    """Per column: n, missing, distinct, most_common, median, minval, maxval, var; one aggregation after one unpivot."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("cell")) for c in columns])).alias("p")).select("p.*")
    cells = long.groupBy("column", "cell").agg(F.count(F.lit(1)).alias("k"))
    gone = is_missing(F.col("cell"), missing)
    x = F.when(~gone, F.col("cell").try_cast("double"))
    byval = cells.groupBy("column", x.alias("x")).agg(F.sum("k").alias("k"))
    k = F.when(F.col("x").isNotNull(), F.col("k"))
    some = byval.groupBy("column").agg(
        F.coalesce(F.sum(k), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("k"))), F.lit(0)).alias("missing"),
        F.count("x").alias("distinct_values"),
        F.coalesce(F.max(k), F.lit(0)).alias("most_common"),
        F.min("x").alias("minval"),
        F.max("x").alias("maxval"),
        F.sum(F.col("x") * k).alias("s"),
        F.sum(F.col("x") * F.col("x") * k).alias("q"),
    )
    return some.withColumn("var", F.when(F.col("n") > 1, F.greatest((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0)))).drop("s", "q")


def enough_variance(df: DataFrame, columns: Sequence[str], min_distinct: int = 2, max_common: float | None = None, max_missing: float | None = None, min_variance: float | None = None, min_range: float | None = None, keep: int | None = None, missing: str = ".") -> list[str]:
    """The columns that vary enough, in table order; ``keep`` the most distinct of them."""
    kept = []
    for r in column_profile(df, columns, missing).collect():  # one row per column
        n = r.n or 0
        all_ = n + r.missing
        if r.distinct_values <= 1 or r.distinct_values < min_distinct:
            continue
        if max_common is not None and r.most_common / n > max_common:
            continue
        if max_missing is not None and (r.missing > 0 if max_missing == 0 else r.missing / all_ >= max_missing):
            continue
        if min_variance is not None and (r["var"] or 0.0) < min_variance:
            continue
        if min_range is not None and r.maxval - r.minval < min_range:
            continue
        kept.append((r["column"], r.distinct_values))
    if keep is not None:
        kept = sorted(kept, key=lambda x: (-x[1], columns.index(x[0])))[:keep]
    names = {c for c, _ in kept}
    return [c for c in columns if c in names]
