"""Sorting, random records and stratified splits.

Random choices rank records by the MD5 of a seed and their identifier, so that
they can be repeated anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ferrule.plans.ranking import ranked


def sort_by(df: DataFrame, keys: Sequence[str], tie: str) -> DataFrame:
    """Rows ordered by keys, ``-key`` descending, then by ``tie``."""
    return df.orderBy(*[F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in keys], tie)


def leading_number(c: Column) -> Column:
    """The number in a cell after what is no digit, sign or point."""
    return F.regexp_extract(c, r"(-?[0-9]+\.?[0-9]*)", 1).try_cast("double")


def shuffled(id_column: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))


def random_records(df: DataFrame, n: int, id_column: str, seed: int = 0) -> DataFrame:
    """``n`` rows, each set of n equally likely."""
    return df.withColumn("__h", shuffled(id_column, seed)).orderBy("__h", id_column).limit(n).drop("__h")


def bernoulli(df: DataFrame, p: float, id_column: str, seed: int = 0) -> DataFrame:
    """Each row with chance ``p``."""
    limit = f"{min(int(p * 16**8), 16**8 - 1):08x}"
    return df.where(F.substring(shuffled(id_column, seed), 1, 8) < limit) if p < 1 else df


def with_replacement(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    return df.sample(withReplacement=True, fraction=fraction, seed=seed)


def records_by_number(df: DataFrame, order: str, wanted: Sequence[int], following: int = 0) -> DataFrame:
    """Rows with these values of an order column, each with the next ones."""
    numbers = sorted({n + k for n in wanted for k in range(following + 1)})
    return df.where(F.col(order).isin(numbers))


def stratified_split(df: DataFrame, stratum: str, id_column: str, train_fraction: float, seed: int = 0) -> DataFrame:
    """``split``: train or test.  Every stratum gives the same number to train, int(f n / strata) but 1 at least."""
    sizes = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(stratum).alias("s"))
    need = F.greatest(F.floor(F.floor(F.lit(train_fraction) * F.col("n")) / F.col("s")), F.lit(1))
    rows = ranked(df.withColumn("__key", shuffled(id_column, seed)), [stratum], ["__key", id_column])
    out = rows.crossJoin(F.broadcast(sizes.select(need.alias("__need"))))  # one row
    return out.withColumn("split", F.when(F.col("rank") <= F.col("__need"), "train").otherwise("test")).drop("__need", "__key", "rank")


def split_file(df: DataFrame, order: str, per_file: int, group: Sequence[str] = ()) -> DataFrame:
    """``file``: chunks of ``per_file`` rows in order within each group."""
    return ranked(df, group, [order]).withColumn("file", F.floor((F.col("rank") - 1) / per_file).cast("long")).drop("rank")


def random_neighbours(df: DataFrame, item: str, neighbour: str, distance: str, n: int, seed: int = 0, favour_close: bool = False) -> DataFrame:
    """``n`` neighbours of each item at random, closer ones likelier if asked."""
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(item).cast("string"), F.col(neighbour).cast("string"))), 1, 8), 16, 10).cast("double") + 1) / F.lit(16.0**8 + 1)
    key = F.pow(u, 1 / F.greatest(1 - F.col(distance), F.lit(1e-6))) if favour_close else u
    return df.withColumn("__r", F.row_number().over(W.partitionBy(item).orderBy(F.desc(key), neighbour))).where(F.col("__r") <= n).drop("__r")
