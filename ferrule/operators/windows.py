"""Running, ranking and bucketing operations over ordered records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def running_average(df: DataFrame, value: str, last: int, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``running``: the mean of the last ``last`` values of a group, this one included."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(1 - last, 0)
    return df.withColumn("running", F.avg(F.col(value).cast("double")).over(w))


def most_recent(df: DataFrame, value: str, last: int, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``recent``: the last ``last`` values, oldest first."""
    return df.withColumn("recent", F.collect_list(value).over(W.partitionBy(*group).orderBy(*order).rowsBetween(1 - last, 0)))


def equal_population_bucket(group: Sequence[str], order: Sequence[str], buckets: int) -> Column:
    """Bucket i // (n // buckets) of the i-th row of n, the last bucket taking the rest."""
    w = W.partitionBy(*group)
    i = F.row_number().over(w.orderBy(*order)) - 1
    size = F.greatest(F.floor(F.count(F.lit(1)).over(w) / buckets), F.lit(1))
    return F.least(F.floor(i / size), F.lit(buckets - 1)).cast("int")


def equal_width_bucket(value: str, group: Sequence[str], buckets: int) -> Column:
    """floor((x - min) / dx); the greatest value is in bucket ``buckets``."""
    w = W.partitionBy(*group)
    x = F.col(value).cast("double")
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high == low, F.lit(0)).otherwise(F.floor((x - low) / ((high - low) / buckets))).cast("int")


def islands(df: DataFrame, keys: Sequence[str], group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``island``: counts the runs of equal keys along the order, from 1."""
    w = W.partitionBy(*group).orderBy(*order)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(w))
    flag = F.when(same & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__new", flag).withColumn("island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("__new")
