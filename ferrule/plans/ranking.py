"""Ranks and running totals of ordered groups of any size.

A window over a group puts the group in one task.  Here rows are range
partitioned by group and order, each partition counts its own stretch, and the
stretches are set off against one another by their totals: one small row per
partition and group.  A group that holds a third of all rows is thus spread
over a third of the tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .staging import staged

_PLACE = (1 << 33) - 1


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], sums: Mapping[str, str] | None = None, peaks: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with ``rank``, from 1 in each group by ``order``, which must leave no ties.

    ``sums`` names running sums of columns, the row included; ``peaks`` running
    maxima.  Nulls add nothing; a null group is a group.  Staged.
    """
    sums, peaks = dict(sums or {}), dict(peaks or {})
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(*group, *order) if group else df.repartitionByRange(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))
    rows = staged(dealt.sortWithinPartitions(*group, *order).withColumns({"_part": F.spark_partition_id(), "_pos": place}), "ranked")
    inside = W.partitionBy("_part", *group).orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    here = {"_n": F.row_number().over(W.partitionBy("_part", *group).orderBy("_pos"))}
    here |= {f"_s{i}": F.sum(c).over(inside) for i, c in enumerate(sums.values())}
    here |= {f"_m{i}": F.max(c).over(inside) for i, c in enumerate(peaks.values())}
    ends = [F.count(F.lit(1)).alias("_n")]
    ends += [F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())]
    ends += [F.max(c).alias(f"_m{i}") for i, c in enumerate(peaks.values())]
    stretch = rows.groupBy("_part", *group).agg(*ends)
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    start = stretch.select(
        F.col("_part").alias("_p"),
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_bn"),
        *[F.sum(f"_s{i}").over(before).alias(f"_bs{i}") for i in range(len(sums))],
        *[F.max(f"_m{i}").over(before).alias(f"_bm{i}") for i in range(len(peaks))],
    )
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col("_part") == F.col("_p"))
    zero = F.lit(0)
    return rows.withColumns(here).join(start, same).select(
        *df.columns,
        (F.col("_n") + F.col("_bn")).cast("long").alias("rank"),
        *[(F.coalesce(F.col(f"_s{i}"), zero) + F.coalesce(F.col(f"_bs{i}"), zero)).alias(name) for i, name in enumerate(sums)],
        *[F.greatest(f"_m{i}", f"_bm{i}").alias(name) for i, name in enumerate(peaks)],
    )
