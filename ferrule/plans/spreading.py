"""Keep all cores busy on tables of few files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as the session has cores.

    A table of one row group is one task, however dear its rows are.  Tables
    of more partitions come back as they are, so large ones are never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores)
