"""Send this package to the Python workers of a session that may not have it installed."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_NAME = "ferrule-workers.zip"


def ship(spark: SparkSession) -> None:
    """Add the package to the workers' path, once per Spark context."""
    sc = spark.sparkContext
    if _NAME in sc._python_includes:
        return
    root = Path(__file__).resolve().parent.parent
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="ferrule-ship-")), _NAME)
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(path)


def shipped(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``f(spark, ...)``, with the package shipped first."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args, **options) -> DataFrame:
        ship(spark)
        return f(spark, *args, **options)

    return run
