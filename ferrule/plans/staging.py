"""Tables staged in the folder that all executors share.

Iterative and multi-pass operators write an intermediate result once as
Parquet and read it back.  That cuts the lineage, survives a lost executor
and lets later passes prune columns.  The folder is the session's
``spark.checkpoint.dir``; only where that is unset (tests, a laptop) a folder
of this process is made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="ferrule-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def staged(df: DataFrame, tag: str = "t") -> DataFrame:
    """``df`` written to the shared folder and read again with the same schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Remove a staged table that nothing will read again."""
    sc = df.sparkSession.sparkContext
    for name in df.inputFiles()[:1]:
        path = sc._jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
