"""Single-pass operators over streams: pass-through filters, duplicate removal, running leaders and windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ferrule.functions.expressions import compile_filter


def filter_stream(stream: DataFrame, expression: str, **options) -> DataFrame:
    """The rows of a stream that pass a descriptor filter; stateless."""
    return stream.where(compile_filter(expression, stream.columns, **options))


def distinct_stream(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """The first row of each key that arrives; keys are forgotten ``delay`` after the watermark passes them."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(stream: DataFrame, event_time: str, width: str, slide: str | None, keys: Sequence[str], value: str, delay: str) -> DataFrame:
    """Count and sum per key and tumbling or sliding window; late rows beyond ``delay`` do not count."""
    w = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    return stream.withWatermark(event_time, delay).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(stream: DataFrame, event_time: str, gap: str, keys: Sequence[str], delay: str) -> DataFrame:
    """Sessions of each key, ended by a gap."""
    return stream.withWatermark(event_time, delay).groupBy(F.session_window(event_time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there and stop: a restart goes on where it ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def leader_stream(stream: DataFrame, spark: SparkSession, centres_path: str, checkpoint: str, assign: Callable[[DataFrame, DataFrame | None], DataFrame]) -> StreamingQuery:
    """Sphere exclusion over batches: ``assign(batch, centres)`` returns new centres, which join the table for later batches.

    A batch writes its centres under its own number, so a batch that is run
    again replaces what it wrote before.
    """

    def batch(df: DataFrame, number: int) -> None:
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(centres_path)
        exists = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)
        centres = spark.read.parquet(centres_path).where(F.col("batch") < number).drop("batch") if exists else None
        assign(df, centres).write.mode("overwrite").parquet(f"{centres_path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
