"""Sharding along a Hilbert curve for multidimensional file pruning.

Several metadata dimensions are quantised at percentiles of all rows, strings
by their whole values.  The cells are numbered along a Hilbert curve, rows are
range-partitioned by that number, and the run is cut into shards of equally
many rows.  Rows close in all dimensions share a file, so minima and maxima
prune on each of them.  Equal texts lie next to one another: a text takes the
cell of its least metadata.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import NumericType, StringType

from ferrule.plans.ranking import ranked
from ferrule.plans.staging import staged

BITS = 8


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Curve numbers of integer points, one per row of ``cells`` (n x d, values below 2**bits, d * bits at most 63)."""
    x = [c.astype(np.uint64) for c in np.asarray(cells).T]
    zero, top = np.uint64(0), 1 << (bits - 1)
    # Undo the excess work of each level: reflect or exchange the lower bits.
    q = top
    while q > 1:
        p = np.uint64(q - 1)
        for c in x:
            on = (c & np.uint64(q)) != 0
            swap = np.where(on, zero, (x[0] ^ c) & p)
            x[0] ^= np.where(on, p, swap)
            if c is not x[0]:
                c ^= swap
        q >>= 1
    # Gray code across the dimensions.
    for a, b in zip(x, x[1:]):
        b ^= a
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn ^= np.where((x[-1] & np.uint64(q)) != 0, np.uint64(q - 1), zero)
        q >>= 1
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for c in x:
            out = (out << np.uint64(1)) | (((c ^ turn) >> np.uint64(bit)) & np.uint64(1))
    return out.astype(np.int64)


def _orderable(c: Column, kind) -> Column:
    """A number as a double, anything else as its whole string; strings sort by code point."""
    return c.cast("double") if isinstance(kind, NumericType) else c.cast(StringType())


def _string_cuts(rows: DataFrame, column: str, steps: int) -> list[str]:
    """The sorted values of a string column at which another ``steps``-th of all rows is full: at most ``steps`` values.

    Every row counts and values are compared whole; a value that holds a step's
    share of the rows is a cut of its own."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    run = ranked(counts, [], ["v"], sums={"upto": "n"})
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    step = lambda c: F.floor(c * steps / max(1, total))
    return sorted(r.v for r in run.where(step(F.col("upto")) > step(F.col("upto") - F.col("n"))).select("v").collect())


def hilbert_order(docs: DataFrame, dims: Sequence[str] = ("source", "lang", "size"), bits: int = BITS) -> DataFrame:
    """Rows ``(doc_id, size, text_crc32, h, cell, part, pos)``, staged: ``pos`` counts within sorted partition ``part``.

    A dimension is a column of ``docs`` or ``size``, the bytes of the text plus
    one; a null in one lies before all values, null text counts as empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    kinds = {f.name: f.dataType for f in docs.schema}
    value = [size.cast("double") if d == "size" else _orderable(F.col(d), kinds[d]) for d in dims]
    names = [f"d{i}" for i in range(len(dims))]
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), *[v.alias(a) for v, a in zip(value, names)]), "meta")
    texts = rows.groupBy("h").agg(*[F.min(a).alias(a) for a in names])
    steps = F.array(*[F.lit(i / 2**bits) for i in range(1, 2**bits)])
    strings = {a for a in names if isinstance(rows.schema[a].dataType, StringType)}
    # 2**bits - 1 numbers of each dimension.
    found = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.percentile_approx(a, steps, F.lit(10000)).alias(a) for a in names if a not in strings]).first()
    cuts = [np.array(_string_cuts(rows, a, 2**bits), object) if a in strings else np.unique(np.array(found[a] or [], float)) for a in names]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = np.zeros((b.num_rows, len(cuts)), np.int64)
            for i, cut in enumerate(cuts):
                v = b.column(i + 1)
                words = cut.dtype == object
                x = v.fill_null("" if words else 0.0).to_numpy(zero_copy_only=False)
                place = np.searchsorted(cut, x, "left" if words else "right") + 1
                code[:, i] = np.where(v.is_null().to_numpy(zero_copy_only=False), 0, np.minimum(place, 2**bits - 1))
            yield pa.record_batch([b.column(0), pa.array(hilbert_index(code, bits))], ["h", "cell"])

    placed = rows.drop(*names).join(texts.mapInArrow(cells, "h long, cell long"), "h")
    ordered = placed.repartitionByRange("cell", "h", "doc_id").sortWithinPartitions("cell", "h", "doc_id")
    number_in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return staged(ordered.select("doc_id", "size", "text_crc32", "h", "cell", F.spark_partition_id().alias("part"), number_in_part.alias("pos")), "curve")


def hilbert_shards(docs: DataFrame, shards: int = 16, dims: Sequence[str] = ("source", "lang", "size"), bits: int = BITS) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, cell, shard, slot.

    Shards differ by at most one row; slots count from 0 without gaps in curve
    order.  Repeated rows each get a slot.  With fewer rows than shards the
    last shards stay empty.
    """
    if len(dims) * bits > 63:
        raise ValueError("too many bits for one index")
    rows = hilbert_order(docs, dims, bits)
    per = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    starts = per.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    total = rows.count()
    base, extra = divmod(total, shards)
    at = F.col("before") + F.col("pos")
    big = extra * (base + 1)
    shard = F.when(at < big, F.floor(at / F.lit(base + 1))).otherwise(extra + F.floor((at - big) / F.lit(max(1, base)))).cast("int")
    first = F.when(F.col("shard") < extra, F.col("shard").cast("long") * (base + 1)).otherwise(big + (F.col("shard").cast("long") - extra) * base)
    out = rows.join(starts, "part").withColumn("at", at).withColumn("shard", shard)
    return out.select("doc_id", "size", "text_crc32", "cell", "shard", (F.col("at") - first).cast("long").alias("slot"))
