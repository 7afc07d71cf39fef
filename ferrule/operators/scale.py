"""Scaling, encoding and conversion between descriptors and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ferrule.plans.ranking import ranked

Ranges = dict[str, dict[str, float]]


def column_ranges(df: DataFrame, columns: Sequence[str], missing: str = ".") -> Ranges:
    """n, min, max, mean and sd of each column: the profile that scaling uses and can persist."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.when(F.col(f"`{c}`").cast("string") != missing, F.col(f"`{c}`").cast("double"))
        aggs += [f(x).alias(f"{n}{i}") for n, f in (("n", F.count), ("min", F.min), ("max", F.max), ("mean", F.avg), ("sd", F.stddev_samp))]
    row = df.agg(*aggs).first()  # five numbers a column
    return {c: {k: row[f"{k}{i}"] for k in ("n", "min", "max", "mean", "sd")} for i, c in enumerate(columns)}


def save_ranges(ranges: Ranges, spark, path: str) -> None:
    """A profile as a small Parquet table, one row per column."""
    rows = [(c, r["n"], *(None if r[k] is None else float(r[k]) for k in ("min", "max", "mean", "sd"))) for c, r in ranges.items()]
    spark.createDataFrame(rows, "name string, n long, min double, max double, mean double, sd double").coalesce(1).write.mode("overwrite").parquet(path)


def load_ranges(spark, path: str) -> Ranges:
    return {r["name"]: {k: r[k] for k in ("n", "min", "max", "mean", "sd")} for r in spark.read.parquet(path).collect()}  # a row per column


def normalise(df: DataFrame, ranges: Ranges, kind: str = "01", top: float = 1.0, offset: float = 0.0, drop_constant: bool = False, out_of_range: str = "allow") -> DataFrame:
    """Columns scaled by ``ranges``.

    ``01`` to [0, top], ``11`` to [-1, 1], ``uv`` to unit variance, ``mc`` to
    mean zero, ``byte`` to whole numbers 0-255.  Constant columns stay or are
    dropped; values outside the range are allowed, truncated, or null
    (``fail``).  ``.`` stays missing.
    """
    cols = []
    for c in df.columns:
        r = ranges.get(c)
        if r is None:
            cols.append(F.col(f"`{c}`"))
            continue
        if r["min"] is None or r["min"] == r["max"]:
            if not drop_constant:
                cols.append(F.col(f"`{c}`"))
            continue
        x = F.col(f"`{c}`").try_cast("double") if kind else None
        if out_of_range == "truncate":
            x = F.least(F.greatest(x, F.lit(r["min"])), F.lit(r["max"]))
        elif out_of_range == "fail":
            x = F.when((x >= r["min"]) & (x <= r["max"]), x)
        unit = (x - r["min"]) / (r["max"] - r["min"])
        y = {"01": unit * top + offset, "11": unit * 2 - 1, "uv": (x - r["mean"]) / r["sd"], "mc": x - r["mean"], "byte": F.floor(unit * 255 + 0.5).cast("double")}[kind]
        cols.append(y.alias(c))
    return df.select(*cols)


def unscale(df: DataFrame, ranges: Ranges, kind: str = "01", top: float = 1.0, offset: float = 0.0, to_integer: bool = False) -> DataFrame:
    """The reverse of ``normalise``."""
    cols = []
    for c in df.columns:
        r = ranges.get(c)
        if r is None or r["min"] == r["max"]:
            cols.append(F.col(f"`{c}`"))
            continue
        y = F.col(f"`{c}`").cast("double")
        wide = r["max"] - r["min"]
        x = {"01": (y - offset) / top * wide + r["min"], "11": (y + 1) / 2 * wide + r["min"], "uv": y * r["sd"] + r["mean"], "mc": y + r["mean"], "byte": y / 255 * wide + r["min"]}[kind]
        cols.append((F.floor(x + 0.5) if to_integer else x).alias(c))
    return df.select(*cols)


def class_labels(df: DataFrame, column: str) -> DataFrame:
    """Rows ``(label, number, n)``: classes numbered from 0 in order of their names, with counts.

    One row per class is ranked."""
    counts = df.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("label", (F.row_number().over(W.orderBy("label")) - 1).cast("int").alias("number"), "n")


def translate_labels(df: DataFrame, column: str, labels: DataFrame, out: str = "number") -> DataFrame:
    known = labels.select(F.col("label").alias(column), F.col("number").alias(out))
    return df.join(known, column, "left")


def correlate(columns: np.ndarray, target: np.ndarray, tolerance: float = 0.05, steps: int = 20000, seed: int = 0) -> np.ndarray:
    """``columns`` (n x k) with values swapped within columns until correlations come within ``tolerance`` of ``target``.

    A swap is kept if it lowers the summed squared difference; marginal
    distributions do not change.
    """
    rng = np.random.default_rng(seed)
    x = np.array(columns, float)
    n, k = x.shape
    z = x - x.mean(axis=0)
    norm = np.sqrt((z**2).sum(axis=0))
    z = z / np.where(norm == 0, 1, norm)
    cross = z.T @ z
    off = ~np.eye(k, dtype=bool)
    for _ in range(steps):
        if np.abs(cross - target)[off].max() <= tolerance:
            break
        c, (i, j) = int(rng.integers(k)), rng.integers(n, size=2)
        change = (z[i, c] - z[j, c]) * (z[j] - z[i])
        change[c] = 0
        new = cross[c] + change
        keep = np.arange(k) != c
        if ((new - target[c])[keep] ** 2).sum() < ((cross[c] - target[c])[keep] ** 2).sum():
            cross[c, keep] = cross[keep, c] = new[keep]
            z[[i, j], c] = z[[j, i], c]
            x[[i, j], c] = x[[j, i], c]
    return x


# Fingerprints in long form are rows (id, bit, cnt).


def token_bit(c: Column) -> Column:
    """An unsigned 32-bit number of a token: the first eight hex digits of its MD5."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def fingerprint_of_tokens(df: DataFrame, id_column: str, tokens: Column) -> DataFrame:
    """Long fingerprint of arrays of tokens: each distinct token is a bit, its count the times it occurs."""
    return df.select(F.col(id_column).alias("id"), F.explode(tokens).alias("token")).groupBy("id", token_bit(F.col("token")).alias("bit")).agg(F.count(F.lit(1)).cast("int").alias("cnt"))


def bit_dictionary(fp: DataFrame) -> DataFrame:
    """Rows ``(bit, ordinal, n)``: bits numbered from 0 by falling frequency, then by number."""
    counts = fp.groupBy("bit").agg(F.count(F.lit(1)).alias("n"))
    return ranked(counts, [], [F.desc("n"), "bit"]).select("bit", (F.col("rank") - 1).alias("ordinal"), "n")


def supported_bits(fp: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """Bits set in at least ``least`` and at most ``most`` records, with their support ``n``."""
    counts = fp.groupBy("bit").agg(F.count(F.lit(1)).alias("n"))
    out = counts.where(F.col("n") >= least)
    return out if most is None else out.where(F.col("n") <= most)


def subset_bits(fp: DataFrame, bits: DataFrame, meaning: str | None = None) -> DataFrame:
    """Only the bits of a trained subset, with a column of it if named."""
    return fp.join(bits.select("bit", *([meaning] if meaning else [])), "bit")


def as_maps(fp: DataFrame) -> DataFrame:
    """Rows ``(id, fp map<bigint,int>)``."""
    return fp.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bit", "cnt"))).alias("fp"))


def to_descriptors(fp: DataFrame, bits: Sequence[int], prefix: str = "b", absent: int = 0, min_nonzero: int = 0) -> DataFrame:
    """One column per bit, named by it; rows with fewer non-zero columns than ``min_nonzero`` go."""
    out = fp.where(F.col("bit").isin(list(bits))).groupBy("id").pivot("bit", list(bits)).agg(F.first("cnt"))
    out = out.join(fp.select("id").distinct(), "id", "right").na.fill(0)
    if min_nonzero:
        out = out.where(sum((F.col(str(b)) != 0).cast("int") for b in bits) >= min_nonzero)
    return out.select("id", *[(F.when(F.col(str(b)) == 0, absent).otherwise(F.col(str(b))) if absent else F.col(str(b))).cast("int").alias(f"{prefix}{b}") for b in bits])


def fold_bits(fp: DataFrame, width: int) -> DataFrame:
    """Bits modulo ``width``, counts added."""
    return fp.groupBy("id", F.pmod("bit", F.lit(width)).alias("bit")).agg(F.sum("cnt").cast("int").alias("cnt"))


def to_dense(fp: DataFrame, width: int, threshold: int = 1) -> DataFrame:
    """Rows ``(id, words array<bigint>)``: folded bits whose count reaches the threshold, 64 a word."""
    on = fold_bits(fp, width).where(F.col("cnt") >= threshold)
    words = on.groupBy("id", F.floor(F.col("bit") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("v"))
    maps = words.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("m"))
    cells = F.array(*[F.coalesce(F.try_element_at("m", F.lit(i)), F.lit(0).cast("long")) for i in range((width + 63) // 64)])
    return maps.select("id", cells.alias("words"))


def svm_lite(fp: DataFrame, labels: DataFrame, id_column: str = "id", label: str = "label") -> DataFrame:
    """Rows ``(id, line)``: ``label bit:count ...`` in order of bits; records without a label go."""
    feats = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bit", "cnt"))), lambda x: F.concat_ws(":", x["bit"].cast("string"), x["cnt"].cast("string"))), " ")
    lines = fp.groupBy("id").agg(feats.alias("f"))
    return lines.join(labels.select(F.col(id_column).alias("id"), F.col(label).cast("string").alias("l")), "id").select("id", F.concat_ws(" ", "l", "f").alias("line"))


def bin_descriptors(df: DataFrame, id_column: str, columns: Sequence[str], ranges: Ranges, divisions: int = 10, replicates: int = 1, separate: bool = False) -> DataFrame:
    """Long fingerprint of numeric columns cut into ``divisions``: a bit per column with the bucket as its count, or a bit
    per column and bucket if ``separate``; ``replicates`` sets each again."""
    cells = []
    for i, c in enumerate(columns):
        r = ranges[c]
        wide = (r["max"] - r["min"]) / divisions or 1.0
        bucket = F.least(F.floor((F.col(f"`{c}`").cast("double") - r["min"]) / wide), F.lit(divisions - 1)).cast("int")
        for k in range(replicates):
            base = i * replicates + k
            cells.append(F.struct((F.lit(base * (divisions if separate else 1)) + (bucket if separate else F.lit(0))).cast("long").alias("bit"), (F.lit(1) if separate else bucket + 1).cast("int").alias("cnt")))
    return df.select(F.col(id_column).alias("id"), F.explode(F.array(*cells)).alias("p")).select("id", "p.*").where("cnt is not null and bit is not null")


def threshold_bits(df: DataFrame, id_column: str, columns: Sequence[str], above: float = 0.0) -> DataFrame:
    """Long fingerprint: bit i where column i exceeds a value."""
    cells = F.array(*[F.when(F.col(f"`{c}`").cast("double") > above, F.lit(i).cast("long")) for i, c in enumerate(columns)])
    return df.select(F.col(id_column).alias("id"), F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("bit")).withColumn("cnt", F.lit(1))


def add_descriptors(fp: DataFrame, descriptors: DataFrame, id_column: str, columns: Sequence[str]) -> DataFrame:
    """Fingerprint records with a float vector of their descriptors."""
    vec = descriptors.select(F.col(id_column).alias("id"), F.array(*[F.col(f"`{c}`").cast("float") for c in columns]).alias("desc"))
    return fp.join(vec, "id")
