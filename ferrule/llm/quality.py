"""Document quality by random Fourier features, ridge regression and isotonic calibration.

Statistics of the whole text are standardised by the labelled rows and mapped
to cosines of random projections, whose inner products approximate a Gaussian
kernel.  Partitions sum their normal equations by fold; the driver solves the
few hundred unknowns.  Scores of left-out folds are binned and made monotone
against the labels (pool adjacent violators), which turns a score into a
probability.  Only labelled rows are read to fit; then every row is read once
to score it, and nothing but the labelled rows' statistics is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ferrule.plans.bitmap import bitmap, held
from ferrule.plans.staging import staged

from .common import utf8

N_STATS, FOLDS, BINS = 24, 4, 1000
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t", "line": b"\n", "stop": b".", "comma": b",;:", "bang": b"!?", "pipe": b"|", "mark": b"*#$%&@^~", "bracket": b"()[]{}<>", "slash": b"/\\_=+-"}
_INDEX = [np.frombuffer(v, np.uint8) for v in _CLASSES.values()]


def statistics(text: bytes) -> list[float]:
    """Shares, lengths and repetition measures of a whole text; zeros for an empty one."""
    n = len(text)
    if not n:
        return [0.0] * N_STATS
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = hist / n
    words = text.split()
    lines = [x for x in text.split(b"\n") if x]
    count, many = Counter(words), max(1, len(words))
    often = sorted(count.values(), reverse=True)[:5]
    some = share[share > 0]
    letters = sum(map(len, words))
    return [
        *(float(share[i].sum()) for i in _INDEX),
        float(share[128:].sum()),
        float(-(some * np.log2(some)).sum()),
        float(np.log1p(n)),
        letters / many,
        max(map(len, words), default=0) ** 0.5,
        len(count) / many,
        len(count) / many**0.7,
        often[0] / many if often else 0.0,
        sum(often) / many,
        len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        sum(1 for w in count if w[-1:] in b".!?*#$%&|,") / max(1, len(count)),
    ]


def document_statistics(docs: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """Rows ``(doc_id, x array<float>)``, one per row of ``docs``; with a bitmap only of rows whose doc_id it may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if bits is not None:
                b = b.filter(pa.array(held(bits, b.column(2).to_numpy(zero_copy_only=False))))
            x = np.array([statistics(t) for t in utf8(b.column(1))], np.float32).reshape(-1, N_STATS)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_STATS, pa.int32()), pa.array(x.ravel()))
            yield pa.record_batch([b.column(0), lists], ["doc_id", "x"])

    doc_id = F.col("doc_id").cast("long")
    cols = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(doc_id).alias("h"))
    return cols.mapInArrow(run, "doc_id long, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, N_STATS)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        phi = np.cos(z @ self.omega + self.phase) * (2 / self.omega.shape[1]) ** 0.5
        return np.hstack([phi, z / 6, np.ones((len(z), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(x) @ self.weights, *self.knots), 0.0, 1.0)


def pool_adjacent(y: np.ndarray, w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit: positions and values of its blocks, by weight."""
    blocks: list[list[float]] = []
    for v, n, p in zip(y, w, at):
        blocks.append([v, n, p])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            n = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / n, n, (a[2] * a[1] + b[2] * b[1]) / n])
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


def _moments(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each statistic; sums of partitions are summed again before they reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(N_STATS), np.zeros(N_STATS)
        for b in batches:
            x = _matrix(b.column(0))
            n, s, q = n + len(x), s + x.sum(0), q + (x**2).sum(0)
        yield pa.record_batch([pa.array(range(N_STATS), pa.int32()), pa.array([n] * N_STATS, pa.int64()), pa.array(s), pa.array(q)], ["i", "n", "s", "q"])

    parts = train.select("x").mapInArrow(run, "i int, n long, s double, q double")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()  # N_STATS rows
    mean, var = np.zeros(N_STATS), np.zeros(N_STATS)
    for r in rows:
        mean[r.i] = r.s / max(1, r.n)
        var[r.i] = r.q / max(1, r.n) - mean[r.i] ** 2
    return mean, np.where(var > 1e-12, np.sqrt(np.maximum(var, 1e-12)), 1.0)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows ``(doc_id, x, y)``, staged, one per labelled doc_id: copies of a row have one label, so one is enough."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    known = staged(known, "known")
    # Looked up in the pass that makes the statistics: a filter before it would be a second Python worker per task.
    found = document_statistics(docs, bitmap(known, "doc_id")).join(known, "doc_id")
    return staged(found.groupBy("doc_id").agg(F.first("x").alias("x"), F.first("y").alias("y")), "train")


def fit(docs: DataFrame, labels: DataFrame, features: int = 160, ridge: float = 0.3, width: float = 2.0, seed: int = 7) -> QualityModel:
    """A model from ``labels`` (doc_id, quality): rows with a null in either are skipped, repeats of a doc_id averaged.

    Every labelled row of ``docs`` is used.  Without any, every score is 0.5.
    """
    rng = np.random.default_rng(seed)
    train = _labelled(docs, labels)
    mean, scale = _moments(train)
    omega = rng.normal(size=(N_STATS, features)) / (width * N_STATS**0.5)
    phase = rng.uniform(0, 2 * np.pi, features)
    dim = features + N_STATS + 1
    blank = QualityModel(mean, scale, omega, phase, np.zeros(dim), (np.array([0.0]), np.array([0.5])))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, dim, dim + 1))
        for b in batches:
            phi, y, f = blank.features(_matrix(b.column(0))), np.asarray(b.column(1)), np.asarray(b.column(2))
            for k in range(FOLDS):
                p = phi[f == k]
                total[k] += np.hstack([p.T @ p, (p.T @ y[f == k])[:, None]])
        yield pa.record_batch([pa.array(np.repeat(np.arange(FOLDS), dim), pa.int32()), pa.array(np.tile(np.arange(dim), FOLDS), pa.int32()), pa.array([r.tobytes() for r in total.reshape(-1, dim + 1)], pa.binary())], ["fold", "i", "v"])

    def added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v = sum(np.frombuffer(r, np.float64) for r in rows["v"])
        return pd.DataFrame({"fold": [key[0]], "i": [key[1]], "v": [v.tobytes()]})

    parts = train.select("x", "y", fold.alias("fold")).mapInArrow(sums, "fold int, i int, v binary")
    system = np.zeros((FOLDS, dim, dim + 1))
    for r in parts.groupBy("fold", "i").applyInPandas(added, "fold int, i int, v binary").collect():  # FOLDS x dim rows
        system[r.fold, r.i] = np.frombuffer(r.v, np.float64)

    def solve(s: np.ndarray) -> np.ndarray:
        return np.linalg.solve(s[:, :-1] + ridge * np.eye(dim), s[:, -1])

    whole = system.sum(0)
    if not whole.any():
        return blank
    apart = np.stack([solve(whole - s) for s in system])
    low, high = -0.5, 1.5

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.zeros((BINS, 3))
        for b in batches:
            phi, y, f = blank.features(_matrix(b.column(0))), np.asarray(b.column(1)), np.asarray(b.column(2))
            raw = np.clip((phi * apart[f]).sum(1), low, high)
            i = np.minimum(((raw - low) / (high - low) * BINS).astype(int), BINS - 1)
            t += np.stack([np.bincount(i, w, BINS) for w in (np.ones(len(y)), y, raw)], 1)
        at = np.flatnonzero(t[:, 0])
        yield pa.record_batch([pa.array(at, pa.int32()), *(pa.array(t[at, k]) for k in range(3))], ["bin", "n", "y", "r"])

    table = train.select("x", "y", fold.alias("fold")).mapInArrow(bins, "bin int, n double, y double, r double")
    got = table.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("r").alias("r")).orderBy("bin").collect()  # BINS rows at most
    n, y, r = (np.array([x[c] for x in got]) for c in ("n", "y", "r"))
    at, value = pool_adjacent(y / n, n, r / n)
    at, value = np.concatenate([[min(low, at[0]) - 1], at, [max(high, at[-1]) + 1]]), np.concatenate([[0.0], value, [1.0]])
    return QualityModel(mean, scale, omega, phase, solve(whole), (at, value))


def _scores(texts: Iterator[bytes], model: QualityModel) -> np.ndarray:
    x = np.array([statistics(t) for t in texts], np.float32).astype(np.float64).reshape(-1, N_STATS)
    return model.score(x) if len(x) else np.zeros(0)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, accept: float = 0.7, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.  Labels of held-out documents are not learned from.

    Null and empty texts have all statistics zero and the score that these
    earn.  A null doc_id is scored like any other and is never held out.
    Repeated rows have one score each; an empty table gives no rows.
    """
    model = fit(docs, labels.where(~held_out()), **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(_scores(utf8(b.column(1)), model))], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def keep_accepted(docs: DataFrame, labels: DataFrame, accept: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``accept`` or more; no row is shuffled.

    Null texts, rows without a doc_id, repeats and empty tables as in ``classify``."""
    model = fit(docs, labels.where(~held_out()), **options)

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.string())
            yield b.filter(pa.array(_scores(utf8(texts), model) >= accept))

    return docs.mapInArrow(passes, docs.schema)
