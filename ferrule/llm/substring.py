"""Substring dedup: words in windows of W words that occur twice anywhere go.

A window's minimizer is the leftmost least hash of its m-word grams, and the
windows that share one minimizer place form a segment.  Equal windows have
equal minimizers, so all places where a window can recur lie in the segments
of one minimizer.  Segments are counted by minimizer and content:

* a minimizer seen once holds no repeated window;
* the segments of any other meet in the minimizer's shard, one row for equal
  ones.  Each shard builds a succinct FM-index of its segments, in which each
  weighs as often as it occurs, and backward search over its wavelet tree gives
  the matching statistics of every place: a window is repeated where they
  reach W words with a weight of two;
* a minimizer with more distinct segments than a shard should hold (a line
  that a third of all documents quote) is not given to one shard: its windows
  are counted by their own hashes, which spread over all tasks.  An index
  cannot be cut there: a window of one part may recur in any other.

Words are 64-bit hashes; segments are compared by minimizer and content hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ferrule.plans.staging import staged

from .common import utf8
from .fmindex import FMIndex
from .wordhash import P as _P, hash_spans, mix as _mix

GRAM = 8
#: Words of segments in one FM-index, on average.
SHARD_WORDS = 1 << 18
#: Distinct segments of one minimizer that one shard takes.
HOT_SEGMENTS = 4096

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_B, _BI = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least ``n``."""
    if len(_pow[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, b in enumerate((_B, _BI)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _pow[i] = np.multiply.accumulate(p)
    return _pow


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of a text, by byte."""
    arr = np.frombuffer(text, np.uint8)
    gap = np.concatenate([[True], _SPACE[arr], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    return hash_spans(arr, start, end), start, end


def segments(h: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimizer, content hash) of each segment of a document's word hashes."""
    n = len(h) - window + 1
    if n < 1:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    g = len(h) - gram + 1
    value = np.zeros(g, np.uint64)
    for k in range(gram):
        value += h[k : k + g] * _P[k]
    value = _mix(value)
    span = window - gram + 1  # grams of one window
    least, where, wide = value, np.arange(g), 1
    while wide < span:
        by = min(wide, span - wide)
        left, right = least[:-by], least[by:]
        keep = left <= right
        least, where, wide = np.where(keep, left, right), np.where(keep, where[:-by], where[by:]), wide + by
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    count = np.diff(np.append(first, n))
    p, inv = _powers(len(h) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[: len(h)])])
    content = _mix((total[first + count + window - 1] - total[first]) * inv[first] + count.astype(np.uint64))
    return first, count, least[first].view(np.int64), content.view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _sketch(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [segments(word_hashes(t)[0], window) for t in utf8(b.column(2))]
            size = np.array([len(x[0]) for x in out])
            parts = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(4)]
            ids = [b.column(i).take(pa.array(np.repeat(np.arange(len(out)), size))) for i in (0, 1)]
            kinds = (pa.int32(), pa.int16(), pa.int64(), pa.int64())
            yield pa.record_batch([*ids, *(pa.array(x.astype(k.to_pandas_dtype()), k) for x, k in zip(parts, kinds))], ["doc_id", "th", "at", "n", "mn", "sk"])

    return _keyed(docs).mapInArrow(run, "doc_id long, th long, at int, n short, mn long, sk long")


def _words_of(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Rows ``(mn, sk, n, many, hot, words)`` of the wanted segments, fetched from their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, want in zip(utf8(b.column(0)), b.column(1)):
                h = word_hashes(text)[0]
                for w in want.as_py():
                    rows.append((w["mn"], w["sk"], w["n"], w["many"], w["hot"], h[w["at"] : w["at"] + w["n"] + window - 1].tobytes()))
                if len(rows) > 20000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    kinds = (pa.int64(), pa.int64(), pa.int16(), pa.int64(), pa.bool_(), pa.binary())
    names = ["mn", "sk", "n", "many", "hot", "words"]
    lists = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("at", "n", "mn", "sk", "many", "hot")).alias("want"))
    texts = _keyed(docs).alias("d").join(lists.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.th") == F.col("w.th")))
    return texts.select("d.text", "w.want").mapInArrow(run, "mn long, sk long, n short, many long, hot boolean, words binary")


def shard_repeats(frame: pd.DataFrame, window: int) -> pd.DataFrame:
    """The repeated windows of one shard's segments: ``mask`` has bit i for the i-th window of a segment."""
    frame = frame.drop_duplicates(["mn", "sk", "n"])  # a repeated row fetched its segments twice
    kinds = len(frame)
    parts = [np.frombuffer(w, np.uint64) for w in frame["words"]]
    size = np.array([len(p) for p in parts])
    symbol = np.unique(np.concatenate(parts), return_inverse=True)[1] + 1
    # Sequences are set apart by a 0 on either side.
    start = np.cumsum(size + 1) - size
    text = np.zeros(int(size.sum()) + len(parts) + 1, np.int64)
    text[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = symbol
    n = frame["n"].to_numpy().astype(np.int64)
    weight = np.append(np.repeat(np.minimum(frame["many"].to_numpy(), 2), size + 1), 1)
    statistic = FMIndex(text, int(size.max()), weight).matching_statistics(text, start, start + size, least_hits=2)
    owner = np.repeat(np.arange(kinds), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    hit = statistic[start[owner] + nth] >= window
    mask = np.zeros(kinds, np.int64)
    np.bitwise_or.at(mask, owner[hit], np.int64(1) << nth[hit])
    got = np.flatnonzero(mask)
    return pd.DataFrame({"mn": frame["mn"].to_numpy()[got], "sk": frame["sk"].to_numpy()[got], "n": n[got].astype(np.int16), "mask": mask[got]})


def _hot_repeats(words: DataFrame, window: int) -> DataFrame:
    """As ``shard_repeats``, for segments of hot minimizers, by counting each window's own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _P[:window] if window <= len(_P) else _powers(window)[0][:window]
        for b in batches:
            mn, sk, n, many = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for i, w in enumerate(b.column(4)):
                h = np.lib.stride_tricks.sliding_window_view(np.frombuffer(w.as_py(), np.uint64), window)
                a, c = _mix((h * p).sum(axis=1)), _mix((_mix(h) * p[::-1]).sum(axis=1))
                k = len(a)
                yield pa.record_batch([pa.array(np.full(k, mn[i])), pa.array(np.full(k, sk[i])), pa.array(np.full(k, n[i], np.int16)), pa.array(np.full(k, many[i])), pa.array(np.arange(k, dtype=np.int16)), pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], ["mn", "sk", "n", "many", "i", "a", "c"])

    rows = words.dropDuplicates(["mn", "sk", "n"]).select("mn", "sk", "n", "many", "words").mapInArrow(run, "mn long, sk long, n short, many long, i short, a long, c long")
    times = F.sum(F.least("many", F.lit(2)))
    twice = rows.groupBy("a", "c").agg(times.alias("times")).where("times > 1").select("a", "c")
    return rows.join(twice, ["a", "c"]).groupBy("mn", "sk", "n").agg(F.expr("bit_or(shiftleft(1L, i))").alias("mask"))


def repeated_windows(docs: DataFrame, window: int, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """Rows ``(doc_id, th, at, mask)``: windows at + i, for the bits i of mask, occur twice or more; th is the text's hash."""
    found = staged(_sketch(docs, window), "segments")
    kinds = found.groupBy("mn", "sk", "n").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("doc_id", "th", "at")).alias("one"))
    per = kinds.groupBy("mn").agg(F.count(F.lit(1)).alias("distinct"), F.sum("many").alias("all")).where("all > 1")
    kinds = staged(kinds.join(per, "mn").select("mn", "sk", "n", "many", "distinct", "one"), "kinds")
    total = kinds.agg(F.coalesce(F.sum(F.col("n") + window), F.lit(0)).alias("w"), F.coalesce(F.max("distinct"), F.lit(0)).alias("m")).first()
    wanted = kinds.select("one.*", "n", "mn", "sk", "many", (F.col("distinct") > hot_segments).alias("hot"))
    words = staged(_words_of(docs, wanted, window), "segwords")
    shards = max(1, int(total.w) // SHARD_WORDS)
    shard = F.pmod(F.xxhash64("mn"), F.lit(shards))
    full = words.where("not hot").groupBy(shard.alias("shard")).applyInPandas(lambda f: shard_repeats(f, window), "mn long, sk long, n short, mask long")
    if total.m > hot_segments:
        full = full.union(_hot_repeats(words.where("hot"), window))
    verdict = staged(full, "verdict")
    return found.join(verdict, ["mn", "sk", "n"]).select("doc_id", "th", "at", "mask")


def cut_repeats(docs: DataFrame, window: int = 35, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    Every word that lies in a window of ``window`` words which also starts
    elsewhere, in this or another document, is removed; windows are judged on
    the input.  Null text counts as no words.  Rows that repeat are documents
    of their own, so each loses all windows.  Windows of fewer words do not
    exist: short texts stay whole unless they lie in a longer repeat.
    """
    if not GRAM <= window <= 60 + GRAM:
        raise ValueError(f"window must be {GRAM} to {60 + GRAM} words")
    marks = repeated_windows(docs, window, hot_segments)
    lists = marks.groupBy("doc_id", "th").agg(F.collect_set(F.struct("at", "mask")).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, kept = [], [], []
            for text, m in zip(utf8(b.column(1)), b.column(2)):
                words = text.split()
                n = len(words)
                if m.is_valid and len(m.values):
                    at = m.values.field("at").to_numpy(zero_copy_only=False).astype(np.int64)
                    mask = m.values.field("mask").to_numpy(zero_copy_only=False)
                    bits = np.unpackbits(mask.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    r, i = np.nonzero(bits)
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, at[r] + i, 1)
                    np.add.at(change, at[r] + i + window, -1)
                    gone = np.cumsum(change)[:n] > 0
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                total.append(n)
                removed.append(n - len(words))
                kept.append(b" ".join(words))
            yield pa.record_batch([b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    texts = _keyed(docs).alias("d").join(lists.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.th") == F.col("w.th")), "left")
    return texts.select("d.doc_id", "d.text", "w.marks").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
