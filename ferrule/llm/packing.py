"""Hierarchical multi-length packing of tokenised documents.

Each partition packs its own documents in one pass, so nothing is shuffled.
A document longer than the longest context gives full windows; what remains of
it is routed to the shortest tier that holds it.  Tiers are packed from the
longest down: a piece opens a window of its tier, and the gap is filled from
shorter tiers, the largest piece that fits first, the last one cut.  Windows
of every tier are thus full, and the last, open window of a partition is cut
into windows of powers of two, so no padding is left.

Windows of one tier are dealt to step groups of equally many tokens.  The
windows of the last two groups of a partition are held back until its end and
dealt evenly, so no group is a small remainder: each has between 3/4 and 3/2
of the wanted tokens, unless a partition has less than that of a tier in all.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 1 << 17
#: Tokens held before a flush; bounds a task's memory but for one document.
HELD_TOKENS = 1 << 21
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str | None, pattern: str | None):
    """A function from text to uint32 ids, as ``tokenizers`` gives them for ``json_path``.

    ``ranks_path`` holds the same vocabulary for a faster encoder.  It is used
    where given; a text that it cannot take goes to ``tokenizers``.
    """
    import json

    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)

    def plain(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    if ranks_path is None:
        return plain
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(json_path, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    fast = tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def quick(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:
            if type(e).__name__ != "PanicException":  # the encoder's panics are no Exception and have no importable type
                raise
            return plain(text)

    return quick


class TierPacker:
    """Packs pieces ``(document, start, length)`` into windows of the tiers; ``take`` returns finished windows."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers))
        self.pools: list[list[tuple[int, int, int]]] = [[] for _ in self.tiers]  # (length, document, start), sorted
        self.done: list[tuple[int, list[tuple[int, int, int]]]] = []

    def route(self, doc: int, start: int, length: int) -> None:
        for k, most in enumerate(self.tiers):
            if length <= most:
                insort(self.pools[k], (length, doc, start))
                return
        raise ValueError("longer than the longest tier")

    def add(self, doc: int, tokens: int) -> None:
        longest, at = self.tiers[-1], 0
        while tokens - at >= longest:
            self.done.append((longest, [(doc, at, longest)]))
            at += longest
        if tokens > at:
            self.route(doc, at, tokens - at)

    def _fill(self, tier: int, gap: int) -> tuple[int, int, int] | None:
        """A piece of at most ``gap`` tokens, from the longest tier up to ``tier`` that has one that fits, else cut."""
        for k in range(tier, -1, -1):
            pool = self.pools[k]
            i = bisect_right(pool, (gap, float("inf"), 0))
            if i:
                length, doc, start = pool.pop(i - 1)
                return doc, start, length
        for k in range(tier + 1):
            if self.pools[k]:
                length, doc, start = self.pools[k].pop(0)
                self.route(doc, start + gap, length - gap)
                return doc, start, gap
        return None

    def flush(self) -> None:
        """Pack all pools; what does not fill a window is routed again."""
        for k in range(len(self.tiers) - 1, -1, -1):
            size, pool = self.tiers[k], self.pools[k]
            while pool:
                length, doc, start = pool.pop()
                window, gap = [(doc, start, length)], size - length
                while gap and (piece := self._fill(k, gap)):
                    window.append(piece)
                    gap -= piece[2]
                if gap:  # nothing is left in this tier or below
                    self.open = window
                    return self._reroute(window)
                self.done.append((size, window))

    def _reroute(self, window: list[tuple[int, int, int]]) -> None:
        for doc, start, length in window:
            self.route(doc, start, length)

    def close(self) -> None:
        """Cut what is left into windows of powers of two."""
        self.flush()
        rest = [(d, s, n) for pool in reversed(self.pools) for n, d, s in reversed(pool)]
        self.pools = [[] for _ in self.tiers]
        total = sum(n for _, _, n in rest)
        for bit in range(max(1, total).bit_length() - 1, -1, -1):
            size = 1 << bit
            if not total & size:
                continue
            window, gap = [], size
            while gap:
                d, s, n = rest.pop(0)
                use = min(n, gap)
                window.append((d, s, use))
                gap -= use
                if use < n:
                    rest.insert(0, (d, s + use, n - use))
            self.done.append((size, window))

    def take(self) -> list[tuple[int, list[tuple[int, int, int]]]]:
        out, self.done = self.done, []
        return out

    def waiting(self) -> set[int]:
        return {d for pool in self.pools for _, d, _ in pool}


class StepGroups:
    """Deals the windows of each tier to groups of ``step`` tokens; ``finish`` deals what is held back."""

    def __init__(self, step: int):
        self.step, self.held, self.tokens, self.count = step, {}, {}, {}

    def _next(self, tier: int) -> int:
        self.count[tier] = self.count.get(tier, -1) + 1
        return self.count[tier]

    def add(self, tier: int, tokens: int, window: list) -> Iterator[tuple[int, int, list]]:
        """Windows that are settled, as (tier, group, window)."""
        held = self.held.setdefault(tier, [])
        held.append((tokens, window))
        self.tokens[tier] = self.tokens.get(tier, 0) + tokens
        while self.tokens[tier] >= 2 * self.step:
            group, room, n = self._next(tier), self.step, 0
            while room > 0:
                room -= held[n][0]
                n += 1
            yield from ((tier, group, w) for _, w in held[:n])
            self.tokens[tier] -= self.step - room
            del held[:n]

    def finish(self) -> Iterator[tuple[int, int, list]]:
        for tier, held in self.held.items():
            if not held:
                continue
            groups = [[0, self._next(tier)] for _ in range(1 if self.tokens[tier] <= 1.5 * self.step else 2)]
            for tokens, window in sorted(held, key=lambda x: -x[0]):
                least = min(groups)
                least[0] += tokens
                yield tier, least[1], window


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset, tier, step_group.

    ``tier`` is the window's length, ``step_group`` unique over all tiers.
    Null text counts as empty and gives the one token ``end_id``.  Every row of
    ``docs`` is a document of its own, repeated rows and those without a
    doc_id too; other columns are not looked at.  An empty table gives no rows.
    """
    longest, order = max(tiers), sorted(tiers)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks, pattern)
        base = TaskContext.get().partitionId() << 40
        packer, groups, held = TierPacker(tiers), StepGroups(step_tokens), {}
        documents, sequences, tokens = 0, 0, 0
        end = np.array([end_id], np.uint32)

        def settled() -> Iterator[tuple[int, int, list]]:
            nonlocal sequences
            for size, window in packer.take():
                rows, at = [], 0
                for d, start, length in window:
                    doc_id, ids = held[d]
                    rows.append((doc_id, start, length, ids[start : start + length].tobytes(), len(ids), base + sequences, at, size))
                    at += length
                sequences += 1
                yield from groups.add(order.index(min((t for t in tiers if size <= t), default=longest)), size, rows)
            keep = packer.waiting()
            for d in [d for d in held if d not in keep]:
                del held[d]

        def batch(windows: Iterator[tuple[int, int, list]]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for tier, group, rows in windows:
                out += [(*r, base | (tier << 32) | group) for r in rows]
                if len(out) > 2000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                    out = []
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.concatenate([encode(text.as_py() or ""), end]).astype("<u4", copy=False)
                held[documents] = (doc_id, ids)
                packer.add(documents, len(ids))
                documents += 1
                tokens += len(ids)
                if tokens >= HELD_TOKENS:
                    packer.flush()
                    yield from batch(settled())
                    tokens = 0
        packer.close()
        yield from batch(settled())
        yield from batch(groups.finish())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
