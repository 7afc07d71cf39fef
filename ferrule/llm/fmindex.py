"""A succinct FM-index over integer sequences, searched for many patterns at once.

The Burrows-Wheeler transform of a text is stored in a wavelet tree: one
bit vector per bit of the symbols, with rank counters of a quarter of its
size.  A backward search step narrows the suffix interval of every pattern in
one vectorised pass over the levels of the tree.  Matching statistics keep the
interval from one position to the next: where it cannot be extended to the
left, it widens to the enclosing interval of the suffix tree, which follows
from common prefix lengths.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of ``text`` in order, by prefix doubling; a shorter suffix comes before its extensions.

    ``longest``: only that many symbols have to be in order.  Patterns up to
    that length still have one interval each, and backward search finds it.
    Also the ranks by the first 1, 2, 4, ... symbols."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), []
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step, order, ranks = 1, np.argsort(rank, kind="stable"), [rank]
    while rank[order[-1]] < n - 1 and step < min(n, longest or n):
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        step *= 2
        ranks.append(rank)
    return order, ranks


class BitVector:
    """Bits packed in 64-bit words; a 32-bit counter to 512 words, and a 16-bit one from there to each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words)
        before = np.concatenate([[0], np.cumsum(ones[:-1], dtype=np.int64)])
        self.far = before[::512].astype(np.uint32)
        self.near = (before - np.repeat(before[::512], 512)[: len(before)]).astype(np.uint16)
        self.zeros = n - int(ones.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        low = self.words[w] & ((np.uint64(1) << r) - np.uint64(1))
        return self.far[w >> 9].astype(np.int64) + self.near[w] + np.bitwise_count(low)


class WaveletTree:
    """Rank of symbols below 2**levels, level by level with zeros moved ahead of ones."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.rows, s = [], symbols
        for level in range(self.levels - 1, -1, -1):
            bit = ((s >> level) & 1).astype(np.uint8)
            self.rows.append(BitVector(bit))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before ``lo`` and before ``hi``; both are offset by the same constant, so only
        differences to ``start`` count."""
        for level, row in zip(range(self.levels - 1, -1, -1), self.rows):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = row.rank1(lo), row.rank1(hi)
            lo, hi = np.where(one, row.zeros + a, lo - a), np.where(one, row.zeros + b, hi - b)
        return lo, hi


class FMIndex:
    """Search over ``text``: symbols from 1 up; 0 separates sequences and never matches."""

    def __init__(self, text: np.ndarray, longest: int = 0, weight: np.ndarray | None = None):
        """``longest``: matching statistics will not be asked for longer patterns.  ``weight``: how often the sequence
        of each place counts, once if not given."""
        self.size = len(text)
        sa, ranks = suffix_array(text, longest or None)
        if longest:
            self._nest(sa, ranks, longest)
            self.hits = np.concatenate([[0], np.cumsum(np.ones(len(sa), np.int64) if weight is None else weight[sa])])
        self.tree = WaveletTree(text[sa - 1])
        width = 1 << self.tree.levels
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=width))])
        # Where each symbol's run begins at the bottom of the tree.
        every = np.arange(width)
        self.base = self.tree.rank(every, np.zeros(width, np.int64), np.zeros(width, np.int64))[0]

    def _nest(self, sa: np.ndarray, ranks: list[np.ndarray], longest: int) -> None:
        """Common prefix lengths of neighbouring suffixes, up to ``longest``, and where shorter ones lie on either side."""
        n = len(sa)
        lcp = np.zeros(n + 1, np.int64)
        one, two = sa[:-1].copy(), sa[1:].copy()
        for level in range(len(ranks) - 1, -1, -1):
            inside = np.flatnonzero(np.maximum(one, two) < n)
            same = inside[ranks[level][one[inside]] == ranks[level][two[inside]]]
            one[same] += 1 << level
            two[same] += 1 << level
            lcp[same + 1] += 1 << level
        lcp = np.minimum(lcp, longest).astype(np.int16)
        lcp[0] = lcp[n] = -1
        index = np.arange(n + 1)
        self.lcp, self.left, self.right = lcp, np.zeros(n + 1, np.int32), np.full(n + 1, n, np.int32)
        for v in np.unique(lcp[1:n]):
            mine, less = lcp == v, lcp < v
            self.left[mine] = np.maximum.accumulate(np.where(less, index, 0))[mine]
            self.right[mine] = np.minimum.accumulate(np.where(less, index, n)[::-1])[::-1][mine]

    def matching_statistics(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray, least_hits: int = 1) -> np.ndarray:
        """For each place of ``text`` inside the stretches begin to end: the length of the longest run of symbols that
        starts there, stays in its stretch and occurs ``least_hits`` times or more, by weight; 0 elsewhere."""
        out = np.zeros(len(text), np.int64)
        lane = np.flatnonzero(end > begin)
        begin, at = begin[lane], end[lane] - 1
        lo, hi, length = np.zeros(len(lane), np.int64), np.full(len(lane), self.size, np.int64), np.zeros(len(lane), np.int64)
        while len(at):
            a, b = self.step(text[at], lo, hi)
            grown = self.hits[b] - self.hits[a] >= least_hits
            lo, hi, length = np.where(grown, a, lo), np.where(grown, b, hi), length + grown
            out[at[grown]] = length[grown]
            # What cannot grow gives up its last symbols, or moves on if it has none.
            stuck = np.flatnonzero(~grown & (length > 0))
            l, h = lo[stuck], hi[stuck]
            x, y = self.lcp[l], self.lcp[h]
            depth = np.maximum(x, y)
            lo[stuck], hi[stuck] = np.where(x == depth, self.left[l], l), np.where(y == depth, self.right[h], h)
            length[stuck] = np.maximum(depth, 0)
            whole = stuck[depth <= 0]
            lo[whole], hi[whole] = 0, self.size
            moved = np.ones(len(at), bool)
            moved[stuck] = False
            at = at - moved
            keep = at >= begin
            begin, at, lo, hi, length = begin[keep], at[keep], lo[keep], hi[keep], length[keep]
        return out

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.tree.rank(symbol, lo, hi)
        shift = self.first[symbol] - self.base[symbol]
        return a + shift, b + shift

    def matching_lengths(self, text: np.ndarray, ends: np.ndarray, most: int, least_hits: int = 1) -> np.ndarray:
        """For each position after a pattern's last symbol in ``text``: the longest run of symbols ending there, up to
        ``most``, that occurs ``least_hits`` times or more in the index; a symbol 0 ends a run."""
        length = np.zeros(len(ends), np.int64)
        alive = np.arange(len(ends))
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        for k in range(most):
            at = ends[alive] - 1 - k
            ok = at >= 0
            alive, lo, hi, at = alive[ok], lo[ok], hi[ok], at[ok]
            symbol = text[at]
            lo, hi = self.step(symbol, lo, hi)
            ok = (hi - lo >= least_hits) & (symbol > 0)
            alive, lo, hi = alive[ok], lo[ok], hi[ok]
            if not len(alive):
                break
            length[alive] += 1
        return length
