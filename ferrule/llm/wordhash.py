"""64-bit hashes of many byte spans at once."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
#: Odd multipliers by place.
P = np.random.default_rng(5).integers(1, 1 << 63, 128, dtype=np.uint64) * _U(2) + _U(1)
#: Bytes of a span that the sum of products tells apart; longer spans are hashed one by one.
_LONG = 48


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ``data[start:end]`` (uint8) for each span; no span is empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    byte = data[np.repeat(start, size) + place].astype(np.uint64)
    h = mix(np.add.reduceat((byte + _U(1)) * P[np.minimum(place, 127)], first) + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), 1)
    return h
