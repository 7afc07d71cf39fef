"""Matching statistics against plain search."""

import numpy as np
import pytest

from ferrule.llm import fmindex


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("symbols", [1, 2, 5, 40])
def test_against_plain_search(seed, symbols):
    rng = np.random.default_rng(seed)
    parts = [rng.integers(1, symbols + 1, rng.integers(1, 30)) for _ in range(8)]
    parts += [parts[0], np.concatenate([parts[1], parts[2]])[:30]]
    text, begin, end = [0], [], []
    for p in parts:
        begin.append(len(text))
        text += [*p, 0]
        end.append(len(text) - 1)
    text, begin, end = np.array(text), np.array(begin), np.array(end)
    for least in (1, 2, 3):
        got = fmindex.FMIndex(text, 30).matching_statistics(text, begin, end, least_hits=least)
        want = np.zeros(len(text), int)
        for a, b in zip(begin, end):
            for i in range(a, b):
                for j in range(i + 1, b + 1):
                    hits = sum(text[k : k + j - i].tolist() == text[i:j].tolist() for k in range(len(text) - (j - i) + 1))
                    if hits < least:
                        break
                    want[i] = j - i
        assert got.tolist() == want.tolist()


def test_weights_and_bounded_order():
    rng = np.random.default_rng(9)
    parts = [rng.integers(1, 4, 12) for _ in range(30)]
    many = rng.integers(1, 3, len(parts))
    def lay(parts):
        size = np.array([len(p) + 1 for p in parts])
        text = np.append(np.concatenate([np.append(p, 0) for p in parts]), 0)
        start = np.cumsum(size) - size
        return text, start, start + size - 1
    text, begin, end = lay(parts)
    got = fmindex.FMIndex(text, 12, np.append(np.repeat(many, 13), 1)).matching_statistics(text, begin, end, 2)
    # Weights count like copies, however those are laid out.
    wide, b2, e2 = lay([*parts, *(p for p, m in zip(parts, many) if m == 2)])
    want = fmindex.FMIndex(wide, 12).matching_statistics(wide, b2, e2, 2)
    assert got[: len(text) - 1].tolist() == want[: len(text) - 1].tolist()


def test_bit_vector_ranks():
    rng = np.random.default_rng(1)
    bits = (rng.random(200_000) < 0.3).astype(np.uint8)
    v = fmindex.BitVector(bits)
    at = rng.integers(0, len(bits) + 1, 500)
    assert v.rank1(at).tolist() == [int(bits[:i].sum()) for i in at]
