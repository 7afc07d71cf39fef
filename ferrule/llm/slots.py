"""Lexical patterns around slots of text, for a whole batch of documents at once.

A document is a sequence of words; a slot is a run of words that may be an
identifier, and the words beside it are its patterns:

* a slot by rule is a longest run of words with digits, or a single word
  without; its patterns are the one and the two words before it, and the one
  and the two words after it;
* any run of up to WIDEST words is a slot between the word before and the word
  after it, which are its one pattern.

Pattern words are folded: A-Z lower-cased, every digit a 0, punctuation at
their edges cut off.  Words of a slot keep their digits.  Patterns, words and
values (the words of a slot) are 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .wordhash import P, hash_spans, mix

WIDEST = 5

_U = np.uint64
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E), *b":=[]{}<>,;\"|"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
_CORE = _DIGIT | _LETTER
_CORE[ord("+")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_FOLD = np.where(_DIGIT, ord("0"), _LOWER).astype(np.uint8)
#: Pattern families: one word before, two before, one after, two after, one on either side.
_FAMILY = mix(np.arange(1, 6, dtype=np.uint64))


@dataclass
class Words:
    """The words of some texts: ``doc`` numbers the text, ``start`` and ``end`` are bytes of ``data``."""

    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    digit: np.ndarray
    context: np.ndarray
    raw: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        first = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1] if texts else np.zeros(0, np.int64)
        gap = np.concatenate([[True], _GAP[data], [True]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        core = np.flatnonzero(_CORE[data])
        lo, hi = np.searchsorted(core, edge[::2]), np.searchsorted(core, edge[1::2])
        some = hi > lo
        start, end = core[lo[some]], core[hi[some] - 1] + 1
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        doc = np.searchsorted(first, start, "right") - 1
        return cls(data, doc, start, end, digits[end] > digits[start], hash_spans(_FOLD[data], start, end), hash_spans(_LOWER[data], start, end))

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last word of each slot by rule."""
        n = len(self.doc)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = self.digit[1:] & self.digit[:-1] & (self.doc[1:] == self.doc[:-1])
        first = np.flatnonzero(np.concatenate([[True], ~joined]))
        return first, np.append(first[1:], n) - 1

    def _beside(self, at: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        """Context hashes of the words ``by`` places off, and whether they are of the same text."""
        to = at + by
        ok = (to >= 0) & (to < len(self.doc))
        to = np.where(ok, to, at)
        return self.context[to], ok & (self.doc[to] == self.doc[at])

    def rule_patterns(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, pattern) of slots by rule."""
        out = []
        for place, sign, one, two in ((first, -1, 0, 1), (last, 1, 2, 3)):
            near, ok = self._beside(place, sign)
            far, both = self._beside(place, 2 * sign)
            out.append((np.flatnonzero(ok), mix(near + _FAMILY[one])[ok]))
            out.append((np.flatnonzero(both), mix(mix(near + _FAMILY[two]) + far)[both]))
        return np.concatenate([s for s, _ in out]), np.concatenate([k for _, k in out])

    def between_patterns(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, pattern) of slots between two words."""
        left, a = self._beside(first, -1)
        right, b = self._beside(last, 1)
        ok = a & b & (self.doc[first] == self.doc[last])
        return np.flatnonzero(ok), mix(mix(left + _FAMILY[4]) + right)[ok]

    def values(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The hash of each slot's words in order."""
        if not len(first):
            return np.zeros(0, np.uint64)
        size = last - first + 1
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(begin, size)
        return mix(np.add.reduceat(self.raw[np.repeat(first, size) + place] * P[np.minimum(place, 127)], begin) + size.astype(np.uint64))

    def all_slots(self):
        """Every slot with its patterns, family by family: (first, last, slot, pattern)."""
        first, last = self.runs()
        yield first, last, *self.rule_patterns(first, last)
        n = len(self.doc)
        for width in range(1, WIDEST + 1):
            first = np.arange(max(0, n - width + 1))
            last = first + width - 1
            yield first, last, *self.between_patterns(first, last)

    def span(self, first: int, last: int) -> tuple[int, int]:
        """Bytes of a slot; a parenthesis that closes inside it opens it too."""
        start, end = int(self.start[first]), int(self.end[last])
        inside = self.data[start:end].tobytes()
        if start and inside.count(b")") > inside.count(b"(") and self.data[start - 1] == ord("("):
            start -= 1
        return start, end


def traits(data: np.ndarray) -> int:
    """Bits: 1 a digit, 2 a letter, 4 anything else inside."""
    digit, letter = _DIGIT[data], _LETTER[data]
    return int(digit.any()) | 2 * int(letter.any()) | 4 * int((~(digit | letter)).any())
