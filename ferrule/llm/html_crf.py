"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks: runs of text between
block-level tags.  Each block has features of its ancestors (tags, class and
id words), of its own tag, of its text, and of the shape of the blocks beside
it; neighbours are tied by whether they share a parent.  A two-label chain is
trained by gradient ascent on the likelihood of labelled pages
(``page_corpus``), and Viterbi decoding keeps the main blocks.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .page_corpus import labelled_pages

#: Tags that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never shown as text of the page, or is part of a form.
HIDDEN = "script|style|template|iframe|svg|select|textarea|title"
#: An open element of these is closed by the start of any block, or of its like.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({HIDDEN})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[a-z/!?][^>]*>", re.S | re.I)
#: Comments of training pages that begin and end main text; they end a block as well.
MARKS = {"<!--main-->": True, "<!--/main-->": False}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_UNSEEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
#: A compound with one of these names what is absent, or what a layout has elsewhere.
_NEGATORS = frozenset("no not non without less free has have with hide hidden off disabled".split())
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    parent: int
    features: list[str] = field(default_factory=list)
    main: bool = False


def leaf_blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """The text blocks of a page in order.  ``known`` limits ancestor features to a model's own, so that work per block
    does not grow with the depth of the page."""
    out: list[Block] = []
    stack: list[tuple[str, int, list[str]]] = []  # tag, element, its features
    active: Counter[str] = Counter()
    text: list[str] = []
    linked, in_link, count, main = 0, 0, 0, False
    leaf, parent = "body", 0

    def close() -> None:
        nonlocal linked
        if text:
            words = entities.unescape("".join(text)).split()
            if words:
                line = " ".join(words)
                out.append(Block(line, parent, [*active, "leaf:" + leaf, *_text_features(line, words, linked)], main))
            text.clear()
        linked = 0

    def pop() -> None:
        nonlocal in_link
        tag, _, names = stack.pop()
        held[tag] -= 1
        for n in names:
            active[n] -= 1
            if not active[n]:
                del active[n]
        in_link -= tag == "a"

    # Open elements by name.
    held: Counter[str] = Counter()
    last = 0
    for m in _TOKEN.finditer(page):
        if m.start() > last:
            piece = page[last : m.start()]
            text.append(piece)
            if in_link:
                linked += len(piece)
        last = m.end()
        tag = m[3]
        if not tag:
            if m[0] in MARKS:
                close()
                main = MARKS[m[0]]
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
            continue
        block = tag not in INLINE
        if block:
            close()
        if m[2]:
            if held[tag]:
                while stack:
                    same = stack[-1][0] == tag
                    pop()
                    if same:
                        break
        else:
            if block and tag not in VOID:
                ends = CLOSES.get(tag, ())
                while stack and (stack[-1][0] in INLINE or stack[-1][0] == "p" or stack[-1][0] in ends):
                    pop()
            if tag not in VOID:
                count += 1
                names = [] if not block else ["in:" + tag]
                attrs = m[4]
                if block and attrs and tag not in ("html", "body"):
                    names += _attribute_features(attrs)
                if known is not None:
                    names = [n for n in names if n in known]
                stack.append((tag, count, names))
                held[tag] += 1
                active.update(names)
                in_link += tag == "a"
        if block:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in INLINE), None)
            leaf = stack[place][0] if place is not None else "body"
            parent = stack[place - 1][1] if place else 0
    text.append(page[last:])
    close()
    shapes = [b.features[-1] for b in out]
    for i, b in enumerate(out):
        b.features.append("before:" + (shapes[i - 1] if i else "none"))
        b.features.append("after:" + (shapes[i + 1] if i + 1 < len(out) else "none"))
    return out


def _attribute_features(attrs: str) -> list[str]:
    """Words of class, id and role.  A word that stands alone says more than a part of a compound; compounds that say
    what is absent say nothing."""
    out = []
    for n in _NAMES.finditer(attrs):
        for token in (n[1] or n[2] or n[3] or "").split():
            words = [w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", token))]
            if len(words) == 1:
                out.append("at:" + words[0])
            elif not _NEGATORS.intersection(words):
                out += ["part:" + w for w in words]
            if not _NEGATORS.intersection(words):
                out += ["stem:" + w[:4] for w in words if len(w) > 3]
    if _UNSEEN.search(attrs):
        out.append("unseen")
    return out


_STOP = frozenset(".!?…\"')»")
_NOTICE = re.compile(r"©|\bcopyright\b|\ball rights reserved\b|\bcookies?\b|\bprivacy\b|\bsubscribe\b|\bnewsletter\b|\bsign (?:in|up)\b|\blog ?in\b|\badvert|\bsponsored\b|\brelated\b|\bshare\b|\bcomments?\b|\breply\b|\bread more\b|\bterms\b", re.I)


_SENTENCE = re.compile(r"[.!?…][\"')»]?(?:\s|$)")


def _text_features(line: str, words: list[str], linked: int) -> list[str]:
    """Features of a block's own text; the last one is its shape, which its neighbours see too."""
    n = len(words)
    size = "1" if n == 1 else "4" if n <= 4 else "10" if n <= 10 else "25" if n <= 25 else "60" if n <= 60 else "many"
    out = ["words:" + size]
    share = linked / max(1, len(line))
    links = "none" if share <= 0 else "some" if share < 0.3 else "half" if share < 0.7 else "all"
    out.append("links:" + links)
    out.append("end:" + ("stop" if line[-1] in _STOP else "open"))
    if n <= 40 and _NOTICE.search(line):
        out.append("notice")
    if n > 25 and share < 0.3:
        out.append("prose")
    stops = sum(1 for _ in islice(_SENTENCE.finditer(line), 3))
    out.append(f"sentences:{stops}")
    out.append(f"shape:{size}/{links}/{min(stops, 1)}")
    return out


@dataclass
class ChainModel:
    """Log-linear scores: ``weights`` of label 1 over label 0 by feature, ``ties[same parent][previous][label]``."""

    weights: dict[str, float]
    ties: list[list[list[float]]]
    begin: float

    @property
    def known(self) -> frozenset[str]:
        return frozenset(self.weights)

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The likeliest labels, by Viterbi; on a tie label 0."""
        if not blocks:
            return []
        get, back = self.weights.get, []
        zero, one = 0.0, self.begin + sum(get(f, 0.0) for f in blocks[0].features)
        for prev, b in zip(blocks, blocks[1:]):
            t = self.ties[prev.parent == b.parent]
            own = sum(get(f, 0.0) for f in b.features)
            from0, from1 = one + t[1][0] > zero + t[0][0], one + t[1][1] > zero + t[0][1]
            zero, one = max(zero + t[0][0], one + t[1][0]), max(zero + t[0][1], one + t[1][1]) + own
            back.append((from0, from1))
        y = one > zero
        out = [y]
        for from0, from1 in reversed(back):
            y = from1 if y else from0
            out.append(y)
        return out[::-1]


def train(pages: list[str], rounds: int = 200, rate: float = 0.1, decay: float = 1e-3, least: int = 3) -> ChainModel:
    """Maximum likelihood with an L2 penalty, by Adam over forward-backward marginals of all pages at once.

    A page's main blocks are those between MARKS."""
    # Longest first, so that the pages with a block at a step are the first ones.
    seqs = sorted((s for s in (leaf_blocks(p) for p in pages) if s), key=len, reverse=True)
    names = [f for f, c in Counter(f for s in seqs for b in s for f in b.features).items() if c >= least]
    index = {f: i for i, f in enumerate(sorted(names))}
    n, steps, dim = len(seqs), max(map(len, seqs)), len(index)
    # Features of all blocks in one list, each with its block's place.
    rows = [(i * steps + t, index[f]) for i, s in enumerate(seqs) for t, b in enumerate(s) for f in b.features if f in index]
    place, feature = np.array(rows).T
    y = np.zeros((n, steps), int)
    same = np.zeros((n, steps), int)
    mask = np.zeros((n, steps), bool)
    for i, s in enumerate(seqs):
        for t, b in enumerate(s):
            y[i, t], mask[i, t], same[i, t] = b.main, True, t > 0 and b.parent == s[t - 1].parent
    alive, last = mask.sum(axis=0), mask.sum(axis=1) - 1
    theta = np.zeros(dim + 9)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    pair = np.zeros((2, 2, 2))
    for t in range(1, steps):
        ok = mask[:, t]
        np.add.at(pair, (same[ok, t], y[ok, t - 1], y[ok, t]), 1)
    held = lambda p: np.bincount(feature, p.ravel()[place], dim)
    seen = np.concatenate([held((y == 1) & mask), pair.ravel(), [y[:, 0].sum()]])
    for step in range(1, rounds + 1):
        w, tie, begin = theta[:dim], theta[dim : dim + 8].reshape(2, 2, 2), theta[-1]
        emit = np.zeros((n, steps, 2))
        emit[:, :, 1] = np.bincount(place, w[feature], n * steps).reshape(n, steps)
        emit[:, 0, 1] += begin
        alpha, beta = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
        alpha[:, 0] = emit[:, 0]
        for t in range(1, steps):
            k = alive[t]
            alpha[:k, t] = np.logaddexp.reduce(alpha[:k, t - 1, :, None] + tie[same[:k, t]], axis=1) + emit[:k, t]
        z = np.logaddexp.reduce(alpha[np.arange(n), last], axis=1)
        expected = np.zeros((2, 2, 2))
        for t in range(steps - 1, 0, -1):
            k = alive[t]
            joint = tie[same[:k, t]] + (emit[:k, t] + beta[:k, t])[:, None, :]
            p = np.exp(joint + alpha[:k, t - 1, :, None] - z[:k, None, None])
            for kin in (0, 1):
                expected[kin] += p[same[:k, t] == kin].sum(axis=0)
            beta[:k, t - 1] = np.logaddexp.reduce(joint, axis=2)
        p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * mask
        model = np.concatenate([held(p1), expected.ravel(), [p1[:, 0].sum()]])
        grad = (seen - model) / n - decay * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return ChainModel({f: float(theta[i]) for f, i in index.items()}, theta[dim : dim + 8].reshape(2, 2, 2).tolist(), float(theta[-1]))


@lru_cache(maxsize=2)
def default_model(pages: int = 800, seed: int = 3) -> ChainModel:
    return train(labelled_pages(pages, seed))


def main_text(page: str, model: ChainModel, known: frozenset[str] | None = None) -> str:
    blocks = leaf_blocks(page, known if known is not None else model.known)
    return "\n\n".join(b.text for b, y in zip(blocks, model.decode(blocks)) if y)


def extract_main_text(pages: DataFrame, model: ChainModel | None = None) -> DataFrame:
    """Per row of ``pages``: page_id, url, text (empty if none), n_chars (its code points).

    Null html counts as empty; every page is read whole, and rows stay in
    their partitions.  Repeated rows and rows without a page_id come back as
    often as they came; other columns are not looked at.  An empty table gives
    no rows.
    """
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.known
        for b in batches:
            text = [main_text(x.as_py() or "", model, known) for x in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    cols = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return cols.mapInArrow(run, "page_id long, url string, text string, n_chars long")
