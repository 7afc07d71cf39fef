"""Personal data by bootstrapped contextual extraction.

Strict expressions find seed entities of four kinds.  The words around them
are lexical patterns (``slots``), and patterns and instances (the words that
fill a pattern's slot, whatever they look like) form a bipartite graph of each
kind.  In every round

* patterns that enough different trusted instances induce are counted over all
  texts; one that trusted instances seldom fill goes;
* the others are looked up in all texts, and what fills them is a candidate;
* Spark scores the graph in steps until nothing changes: a pattern is as sure
  as the lower bound of the share of trusted instances among those that tell
  for or against it, and a candidate that a sure pattern reaches is trusted;
* the places of newly trusted instances induce the next round's patterns.

It ends when a round adds no instance.  A candidate tells against a pattern,
and is never trusted, if it is a seed of another kind, if it lacks what the
kind's seeds have in common (digits, letters, other signs), or if one of its
words is an ordinary one, met far oftener elsewhere.  Candidates about which
nothing is known do not tell against a pattern, so any share of a pattern's
instances may be unseen, up to ``share``.  Seeds always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ferrule.plans.bitmap import bitmap, held
from ferrule.plans.staging import drop_staged, staged

from .common import utf8
from .slots import WIDEST, Words, traits

KINDS = ("email", "ip", "card", "phone")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, @ and a dotted domain, in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def extract(text: str) -> list[Span]:
    """The strict matches ``(kind, start, end)`` of a text, in code points, sorted."""
    seeds: list[Span] = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        seeds += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _NO_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                seeds.append((2, m.start(), m.end()))
        if "+" in text:
            seeds += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return sorted(seeds)


_SPANS = "array<struct<kind:int,start:int,end:int>>"
_PLACES = "array<struct<kind:int,value:long,traits:int,patterns:array<long>>>"
#: Bytes of texts that are looked at together.
_BLOCK = 1 << 20


def _texts(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, th, text)``; doc_id and the text's hash find a row again."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _seed_places(text: str, seeds: list[Span]) -> list[dict]:
    """Of each seed the hash of the words it lies in, what they are made of, and their patterns.  A seed without a letter or
    digit (``_@-.-``) may lie in no word, and has no place then."""
    words = Words.of([text.encode("utf-8", "surrogatepass")])
    lengths = np.cumsum([0] + [len(c.encode("utf-8", "surrogatepass")) for c in text]) if not text.isascii() else np.arange(len(text) + 1)
    start, end = lengths[[s for _, s, _ in seeds]], lengths[[e for _, _, e in seeds]]
    first, last = np.searchsorted(words.end, start, "right"), np.searchsorted(words.start, end, "left") - 1
    some = np.flatnonzero(first <= last)
    seeds, first, last = [seeds[i] for i in some], first[some], last[some]
    run_first, run_last = words.runs()
    ruled = np.isin(first * (len(words.doc) + 1) + last, run_first * (len(words.doc) + 1) + run_last)
    value = words.values(first, last)
    found = [[] for _ in seeds]
    for pick, patterns in ((np.flatnonzero(ruled), words.rule_patterns), (np.flatnonzero(last - first < WIDEST), words.between_patterns)):
        for i, key in zip(*patterns(first[pick], last[pick])):
            found[pick[i]].append(int(key.view(np.int64)))
    cells = [words.data[words.start[i] : words.end[j]] for i, j in zip(first, last)]
    return [{"kind": k, "value": int(v.view(np.int64)), "traits": traits(c), "patterns": p} for (k, _, _), v, c, p in zip(seeds, value, cells, found)]


def _seeds(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, th, base (its strict matches) and seen (their places in the pattern graph)."""
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    place = pa.struct([("kind", pa.int32()), ("value", pa.int64()), ("traits", pa.int32()), ("patterns", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, seen = [], []
            for x in b.column(2):
                text = x.as_py()
                seeds = extract(text)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in seeds])
                seen.append(_seed_places(text, seeds) if seeds else [])
            yield pa.record_batch([b.column(0), b.column(1), pa.array(base, pa.list_(span)), pa.array(seen, pa.list_(place))], ["doc_id", "th", "base", "seen"])

    return _texts(docs).mapInArrow(run, f"doc_id long, th long, base {_SPANS}, seen {_PLACES}")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], Words]]:
    """Stretches of the batches with their texts and words; a long text is a stretch of its own."""
    for b in batches:
        size = pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False)
        group = (np.cumsum(size) - size) // _BLOCK
        for at, to in zip(*_stretches(group)):
            part = b.slice(at, to - at)
            texts = list(utf8(part.column(2)))
            yield part, texts, Words.of(texts)


def _stretches(group: np.ndarray) -> tuple[list[int], list[int]]:
    cut = np.flatnonzero(np.diff(group)) + 1
    return [0, *cut.tolist()] if len(group) else [], [*cut.tolist(), len(group)] if len(group) else []


def _count(docs: DataFrame, bits: np.ndarray, words: bool) -> DataFrame:
    """Rows ``(key, n)``: how often patterns (or ``words``) whose bits are set occur in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for _, _, w in _blocks(batches):
            found = [w.raw] if words else [k for *_, k in w.all_slots()]
            new, n = np.unique(np.concatenate([k[held(bits, k.view(np.int64))] for k in found]), return_counts=True)
            keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])

    return _texts(docs).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


_FOUND = "doc_id long, th long, start int, end int, value long, traits int, words array<long>, pattern long"


def _look_up(docs: DataFrame, bits: np.ndarray, by_value: bool) -> DataFrame:
    """Slots of all texts whose pattern (or, ``by_value``, whose value) has its bits set, with each of their patterns that
    counts.  Places are code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts, w in _blocks(batches):
            rows = []
            for first, last, slot, pattern in w.all_slots():
                if by_value:
                    hit = held(bits, w.values(first, last).view(np.int64))[slot]
                else:
                    hit = held(bits, pattern.view(np.int64))
                slot, pattern = slot[hit], pattern[hit]
                value = w.values(first[slot], last[slot])
                rows += [(int(first[s]), int(last[s]), int(v), int(p)) for s, v, p in zip(slot, value.view(np.int64), pattern.view(np.int64))]
            if not rows:
                continue
            begins = np.cumsum([0] + [len(t) + 1 for t in texts])
            points = lambda data: len(data.decode("utf-8", "replace"))
            out = []
            for i, j, value, pattern in rows:
                d = int(w.doc[i])
                start, end = (x - int(begins[d]) for x in w.span(i, j))
                lo = points(texts[d][:start])
                hi = lo + points(texts[d][start:end])
                cell = w.data[w.start[i] : w.end[j]]
                out.append((b.column(0)[d].as_py(), b.column(1)[d].as_py(), lo, hi, value, traits(cell), w.raw[i : j + 1].view(np.int64).tolist(), pattern))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in _FOUND.split(", ")])

    return _texts(docs).mapInArrow(run, _FOUND)


def lower_bound(hits: Column, n: Column, z: float) -> Column:
    """Wilson's lower bound of a share."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def score(edges: DataFrame, confident: float, z: float) -> DataFrame:
    """Rows ``(kind, value)``: the values that sure patterns reach, to a fixpoint.

    ``edges``: kind, pattern, value, trusted, against (booleans).  Trust only
    grows, so the steps end."""
    now = staged(edges, "graph")
    while True:
        tells = now.groupBy("kind", "pattern").agg(F.sum(F.col("trusted").cast("double")).alias("hits"), F.sum((F.col("trusted") | F.col("against")).cast("double")).alias("n"))
        sure = tells.where("hits > 0").where(lower_bound(F.col("hits"), F.col("n"), z) >= confident).select("kind", "pattern")
        more = staged(now.where("not trusted and not against").join(sure, ["kind", "pattern"], "left_semi").select("kind", "value").distinct(), "more")
        if more.isEmpty():
            break
        after = now.join(more.withColumn("new", F.lit(True)), ["kind", "value"], "left")
        after = staged(after.withColumn("trusted", F.col("trusted") | F.coalesce("new", F.lit(False))).drop("new"), "graph")
        drop_staged(now)
        now = after
    return now.join(sure, ["kind", "pattern"], "left_semi").where("trusted").select("kind", "pattern", "value").distinct()


def discover(docs: DataFrame, found: DataFrame, support: int, share: float, ordinary: float, confident: float, z: float) -> DataFrame | None:
    """Rows ``(doc_id, th, kind, start, end)``: places that the patterns discover beside the seeds; None if there are none.

    ``found`` are the rows of ``_seeds``."""
    seen = staged(found.select(F.explode("seen").alias("s")).select("s.*"), "seen")
    seeds = staged(seen.groupBy("kind", "value").agg(F.min("traits").alias("traits")), "seeds")
    # What nearly all seeds of a kind are made of.
    has = lambda bit: F.avg(F.col("traits").bitwiseAND(bit).cast("boolean").cast("double"))
    need = seeds.groupBy("kind").agg(sum((F.when(has(bit) >= 0.99, bit).otherwise(0) for bit in (1, 2, 4)), F.lit(0)).alias("need"))
    own = F.broadcast(need)  # four rows at most
    contexts = staged(seen.select("kind", "value", F.explode("patterns").alias("pattern")).groupBy("kind", "value", "pattern").agg(F.count(F.lit(1)).alias("n")), "contexts")
    trusted = seeds.select("kind", "value")
    places = None
    while True:
        induced = contexts.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("hits")).where(F.col("values") >= support)
        induced = staged(induced, "induced")
        if induced.isEmpty():
            return places
        totals = _count(docs, bitmap(induced.select("pattern").distinct(), "pattern", hashed=True), words=False)
        kept = staged(induced.join(totals.withColumnRenamed("key", "pattern"), "pattern").where(F.col("hits") >= share * F.col("n")).select("kind", "pattern"), "kept")
        if kept.isEmpty():
            return places
        hits = _look_up(docs, bitmap(kept.select("pattern").distinct(), "pattern", hashed=True), by_value=False)
        hits = staged(hits.join(kept, "pattern"), "hits")
        values = hits.groupBy("kind", "value").agg(F.min("traits").alias("traits"), F.first("words").alias("words"), F.countDistinct(F.struct("doc_id", "th", "start")).alias("inside"))
        values = values.join(trusted.withColumn("trusted", F.lit(True)), ["kind", "value"], "left")
        values = staged(values.join(seeds.select(F.col("kind").alias("other"), "value"), "value", "left"), "values")
        fresh = values.where("trusted is null")
        if fresh.isEmpty():
            return places
        word = fresh.select("kind", "value", "inside", F.explode(F.array_distinct("words")).alias("word"))
        counts = _count(docs, bitmap(word.select("word").distinct(), "word", hashed=True), words=True)
        rarest = word.join(counts.withColumnsRenamed({"key": "word", "n": "total"}), "word").groupBy("kind", "value").agg(F.min("total").alias("total"), F.max("inside").alias("inside"))
        common = rarest.where(F.col("total") > ordinary * F.col("inside")).select("kind", "value", F.lit(True).alias("common"))
        judged = values.join(common, ["kind", "value"], "left").join(own, "kind")
        lacks = F.col("traits").bitwiseAND(F.col("need")) != F.col("need")
        wrong = F.coalesce(F.col("other") != F.col("kind"), F.lit(False))
        good = F.coalesce("trusted", F.lit(False))
        against = ~good & (F.coalesce("common", F.lit(False)) | lacks | wrong)
        judged = judged.groupBy("kind", "value").agg(F.max(good).alias("trusted"), F.max(against).alias("against"))
        edges = hits.select("kind", "pattern", "value").distinct().join(judged, ["kind", "value"])
        reached = staged(score(edges, confident, z), "reached")
        new = staged(reached.select("kind", "value").distinct().join(trusted, ["kind", "value"], "left_anti"), "new")
        if new.isEmpty():
            return places
        # Newly trusted values are marked, and induce patterns, wherever they occur.
        every = _look_up(docs, bitmap(new.select("value").distinct(), "value", hashed=True), by_value=True).join(new, "value")
        every = staged(every.select("doc_id", "th", "kind", "start", "end", "value", "pattern").distinct(), "every")
        here = every.select("doc_id", "th", "kind", "start", "end").distinct()
        # A slot without any neighbour is met by no pattern, so none is lost here.
        places = staged(here if places is None else places.union(here).distinct(), "places")
        contexts = staged(contexts.union(every.groupBy("kind", "value", "pattern").agg(F.count(F.lit(1)).alias("n"))), "contexts")
        trusted = staged(trusted.union(new), "trusted")


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _apart(base: list, more: list) -> list[Span]:
    """The spans of ``base`` and those of ``more`` that touch none of them; of overlapping ones the first, then the longest."""
    out = [(s["kind"], s["start"], s["end"]) for s in base]
    taken: list[tuple[int, int]] = []  # disjoint and sorted
    for s, e in sorted((s, e) for _, s, e in out):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    for k, s, e in sorted(((s["kind"], s["start"], s["end"]) for s in more), key=lambda x: (x[1], -x[2], x[0])):
        at = bisect_left(taken, (s, s))
        if (not at or taken[at - 1][1] <= s) and (at == len(taken) or taken[at][0] >= e):
            out.append((k, s, e))
            insort(taken, (s, e))
    return sorted(out)


def find_personal_data(
    docs: DataFrame,
    support: int = 3,
    share: float = 0.2,
    ordinary: float = 5.0,
    confident: float = 0.8,
    z: float = 1.0,
) -> DataFrame:
    """Per row of ``docs``: doc_id, base and spans, arrays of (kind, start, end) in order of kind and start.

    ``kind`` counts through KINDS; places are code points, ends exclusive.
    ``base`` are the strict matches, ``spans`` those and what the patterns
    discovered.  A pattern needs ``support`` different trusted values that
    fill at least ``share`` of its slots; a word is ordinary if it occurs more
    than ``ordinary`` times as often as in the patterns' slots.  Null text
    counts as empty, repeated rows are found alike, a null doc_id is one like
    any other, and an empty table gives no rows.
    """
    found = staged(_seeds(docs), "entities")
    more = discover(docs, found, support, share, ordinary, confident, z)
    if more is None:
        return found.select("doc_id", "base", F.col("base").alias("spans"))
    lists = more.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    both = found.join(lists, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    @F.arrow_udf(_SPANS)
    def joined(base: pa.Array, extra: pa.Array) -> pa.Array:
        out = [_apart(b.as_py(), m.as_py() or []) for b, m in zip(base, extra)]
        return pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in out], pa.list_(span))

    return both.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(joined("base", "more")).alias("spans"))
