"""What the patterns discover: planted unseen forms, among decoys, and nothing without contexts."""

import random
from collections import Counter

import numpy as np
import pytest

from ferrule.llm import pii, slots

SCHEMA = "doc_id long, text string, base string, kind int, pattern string"


def _docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "b", 1, "p") for i, t in enumerate(texts)], SCHEMA)


def _spans(spark, texts, ids=None, **options):
    rows = pii.find_personal_data(_docs(spark, texts, ids), **options).collect()
    assert len(rows) == len(texts)
    return {r.doc_id: ([tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in rows}


def _filler(rng, n):
    return " ".join("".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(n))


def planted(seed, seen, unseen, contexts):
    """Documents with seeds and unseen forms in like contexts, ordinary numbers in others, and the places to find."""
    rng = random.Random(seed)
    forms = {
        "phone": (lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", lambda: f"{rng.randint(200, 999)} 555 {rng.randint(1000, 9999)}"),
        "ip": (lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), lambda: ":".join(f"{rng.randint(0, 65535):x}" for _ in range(4)).replace(":", "-") + f"-{rng.randint(10, 99)}"),
    }
    texts, want = [], {}
    for kind, (strict, loose) in forms.items():
        for n, form, is_new in ((seen, strict, False), (unseen, loose, True)):
            for _ in range(n):
                before, after = rng.choice(contexts[kind])
                head, value = _filler(rng, rng.randint(3, 12)) + " " + before + " ", form()
                if is_new:
                    want[len(texts)] = [(pii.KINDS.index(kind), len(head), len(head) + len(value))]
                texts.append(head + value + " " + after + " " + _filler(rng, rng.randint(3, 12)))
    for _ in range(seen):
        texts.append(f"{_filler(rng, 8)} chapter {rng.randint(1, 99)} {_filler(rng, 4)} weighs {rng.randint(100, 999)} 555 {rng.randint(1000, 9999)} grams {_filler(rng, 5)}")
    return texts, want


CONTEXTS = {"phone": [("call me on", "after lunch"), ("my number is", "thanks")], "ip": [("logged in from", "at night"), ("blocked the host", "for good")]}


@pytest.mark.parametrize("seen,unseen", [(60, 1), (60, 30), (30, 30), (10, 5)])
def test_unseen_forms_are_found(spark, seen, unseen):
    texts, want = planted(seen + unseen, seen, unseen, CONTEXTS)
    got = _spans(spark, texts)
    found = {i: [s for s in spans if s not in base] for i, (base, spans) in got.items()}
    right = sum(found[i] == w for i, w in want.items())
    wrong = sum(len(f) for i, f in found.items() if i not in want)
    assert all(set(base) <= set(spans) for base, spans in got.values())
    assert right == len(want) and wrong == 0


def test_values_found_in_one_context_open_the_next(spark):
    rng = random.Random(3)
    texts = [f"{_filler(rng, 5)} ring me on +1 (2{i:02d}) 555-{1000 + i} soon {_filler(rng, 5)}" for i in range(12)]
    local = [f"555 {2000 + i}" for i in range(24)]
    # The first twelve stand where seeds do, and again in a context without any; the others only there.
    texts += [f"{_filler(rng, 5)} ring me on {x} soon {_filler(rng, 5)}" for x in local[:12]]
    texts += [f"{_filler(rng, 5)} tel desk {x} only {_filler(rng, 5)}" for x in local]
    got = _spans(spark, texts)
    for i, x in enumerate([*local[:12], *local], 12):
        assert got[i][1] == [(3, texts[i].index(x), texts[i].index(x) + len(x))], texts[i]


def test_contexts_that_others_fill_discover_nothing(spark):
    rng = random.Random(5)
    # "of" stands before seeds, but mostly before words; "code" before seeds and as many ordinary words.
    texts = [f"{_filler(rng, 4)} of +1 (2{i:02d}) 555-{1000 + i} {_filler(rng, 6)} of {_filler(rng, 9)} of {_filler(rng, 3)} of {_filler(rng, 3)} of {_filler(rng, 3)} of {_filler(rng, 3)}" for i in range(40)]
    texts += [f"{_filler(rng, 3)} of 555 {1000 + i} {_filler(rng, 3)}" for i in range(20)]
    assert all(base == spans for base, spans in _spans(spark, texts).values())


def test_awkward_rows(spark):
    texts = [None, "", " ", "é " * 50, "+1 (200) 555-1000", "x" * 9000, "a@b.c", "a@b.c"]
    texts += [f"é ñ ring me on +1 (2{i:02d}) 555-{1000 + i} soon ü" for i in range(10)]
    texts += ["é ñ ring me on 555 77 soon ü", "é ñ ring me on 555 77 soon ü"]
    rows = pii.find_personal_data(_docs(spark, texts, [None, *range(1, len(texts) - 2), 90, 90])).collect()
    got = Counter((r.doc_id, tuple(map(tuple, r.spans))) for r in rows)
    assert len(rows) == len(texts)
    assert got[(90, ((3, 15, 21),))] == 2
    assert got[(None, ())] == 1 and got[(7, ((0, 0, 5),))] == 1
    assert pii.find_personal_data(_docs(spark, ["a"]).limit(0)).count() == 0


def test_slots_against_plain_words():
    rng = random.Random(7)
    word = lambda: rng.choice(["Tel", "on", "12", "3-4", "é9", "--", "a.b", "(x)", "+7", "is"])
    texts = [" ".join(word() for _ in range(rng.randint(0, 9))) for _ in range(40)]
    w = slots.Words.of([t.encode() for t in texts])
    plain = []
    for d, t in enumerate(texts):
        for x in t.split():
            core = x.strip(".-()")
            if core:
                plain.append((d, core))
    assert [(int(d), w.data[s:e].tobytes().decode()) for d, s, e in zip(w.doc, w.start, w.end)] == plain
    first, last = w.runs()
    assert np.array_equal(np.append(first[1:], len(plain)), last + 1)
    digits = [any(c.isdigit() for c in x) for _, x in plain]
    for i, j in zip(first, last):
        assert all(digits[i : j + 1]) or i == j
        assert i == 0 or plain[i - 1][0] != plain[i][0] or not (digits[i] and digits[i - 1])
    keys = {}
    for first, last, slot, pattern in w.all_slots():
        for s, k in zip(slot, pattern):
            i, j = int(first[s]), int(last[s])
            keys.setdefault(int(k), set()).add((i, j))
    left = {}
    for i, (d, _) in enumerate(plain):
        if i and plain[i - 1][0] == d:
            left.setdefault(slots._FOLD[np.frombuffer(plain[i - 1][1].encode(), np.uint8)].tobytes(), set()).add(i)
    assert len(keys) > len(left) > 3
