"""Strict matches of odd rows against the plain expressions, through the registered query."""

import hashlib
import random
import re

import pytest

from ferrule.llm import pii
from ferrule.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _plain(text):
    digits = lambda m: [int(c) for c in re.findall("[0-9]", m[0])]
    checked = lambda d: sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and checked(digits(m))]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return out


@pytest.mark.parametrize("text", ["_@-.-", "hello _@-.-", "__@--.--.- 7 é", "%%@-.- a@b.c", "é _@-.-\n_@-.-"])
def test_emails_without_letter_or_digit(text):
    seeds = pii.extract(text)
    assert seeds == sorted(_plain(text))
    places = pii._seed_places(text, seeds)
    # Such an email lies in no word, so it has no place and no neighbour's value.
    assert len(places) == sum(any(c.isalnum() for c in text[s:e]) for _, s, e in seeds)


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(7)
    parts = ["a", "Z", "@", ".", "-", "_", "%", "+", "0", "1", "25", "4444", " ", "  ", "\n", "(", ")", "é", "😀", "٣", "\x00", "@b.c", "1.2.3.4", "+1 ", "=", "|", "_@-.-", "4111 1111 1111 1111", "me at "]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(1500)]
    rows = [(i, t) for i, t in enumerate([None, "", "_@-.-", "hello _@-.-", *texts])]
    # Repeated rows and rows without a number are found alike.
    rows += [(None, "x a@b.c"), (None, None), (5, "_@-.-"), (5, "_@-.-")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    names = pii.KINDS
    want = []
    for i, t in rows:
        base = _plain(t or "")
        said = ",".join(f"{names[k]}:{s}:{e}" for k, s, e in base)
        want.append((i, *[sum(k == n for k, *_ in base) for n in range(4)], hashlib.sha256(said.encode()).hexdigest()))
    got = [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in QUERIES["op9_pii"](spark, str(tmp_path)).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
