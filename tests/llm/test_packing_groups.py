"""Step groups hold like numbers of tokens; rows that repeat or lack an id are documents of their own."""

import random
from collections import Counter, defaultdict

import pytest

from ferrule.llm import packing, queries

SF = "/root/testdata/sf0.001"


def _path():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


@pytest.mark.parametrize("step", [4096, 16384, 1 << 20])
def test_step_groups_are_balanced(spark, step):
    rng = random.Random(0)
    texts = [" ".join(rng.choice(("alpha", "beta", "of", "the", "gamma")) for _ in range(int(rng.paretovariate(0.7) * 20) % 6000)) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(3)
    rows = packing.pack(docs, *_path(), step_tokens=step).collect()
    tokens, tiers, per = Counter(), defaultdict(set), defaultdict(Counter)
    for r in rows:
        tier = min(t for t in packing.TIERS if r.tier <= t)
        part = r.sequence_id >> 40
        tokens[r.step_group] += r.length
        tiers[r.step_group].add(tier)
        per[part, tier][r.step_group] += r.length
    assert all(len(t) == 1 for t in tiers.values())
    assert sum(tokens.values()) == sum(r.length for r in rows) and len(per) > 3
    many = 0
    for groups in per.values():
        if sum(groups.values()) >= step:
            many += len(groups) > 1
            assert all(0.75 * step - 2048 <= n <= 1.5 * step + 2048 for n in groups.values())
        else:
            assert len(groups) == 1
    assert many or step > 16384
    # A window lies in one group.
    assert len({r.sequence_id for r in rows}) == len({(r.sequence_id, r.step_group) for r in rows})


def test_rows_without_id_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None), (5, "x y z"), (5, "x y z"), (5, "other")], "doc_id long, text string").selectExpr("*", "1 as start", "'t' as tier", "0L as sequence_id")
    rows = packing.pack(docs.coalesce(1), *_path()).collect()
    first = [r for r in rows if r.start == 0]
    assert sorted(str(r.doc_id) for r in first) == ["5", "5", "5", "None", "None"]
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in first)
    assert max(Counter((r.doc_id, r.doc_tokens) for r in first).values()) == 2


def test_query_holds_every_token_once(spark):

    import numpy as np
    from tokenizers import Tokenizer
    import zlib

    tok = Tokenizer.from_file(_path()[0])
    want = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 1] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op1_packing"](spark, SF).collect()
    at = Counter()
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(want[r.doc_id])
        ids = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(ids) == r.ids_crc32
        at[r.doc_id] += r.length
    assert at == {d: len(x) for d, x in want.items()}
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for w in windows.values():
        w.sort()
        assert w[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(w, w[1:]))
        total = sum(n for _, n in w)
        assert total <= 2048 and (total == 2048 or total & (total - 1) == 0)
