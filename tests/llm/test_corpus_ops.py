"""Each operator against a brute-force version on small, awkward documents."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash

from ferrule.llm import embeddings, exact, fmindex, hilbert, html_crf, mixing, packing, pii, quality, simhash, substring

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_mixing_whole import plain_targets  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, h string"


def documents(spark, texts, ids=None, sources=None):
    """Rows with extra columns whose names clash with the operators' own."""
    rows = [(i if ids is None else ids[i], t, None if i % 7 == 3 else "en", f"s{i % 3}" if sources is None else sources[i], None, "k", i, "h") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(("Alpha", "beta", "GAMMA", "delta", "é", "x1", "ß", "the", "of", "of"))
    base = [" ".join(word() for _ in range(rng.randint(1, 90))) for _ in range(n)]
    base += base[:8] + [base[0].upper(), base[1].lower(), None, None, "", " \n\t", "one", "one two", "x" * 5000, "the " * 800]
    base += [" ".join(b.split()[:-1] + ["tail"]) for b in base[:6]]
    return base


def test_exact_dedup_matches_grouping(spark):
    texts = awkward()
    ids = [*range(len(texts) - 2), 3, None]  # a doc_id that repeats and a null one
    lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
    members = defaultdict(list)
    for i, t in zip(ids, texts):
        members[lower(t)].append(i)
    want = Counter()
    for i, t in zip(ids, texts):
        m = members[lower(t)]
        keep = max((x for x in m if x is not None), default=None)
        want[(i, i if len(m) == 1 else keep, len(m), len(m) == 1 or i == keep, hashlib.sha256(lower(t).encode()).hexdigest())] += 1
    for width in (64, 5):  # five bits collide all the time; bytes must still decide
        got = exact.exact_duplicates(documents(spark, texts, ids), width=width).collect()
        assert Counter(map(tuple, got)) == want


def test_quotient_filter_round_trip_and_merge():
    rng = np.random.default_rng(0)
    for bits, n in ((64, 1000), (20, 500), (6, 40), (9, 0), (12, 1)):
        parts = []
        for _ in range(3):
            v, c = np.unique(rng.integers(0, 2**63 if bits == 64 else 2**bits, n, dtype=np.uint64), return_counts=True)
            f = exact.CountingQuotientFilter.build(v, c, bits)
            back = exact.CountingQuotientFilter.unpack(bits, *f.pack())
            assert np.array_equal(back.items()[0], v) and np.array_equal(back.items()[1], c)
            parts.append((v, c, back))
        total = Counter()
        for v, c, _ in parts:
            total.update(dict(zip(v.tolist(), c.tolist())))
        v, c = exact.merge([p[2] for p in parts]).items()
        assert dict(zip(v.tolist(), c.tolist())) == total


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_matches_brute_force(spark):
    texts = awkward(2)
    fp = [plain_simhash(t) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(fp)), 2) if (fp[i] ^ fp[j]).bit_count() <= 3]
    want = {(i, f"{f:016x}", r) for (i, f), r in zip(enumerate(fp), components(len(fp), links))}
    assert set(map(tuple, simhash.near_duplicates(documents(spark, texts)).collect())) == want


def test_fingerprint_links_with_crowded_buckets(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(300)}
    fps = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    pairs = {(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    order = {f: i for i, f in enumerate(fps)}
    want = components(len(fps), [(order[a], order[b]) for a, b in pairs])
    for limit in (4096, 20):  # 20: the crowded way
        got = simhash.fingerprint_links(df, 3, bucket_limit=limit).collect()
        assert components(len(fps), [(order[r.a], order[r.b]) for r in got]) == want


def test_simhash_null_ids_and_empty_table(spark):
    df = documents(spark, ["a b c d", "a b c d", None], [None, 5, None])
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == Counter({(None, 5): 1, (5, 5): 1, (None, None): 1})
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert exact.exact_duplicates(df.limit(0)).count() == 0


def plain_repeats(texts, w):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(d[i : i + w]) for d in docs for i in range(len(d) - w + 1))
    out = []
    for d in docs:
        gone = set()
        for i in range(len(d) - w + 1):
            if count[tuple(d[i : i + w])] > 1:
                gone.update(range(i, i + w))
        out.append((len(d), len(gone), " ".join(x for i, x in enumerate(d) if i not in gone)))
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_substring_dedup_matches_window_counts(spark, hot):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    passage = [" ".join(rng.choices(vocab, k=k)) for k in (34, 35, 36, 60, 120)]
    texts = []
    for _ in range(60):
        parts = [" ".join(rng.choices(vocab, k=rng.randint(0, 50)))]
        if rng.random() < 0.6:
            parts += [rng.choice(passage), " ".join(rng.choices(vocab, k=rng.randint(0, 30)))]
        if rng.random() < 0.2:
            parts += [rng.choice(passage)] * 2
        texts.append("\n".join(parts))
    texts += texts[:3] + [None, "", "  ", "z " * 200, "p q " * 60, "y" * 3000, " ".join(vocab[:35]), " ".join(vocab[:36])]
    texts += [x + " " + passage[3] for x in ("é ß", "é ss")]
    want = [(i, *x) for i, x in enumerate(plain_repeats(texts, 35))]
    got = sorted(map(tuple, substring.cut_repeats(documents(spark, texts), 35, hot_segments=hot).collect()))
    assert got == want


def test_substring_dedup_of_repeated_rows_and_nulls(spark):
    text = " ".join(f"v{i}" for i in range(50))
    df = documents(spark, [text, text, None, "short"], [7, 7, None, None])
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring.cut_repeats(df).collect())
    assert got == Counter({(7, 50, 50): 2, (None, 0, 0): 1, (None, 1, 0): 1})
    assert substring.cut_repeats(df.limit(0)).count() == 0


def test_fm_index_counts_patterns():
    rng = np.random.default_rng(2)
    text = np.concatenate([[0], rng.integers(1, 5, 300), [0], rng.integers(1, 5, 200), [0]])
    index = fmindex.FMIndex(text)
    seq = "".join(map(str, text))
    for _ in range(200):
        k = int(rng.integers(1, 7))
        p = rng.integers(1, 5, k)
        n = sum(seq.startswith("".join(map(str, p)), i) for i in range(len(seq)))
        got = index.matching_lengths(p, np.array([k]), k, least_hits=max(1, n))[0]
        assert (got == k) == (n > 0)
        assert index.matching_lengths(p, np.array([k]), k, least_hits=n + 1)[0] < k


def test_packing_round_trip(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    texts = awkward(3) + ["<|endoftext|> and more", "word " * 9000, "é" * 700, " " * 3000]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    for ranks in (P.path("byte_bpe_50k.tiktoken"), None):
        rows = packing.pack(documents(spark, texts).coalesce(2), P.path("byte_bpe_50k.json"), ranks, P.PATTERN).collect()
        pieces, windows = defaultdict(list), defaultdict(list)
        for r in rows:
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert len(ids) == r.length > 0 and r.doc_tokens == len(want[r.doc_id])
            pieces[r.doc_id].append((r.start, ids))
            windows[r.sequence_id].append((r.offset, r.length))
        for d, ids in want.items():
            assert [x for _, p in sorted(pieces[d]) for x in p] == ids
        for w in windows.values():
            at = 0
            for offset, length in sorted(w):
                assert offset == at
                at += length
            assert at <= 2048 and at & (at - 1) == 0  # no window needs padding
    assert packing.pack(documents(spark, texts).limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_packing_fills_all_windows():
    p = packing.TierPacker()
    rng = random.Random(0)
    total = 0
    for d in range(500):
        n = rng.randint(1, 6000)
        total += n
        p.add(d, n)
        if d % 100 == 99:
            p.flush()
    p.close()
    done = p.take()
    assert sum(n for _, w in done for _, _, n in w) == total
    assert all(sum(n for _, _, n in w) == size for size, w in done)
    assert sum(size not in packing.TIERS for size, _ in done) <= 11


def test_hilbert_curve_is_one_path():
    for d, bits in ((2, 3), (3, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        index = hilbert.hilbert_index(cells, bits)
        assert sorted(index) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_hilbert_shards(spark):
    texts = awkward(5)
    sources = [None if i % 9 == 0 else f"s{i % 4}" for i in range(len(texts))]
    got = hilbert.hilbert_shards(documents(spark, texts, sources=sources).drop("size"), 16).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(16)]
    assert max(counts) - min(counts) <= 1
    # Curve order runs through the shards, and a text stays together but at cuts.
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.cell for r in order] == sorted(r.cell for r in order)
    runs = [k for k, _ in itertools.groupby(texts[r.doc_id] or "" for r in order)]
    assert len(runs) == len(set(runs))
    small = hilbert.hilbert_shards(documents(spark, ["a", None, "c"]).drop("size"), 16).collect()
    assert sorted((r.shard, r.slot) for r in small) == [(0, 0), (1, 0), (2, 0)]
    assert hilbert.hilbert_shards(documents(spark, ["a"]).drop("size").limit(0)).count() == 0


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(25, 16))
    v = [list(map(float, c + rng.normal(size=16) * s)) for c in centres for s in (0, 0.05, 0.1, 0.2, 0.3)]
    v += [v[0], v[0], [x * 2 for x in v[1]], None, [], [0.0] * 16, [float("nan")] * 16, [None] + v[3][1:], [float("inf")] * 16]
    rows = [(i, x, 1, "v") for i, x in enumerate(v)]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v string"), recall=0.999).collect()}
    ok = [i for i, x in enumerate(v) if x and None not in x and np.isfinite(x).all() and any(x)]
    u = {i: np.array(v[i], np.float32).astype(float) for i in ok}
    u = {i: a / np.linalg.norm(a) for i, a in u.items()}
    links = [(a, b) for a, b in itertools.combinations(ok, 2) if u[a] @ u[b] >= 0.95]
    degree = Counter(x for l in links for x in l)
    root = components(len(v), links)
    assert len(got) == len(v)
    for i in range(len(v)):
        assert got[i].n_links <= degree[i]
        assert got[i].kept == (got[i].component_id == i)
    found = sum(got[i].n_links for i in range(len(v)))
    assert found >= 0.97 * 2 * len(links)
    if found == 2 * len(links):
        assert [got[i].component_id for i in range(len(v))] == root
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_in_blocks(spark, monkeypatch):
    """A crowded bucket cut into blocks finds what one block finds."""
    rng = np.random.default_rng(9)
    c = rng.normal(size=8)
    rows = [(i, list(map(float, c + rng.normal(size=8) * 0.12))) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, embeddings.near_vectors(df).collect()))
    monkeypatch.setattr(embeddings, "BLOCK", 25)
    assert sorted(map(tuple, embeddings.near_vectors(df).collect())) == whole


BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_pii(text):
    out = []
    for k, rx in enumerate(BASE):
        for m in re.finditer(rx, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = True
            if k == 1:
                good = all(int(p) <= 255 for p in m[0].split("."))
            elif k == 2:
                t = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
                good = 16 <= len(digits) <= 19 and t % 10 == 0
            elif k == 3:
                good = 8 <= len(digits) <= 15
            if good:
                out.append((k, *m.span()))
    return out


def test_pii_base_matches_the_expressions(spark):
    rng = random.Random(12)
    bits = ["a@b.c", "x.y+z@mail-1.example.com.", "@@", "a@b@c.d", ".@a.b.", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.255", "4194092253540301", "4194 0922-5354 0301", "4194092253540302", "+1 (640) 555-0953", "+12", "+1 2.3.4.5.6.7.8.9", "++44 20 7946 0958", "é", "word", "-", ".", " ", "\n", "9" * 40, "12 34", "a@b", "%@x.y-z"]
    texts = ["".join(rng.choice(bits) + rng.choice((" ", "", ",", " ")) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [None, ""]
    for t in texts:
        assert pii.extract(t or "") == plain_pii(t), t
    got = {r.doc_id: r for r in pii.find_personal_data(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i].base] == plain_pii(t)
        assert set(map(tuple, got[i].base)) <= set(map(tuple, got[i].spans))
    assert pii.find_personal_data(documents(spark, texts).limit(0)).count() == 0


def test_pii_bootstraps_unseen_identifiers(spark):
    valid = [f"+1 (2{i:02d}) 555-{1000 + i}" for i in range(60)]
    texts = [f"please phone us on {p} before noon item {i}" for i, p in enumerate(valid)]
    hidden, other = "please phone us on 212-555-0147 before noon", "part number 313-555-0148 is sold out"
    got = {r.doc_id: r for r in pii.find_personal_data(documents(spark, [*texts, hidden, other])).collect()}
    assert [tuple(s) for s in got[60].spans] == [(3, 19, 31)] and not got[60].base
    assert not got[61].spans


def test_html_main_text(spark):
    page = "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=/>a</a></li><li><a href=/b>b</a></li></ul></nav><div class=ad>Buy now.</div><article><h1>Head &amp; line</h1><p><b>First  part<br>goes\non.<p>Second one, &eacute; &#65;.</p></article><div class='comments'><p>nice post</p></div><footer>&copy; me</footer>"
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<nav><a href=/>x</a></nav>", "x"), (4, "u", "<", "x"), (None, "u", "<article>" + "<p>Long words of prose go on here. </p>" * 3000 + "</article>", "x")]
    got = html_crf.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    by = {r.page_id: r for r in got}
    assert by[1].text == "Head & line\n\nFirst part goes on.\n\nSecond one, é A." and by[1].n_chars == len(by[1].text)
    assert by[2].text == by[3].text == "" and by[None].text.count("\n\n") == 2999
    assert len(got) == len(rows)


def test_html_viterbi_is_the_best_path():
    model = html_crf.default_model()
    blocks = html_crf.leaf_blocks(html_crf.labelled_pages(3, 77)[2])[:10]

    def score(y):
        own = sum(model.weights.get(f, 0.0) for b, k in zip(blocks, y) if k for f in b.features)
        return own + model.begin * y[0] + sum(model.ties[a.parent == b.parent][i][j] for a, b, i, j in zip(blocks, blocks[1:], y, y[1:]))

    best = max(itertools.product((0, 1), repeat=len(blocks)), key=score)
    assert model.decode(blocks) == [bool(k) for k in best]


def test_html_held_out_pages():
    model = html_crf.default_model()
    right = total = 0
    for p in html_crf.labelled_pages(80, 1234):
        blocks = html_crf.leaf_blocks(p)
        right += sum(y == b.main for b, y in zip(blocks, model.decode(blocks)))
        total += len(blocks)
    assert right >= 0.99 * total


def test_quality_learns_only_from_the_training_part(spark):
    rng = random.Random(3)
    texts, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [rng.choice(("la", "mento", "via", "sora", "tin", "quel")) + rng.choice(("", "s", "ra")) for _ in range(rng.randint(20, 80))]
        texts.append(" ".join(w.upper() + "!!" if bad else w for w in words))
        marks.append(0 if bad else 1)
    texts += [None, "", "x" * 100000]
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(len(texts))]
    labels = spark.createDataFrame([(i, m, 0) for i, m in enumerate(marks)] + [(None, 1, 0), (0, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(documents(spark, texts), labels).collect()}
    assert [got[i].held_out for i in range(len(texts))] == held
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    test = [i for i in range(400) if held[i]]
    assert sum(got[i].predicted == marks[i] for i in test) >= 0.97 * len(test)
    flipped = spark.createDataFrame([(i, 1 - m if held[i] else m, 0) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in quality.classify(documents(spark, texts), flipped).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in got)
    none = quality.classify(documents(spark, texts), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(documents(spark, texts).limit(0), labels).count() == 0


def test_pool_adjacent_is_monotone():
    y, w, at = np.array([0, 1, 0, 0.5, 1, 0.9]), np.ones(6), np.arange(6.0)
    x, v = quality.pool_adjacent(y, w, at)
    assert (np.diff(v) > 0).all() and (np.diff(x) > 0).all() and abs(v[0]) < 1e-12


def test_mixing_comes_near_targets(spark):
    rng = random.Random(5)
    texts = [" ".join("w" for _ in range(rng.choice((0, 1, 3, 10, 40, 400)))) for _ in range(600)] + [None, "", "a\x0bb c"]
    sources = [rng.choice((None, "a", "a", "a", "B", "é", "zero")) for _ in texts]
    texts = ["" if s == "zero" else t for s, t in zip(sources, texts)]
    rows = mixing.mix(documents(spark, texts, sources=sources)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    total = Counter()
    for s, n in zip(sources, size):
        total[s] += n
    order = ["B", "a", "zero", "é", None]
    goal = dict(zip(order, plain_targets([total[s] for s in order], [1, 2, 3, 1, 2])))
    taken = Counter()
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == total[r.source] and abs(r.target - goal[r.source]) < 1e-6
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for s in order:
        assert abs(goal[s] - taken[s]) <= 200  # half the longest document
    again = mixing.mix(documents(spark, texts, sources=sources).repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)
    out = mixing.mixed(documents(spark, texts, sources=sources))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    want = Counter({r.doc_id: r.copies for r in rows if r.copies and r.size})
    assert Counter(r.doc_id for r in out.where("length(trim(text)) > 0").collect()) == want
    assert mixing.mix(documents(spark, texts).limit(0)).count() == 0
