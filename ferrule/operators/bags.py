"""All near pairs of one table of bags: rows (id, bits, cnts), a record's counted bits as two arrays.

A record's bits stay in its row, so that neither bits nor records are shuffled.

* Records of equal bags are one class; one of each class, its representative,
  is compared, and the pairs found are expanded to the members at the end.
* The k-th copy of a bit is a code of its own.  Codes go by rarity: those of
  one representative only, then rare ones by their hash, then the most frequent
  ones (``TOP`` at most) by how many representatives have them.
* Of two records within the threshold the smaller shares one of its first
  n - ceil(2t/(1+t) n) + 1 codes, the larger one of its first n - ceil(t n) + 1,
  with t = 1 - threshold.  Only these prefixes are shuffled, by code.
* The pairs of a code are made in the task that holds it, in blocks, and only
  those leave it whose sizes, whose places of the code and whose sketches leave
  room for the overlap.  A sketch is the parity of a record's codes in each of
  some hash buckets; two differ in no more buckets than the records in codes.
* What is left is measured in full.  Pairs whose lesser record has the same
  least neighbour are measured together, so that the records of a group of
  many near copies travel a few times and not once a pair.

None of these bounds depends on chance: the result is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ferrule.plans.bitmap import bitmap, held, may_hold
from ferrule.plans.staging import drop_staged, staged

#: Codes whose order by frequency every task holds.
TOP = 1 << 18
#: 64-bit words of all sketches together, which every task holds; beyond it sketches are halved, and let more pairs through.
SKETCHES = 3 << 22
#: Pairs that are looked at together, rows of codes, and words of sketches.
PAIRS, ROWS, WORDS = 1 << 18, 1 << 17, 1 << 18
LONG = 512
#: Records that are looked at together.
BLOCK = 512
#: Pairs that are measured together, whose records a task holds at once.
MEASURED = 1 << 14

_U = np.uint64
_WORD = re.compile(rb"[a-z]+")
_BAG = "bits array<long>, cnts array<int>"
_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())


def token_bags(df: DataFrame, id_column: str, text: Column) -> DataFrame:
    """Staged bags of the words [a-z]+ of lower-cased texts, made in the rows of the scan; bits as ``token_bit`` makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in _blocks(batches):
            bits, cnts = [], []
            for x in b.column(1).cast(pa.large_binary()):
                words = Counter(_WORD.findall(x.as_py() or b""))
                if len(known) > 1 << 17:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = int.from_bytes(hashlib.md5(w).digest()[:4], "big")
                bit, place = np.unique(np.fromiter((known[w] for w in words), np.int64, len(words)), return_inverse=True)
                bits.append(bit)
                cnts.append(np.bincount(place, np.fromiter(words.values(), np.int64, len(words)), len(bit)).astype(np.int32))
            yield pa.record_batch([b.column(0), _lists(bits, np.int64, _LONGS), _lists(cnts, np.int32, _INTS)], ["id", "bits", "cnts"])

    rows = df.select(F.col(id_column).alias("id"), F.lower(text).alias("text"))
    bags = staged(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {_BAG}").where(F.size("bits") > 0), "bags")
    # An id of several rows has one bag.
    several = bags.groupBy("id").count().where("count > 1").select("id")
    if several.isEmpty():
        return bags
    long = bags.join(several, "id", "left_semi").select("id", F.explode(F.arrays_zip("bits", "cnts")).alias("x"))
    merged = bags_of(long.select("id", F.col("x.bits").alias("bit"), F.col("x.cnts").alias("cnt")))
    return staged(bags.join(several, "id", "left_anti").unionByName(merged), "bags")


def bags_of(fp: DataFrame) -> DataFrame:
    """Bags of a long fingerprint table (id, bit, cnt)."""
    one = fp.where("cnt > 0").groupBy("id", F.col("bit").cast("long").alias("bit")).agg(F.sum("cnt").cast("int").alias("cnt"))
    rows = one.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("bit", "cnt"))).alias("x"))
    return rows.select("id", F.col("x.bit").alias("bits"), F.col("x.cnt").alias("cnts"))


def _lists(parts: list[np.ndarray], kind: type, arrow: pa.DataType) -> pa.Array:
    ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, kind))).cast(arrow)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            yield b.slice(at, BLOCK)


def _bags(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bits and counts of each row of (id, bits, cnts)."""
    ends = b.column(1).offsets.to_numpy()
    ends = ends - ends[0]
    bits, cnts = b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
    for i in range(b.num_rows):
        yield bits[ends[i] : ends[i + 1]], cnts[ends[i] : ends[i + 1]]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _codes(bits: np.ndarray, cnts: np.ndarray) -> np.ndarray:
    """Hashes of a bag's codes; the last two bits are clear.  Codes that collide are one code that may repeat."""
    copy = np.arange(int(cnts.sum())) - np.repeat(np.cumsum(cnts) - cnts, cnts)
    h = _mix(np.repeat(_mix(bits.view(_U) + _U(0x9E3779B97F4A7C15)), cnts) + copy.astype(_U) * _U(0xD6E8FEB86659FD93))
    return h & ~_U(3)


def _sketch(codes: np.ndarray, halved: int) -> bytes:
    """Parities of at least as many buckets as codes, or twice as many of records so long that chance pairs share most
    codes; a power of two, so that the two halves of a sketch make the next smaller one."""
    m = 64 << max(0, ((len(codes) - 1) // 64).bit_length() + (len(codes) > LONG) - halved)
    odd = np.bincount((codes >> _U(32)).astype(np.int64) & (m - 1), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class _Known:
    """The representatives, in order of id: their sizes and sketches."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("id")
        self.ids, self.n = rows["id"].to_numpy(), rows["n"].to_numpy().astype(np.int64)
        parts = rows["sketch"].to_pylist()
        self.words = np.frombuffer(b"".join(parts), _U)
        size = np.array([len(x) // 8 for x in parts], np.int64)
        self.start, self.level = np.cumsum(size) - size, np.log2(np.maximum(size, 1)).astype(np.int64)

    def _folded(self, at: np.ndarray, level: int) -> np.ndarray:
        """Sketches of 2^level words of records whose sketches are no smaller."""
        out = np.empty((len(at), 1 << level), _U)
        for k in np.unique(self.level[at]):
            of = np.flatnonzero(self.level[at] == k)
            whole = self.words[self.start[at[of]][:, None] + np.arange(1 << k)]
            out[of] = np.bitwise_xor.reduce(whole.reshape(len(of), -1, 1 << level), axis=1)
        return out

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Buckets in which the sketches of pairs differ."""
        out = np.zeros(len(a), np.int64)
        level = np.minimum(self.level[a], self.level[b])
        for k in np.unique(level):
            every = np.flatnonzero(level == k)
            step = max(1, WORDS >> int(k))
            for i in range(0, len(every), step):
                of = every[i : i + step]
                out[of] = np.bitwise_count(self._folded(a[of], int(k)) ^ self._folded(b[of], int(k))).sum(axis=1)
        return out


def _place(ids: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Places of ids among sorted ones, -1 if absent."""
    if not len(ids):
        return np.full(len(some), -1)
    at = np.minimum(np.searchsorted(ids, some), len(ids) - 1)
    return np.where(ids[at] == some, at, -1)


def _pairs_of_codes(code: np.ndarray, idx: np.ndarray, pos: np.ndarray, known: _Known, t: float) -> Iterator[np.ndarray]:
    """Pairs (smaller place << 32 | larger place) that may be within the threshold, of whole groups of rows by code."""
    n = known.n[idx]
    order = np.lexsort((n, code))
    code, idx, pos, n = code[order], idx[order], pos[order], n[order]
    group = np.concatenate([[0], np.cumsum(code[1:] != code[:-1])]) if len(code) else code
    size = (group << 32) + n
    # Partners are no smaller, and few enough codes larger.
    last = np.searchsorted(size, (group << 32) + np.floor(n / t + 1e-9).astype(np.int64), "right")
    need = 2 * t / (1 + t)
    first = np.arange(len(n))
    ok = (pos <= n - np.ceil(need * n - 1e-9)) & (last > first + 1)
    first, many = first[ok], (last - first - 1)[ok]
    ends = np.cumsum(many)
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, PAIRS):
        pick = np.arange(at, min(total, at + PAIRS))
        of = np.searchsorted(ends, pick, "right")
        a = first[of]
        b = a + 1 + pick - (ends[of] - many[of])
        both = n[a] + n[b]
        least = need / 2 * both - 1e-9
        room = np.minimum(n[a] - pos[a], n[b] - pos[b]) >= least
        a, b, apart = idx[a[room]], idx[b[room]], (both - 2 * least)[room]
        near = known.differ(a, b) <= apart
        a, b = a[near], b[near]
        yield np.unique(np.minimum(a, b) << 32 | np.maximum(a, b))


def pairs_within(bags: DataFrame, threshold: float) -> DataFrame:
    """Rows ``(a, b, d)`` with a < b and d <= threshold < 1, exact; ``bags`` are staged, and their ids unique."""
    t = 1.0 - threshold
    kind = bags.schema["id"].dataType.simpleString()
    bags = bags.where("id is not null")
    codes = bags.agg(F.sum(F.aggregate("cnts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")).first().n or 0
    halved = max(0, int(codes * 2.25 / 64) // SKETCHES).bit_length()

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            n, digest, sketch = [], [], []
            for bits, cnts in _bags(b):
                n.append(int(cnts.sum()))
                digest.append(hashlib.blake2b(bits.tobytes() + cnts.tobytes(), digest_size=16).digest())
                sketch.append(_sketch(_codes(bits, cnts), halved))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())], ["id", "n", "digest", "sketch"])

    head = staged(bags.mapInArrow(heads, f"id {kind}, n long, digest binary, sketch binary"), "heads")
    reps = head.groupBy("digest").agg(F.min(F.struct("id", "n", "sketch")).alias("r")).select("digest", "r.*")
    reps = staged(reps, "classes")
    known = _Known(reps.select("id", "n", "sketch").toArrow())
    # Functions that need no sketches are sent without them.
    ids, sizes = known.ids, known.n

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of representatives, their places in front."""
        for b in _blocks(batches):
            at = _place(ids, b.column(0).to_numpy(zero_copy_only=False))
            b = b.filter(pa.array(at >= 0))
            if b.num_rows:
                yield pa.record_batch([pa.array(at[at >= 0]), b.column(1), b.column(2)], ["at", "bits", "cnts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, new, size = np.zeros(0, _U), np.zeros(0, np.int64), [], 0

        def summed():
            k, n = np.unique(np.concatenate([*new, np.zeros(0, _U)]), return_counts=True)
            every, place = np.unique(np.concatenate([keys, k]), return_inverse=True)
            return every, np.bincount(place, np.concatenate([counts, n]), len(every)).astype(np.int64)

        for b in own(batches):
            for bag in _bags(b):
                new.append(_codes(*bag))
                size += len(new[-1])
                if size > max(1 << 20, len(keys)):
                    keys, counts = summed()
                    new, size = [], 0
        keys, counts = summed()
        for at in range(0, len(keys), 1 << 16):
            yield pa.record_batch([pa.array(keys[at : at + (1 << 16)].view(np.int64)), pa.array(counts[at : at + (1 << 16)])], ["code", "n"])

    counts = bags.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = staged(counts.where("n > 1"), "codes")  # a code of one representative meets none
    live = bitmap(counts.select("code"), "code", hashed=True)
    cut, left = 0, TOP
    # The most frequent codes, as far as they all fit.
    for r in counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().orderBy(F.desc("n")).collect():
        if r["count"] > left:
            cut = r.n
            break
        left -= r["count"]
    top = counts.where((F.least("n", F.lit(1 << 16)) > cut)).toArrow()
    drop_staged(counts)
    top_code, top_n = top["code"].to_numpy().view(_U), top["n"].to_numpy()
    rank = np.empty(len(top_n), np.int64)
    rank[np.lexsort((top_code, top_n))] = np.arange(len(top_n))
    by_code = np.argsort(top_code)
    top_code, rank = top_code[by_code], rank[by_code]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in own(batches):
            codes, at = [_codes(*bag) for bag in _bags(b)], b.column(0).to_numpy()
            every = np.concatenate(codes)
            value = (every >> _U(2)) | (held(live, every.view(np.int64)).astype(_U) << _U(62))
            place = _place(top_code, every)
            value[place >= 0] = rank[place[place >= 0]].astype(_U) | _U(1 << 63)
            out, begin = [], 0
            for i, c in zip(at, codes):
                n = len(c)
                v = np.sort(value[begin : begin + n])[: n - int(np.ceil(t * n - 1e-9)) + 1]
                begin += n
                pos = np.flatnonzero(v >= _U(1 << 62))
                out.append((v[pos].view(np.int64), int(i) << 32 | pos))
            yield pa.record_batch([pa.array(np.concatenate([x for x, _ in out])), pa.array(np.concatenate([x for _, x in out]))], ["code", "entry"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(code: np.ndarray, entry: np.ndarray) -> Iterator[pa.RecordBatch]:
            for p in _pairs_of_codes(code, entry >> 32, entry & 0xFFFFFFFF, known, t):
                yield pa.record_batch([pa.array(p)], ["pair"])

        codes, entries, size = [], [], 0
        for b in batches:
            codes.append(b.column(0).to_numpy())
            entries.append(b.column(1).to_numpy())
            size += b.num_rows
            if size >= ROWS and codes[-1][-1] != codes[0][0]:
                code, entry = np.concatenate(codes), np.concatenate(entries)
                whole = int(np.flatnonzero(code != code[-1])[-1]) + 1
                yield from made(code[:whole], entry[:whole])
                codes, entries, size = [code[whole:]], [entry[whole:]], len(code) - whole
        if size:
            yield from made(np.concatenate(codes), np.concatenate(entries))

    rows = bags.mapInArrow(prefixes, "code long, entry long").repartition("code").sortWithinPartitions("code")
    pairs = staged(rows.mapInArrow(met, "pair long").distinct(), "candidates")
    cand = pairs.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"))
    ends = cand.select("a", F.col("b").alias("o")).union(cand.select("b", "a"))
    least = staged(ends.groupBy("a").agg(F.least("a", F.min("o")).alias("group")), "least")
    many = cand.join(least, "a").groupBy("group").agg(F.ceil(F.count(F.lit(1)) / MEASURED).alias("parts"))
    task = staged(cand.join(least.join(many, "group"), "a").select("group", F.pmod(F.hash("a", "b"), F.col("parts").cast("int")).alias("part"), "a", "b"), "pairs")
    where = task.select("group", "part", F.explode(F.array("a", "b")).alias("at")).distinct()
    wanted = bitmap(least.select("a"), "a")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by group and part, records before pairs."""
        here: tuple | None = None
        records: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            a, z, common = [], [], []
            groups, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first, other = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            rows = _bags(pa.record_batch([batch.column(2), batch.column(4), batch.column(5)], ["a", "bits", "cnts"]))
            for g, p, x, y, bag in zip(groups, parts, first, other, rows):
                if (g, p) != here:
                    here, records = (g, p), {}
                if y < 0:
                    records[x] = (bag[0].copy(), bag[1].copy())  # else the whole batch stays
                    continue
                (bx, cx), (by, cy) = records[x], records[y]
                at = _place(by, bx)
                a.append(x)
                z.append(y)
                common.append(int(np.minimum(cx[at >= 0], cy[at[at >= 0]]).sum()))
            a, z, common = np.array(a, np.int64), np.array(z, np.int64), np.array(common, np.int64)
            d = 1 - common / (sizes[a] + sizes[z] - common)
            ok = d <= threshold + 1e-12
            yield pa.record_batch([pa.array(ids[a[ok]]), pa.array(ids[z[ok]]), pa.array(d[ok])], ["a", "b", "d"])

    full = bags.mapInArrow(own, f"at long, {_BAG}").where(may_hold(wanted, "at"))
    records = where.join(full, "at").select("group", "part", "at", F.lit(-1).cast("long").alias("other"), "bits", "cnts")
    none = [F.array().cast(k).alias(c) for c, k in (("bits", "array<long>"), ("cnts", "array<int>"))]
    rows = records.union(task.select("group", "part", "a", "b", *none)).repartition("group", "part").sortWithinPartitions("group", "part", "other")
    near = rows.mapInArrow(measured, f"a {kind}, b {kind}, d double")
    # Every member of a class is as far from others as its representative.
    member = head.join(reps.select("digest", F.col("id").alias("rep")), "digest").select("rep", "id")
    member = staged(member, "members")
    out = near.join(member.toDF("a", "x"), "a").join(member.toDF("b", "y"), "b").select("x", "y", "d")
    copies = member.toDF("rep", "x").join(member.toDF("rep", "y"), "rep").where("x < y").select("x", "y", F.lit(0.0).alias("d"))
    return out.union(copies).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "d")
