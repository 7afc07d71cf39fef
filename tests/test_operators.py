"""Operators without SQL, and rules at their edges, against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.functions import metrics
from ferrule.functions.expressions import ExpressionError, combine, compile_filter
from ferrule.operators import aggregate, cluster, distinct, filters, joins, models, sample, scale, similarity, windows
from ferrule.plans.bitmap import only_keys, without_keys
from ferrule.plans.components import connected_components
from ferrule.sources import fingerprint_text, records
from ferrule.streaming import filter_mode


def graph(n, p, seed):
    rng = random.Random(seed)
    return [(a, b, round(rng.random() * 0.3, 6)) for a, b in itertools.combinations(range(n), 2) if rng.random() < p]


def near(n, edges):
    out = {i: {} for i in range(n)}
    for a, b, d in edges:
        out[a][b] = out[b][a] = d
    return out


@pytest.mark.parametrize("p", [0.0, 0.02, 0.15])
def test_leader_is_the_sequential_one(spark, p):
    n = 80
    edges, order = graph(n, p, 1), random.Random(2).sample(range(n), n)
    g, want, left = near(n, edges), {}, list(sorted(range(n), key=order.__getitem__))
    while left:
        c = left.pop(0)
        want[c] = (c, 0.0)
        for m in [m for m in left if m in g[c]]:
            want[m] = (c, g[c][m])
            left.remove(m)
    items = spark.createDataFrame([(i, order[i]) for i in range(n)], "id long, ord long")
    e = spark.createDataFrame(edges, "a long, b long, d double")
    got = {r.id: (r.leader, r.d) for r in cluster.leader(items, e).collect()}
    assert got == want
    assert cluster.limit_clusters(cluster.leader(items, e), 2).groupBy("leader").count().where("count > 2").count() == 0


@pytest.mark.parametrize("p", [0.0, 0.03, 0.2])
def test_taylor_butina_is_the_sequential_one(spark, p):
    n = 60
    edges = graph(n, p, 3)
    g, left, want = near(n, edges), set(range(n)), {}
    while left:
        c = min(left, key=lambda x: (-sum(m in left for m in g[x]), x))
        for m in [c, *[m for m in g[c] if m in left]]:
            want[m] = c
            left.discard(m)
    items = spark.createDataFrame([(i, i) for i in range(n)], "id long, ord long")
    got = {r.id: r.leader for r in cluster.taylor_butina(items, spark.createDataFrame(edges, "a long, b long, d double")).collect()}
    assert got == want


def test_components_of_chains_hubs_and_repeats(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1000 + i) for i in range(1, 200)]
    odd = [(5000, 5000), (7, 3), (3, 7), (9000, None)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain + hub + odd, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(200)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spread_takes_the_furthest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 2))
    want, d = [0], np.linalg.norm(x - x[0], axis=1)
    for _ in range(9):
        d[want] = -1
        want.append(int(d.argmax()))
        d = np.minimum(d, np.linalg.norm(x - x[want[-1]], axis=1))
    items = spark.createDataFrame([(i, i, [float(v) for v in x[i]]) for i in range(40)], "id long, ord long, p array<double>")
    apart = lambda p: F.sqrt(F.aggregate(F.zip_with(F.col("p"), p, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    got = cluster.spread(items, apart, "p", 10).orderBy("pick").collect()
    assert [r.id for r in got] == want
    ds = [r.d for r in got[1:]]
    assert ds == sorted(ds, reverse=True)
    assert cluster.spread(items, apart, "p", 40, stop_below=ds[4]).count() == 6


def test_spread_over_buckets(spark):
    rows = [(0, 0, [0.0], "a"), (1, 1, [10.0], "a"), (2, 2, [9.0], "b"), (3, 3, [5.0], "b")]
    items = spark.createDataFrame(rows, "id long, ord long, p array<double>, k string")
    apart = lambda p: F.abs(F.element_at(F.col("p"), 1) - F.element_at(p, 1))
    got = cluster.spread_buckets(items, apart, "p", "k", 2, least=0.5).collect()
    assert [r.id for r in got] == [0, 2]  # 10 x 0.75 is less than 9
    assert [r.id for r in cluster.spread(items, apart, "p", 2).orderBy("pick").collect()] == [0, 1]


def test_saved_ranges(spark, tmp_path):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    r = scale.column_ranges(df, ["a", "b"])
    scale.save_ranges(r, spark, str(tmp_path / "r"))
    assert scale.load_ranges(spark, str(tmp_path / "r")) == r
    assert [x.a for x in scale.normalise(df, r).collect()] == [0.0, 1.0]


def test_prefix_join_finds_every_pair(spark):
    rng = random.Random(5)
    fps = {i: {rng.randrange(30): rng.randint(1, 3) for _ in range(rng.randint(1, 12))} for i in range(60)}
    fps |= {i + 60: {**fps[i], 99: 1} for i in range(20)}
    df = spark.createDataFrame([(i, b, c) for i, f in fps.items() for b, c in f.items()], "id long, bit long, cnt int")

    def dist(a, b):
        c = sum(min(n, b.get(k, 0)) for k, n in a.items())
        return 1 - c / (sum(a.values()) + sum(b.values()) - c)

    for t in (0.0, 0.25, 0.6):
        want = {(i, j): dist(fps[i], fps[j]) for i, j in itertools.combinations(fps, 2) if dist(fps[i], fps[j]) <= t}
        got = {(r.a, r.b): r.d for r in similarity.within(df, t).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_metric_rules_for_empty_fingerprints(spark):
    df = spark.sql("SELECT map(1L, 2) AS a, CAST(map() AS map<bigint,int>) AS b")
    a, b = F.col("a"), F.col("b")
    for name, f in metrics.SPARSE.items():
        r = df.select(f(b, b).alias("bb"), f(a, b).alias("ab"), f(a, a).alias("aa")).first()
        if name in ("tanimoto", "binary", "dice", "ctan", "soergel", "soergel_mean"):
            assert (r.bb, r.ab, r.aa) == (1.0, 0.0, 1.0), name
        elif name == "cosine":
            assert (r.bb, r.ab, r.aa) == (0.0, 0.0, 1.0)
    assert df.select(metrics.vector_difference(a, b).alias("v")).first().v == {1: 2}


def test_filter_expressions(spark):
    df = spark.createDataFrame([("1", "x1"), (".", "y"), (None, ""), ("5", "x9")], "a string, b string")
    keep = lambda e, **o: [r.a for r in df.where(compile_filter(e, df.columns, **o)).collect()]
    assert keep("a<3") == ["1"] and keep("a<3", missing_passes=True) == ["1", ".", None]
    assert keep("a.gt.0&&b=~^x||a==1") == ["1", "5"] and keep("a!=1") == ["5"]
    assert keep("zz<3", absent="fail") == []
    for bad in ("zz<3", "a<", "a<x", "&&", "a"):
        with pytest.raises(ExpressionError):
            compile_filter(bad, df.columns)
    with pytest.raises(Exception):
        df.where(compile_filter("b<3", df.columns)).collect()


def test_logical_expressions(spark):
    one = spark.range(1)
    value = lambda bits, ops, neg=None: one.select(combine([F.lit(b) for b in bits], ops, neg).alias("v")).first().v
    t, f = True, False
    assert value([t, t, f], "|&") is True and value([f, t, f], "|&") is False and value([t, f, t], "|;") is True and value([t, t, f], "|;") is False
    assert value([t, t], "^") is False and value([t, f], "^") is True and value([t, t, f], "^^") is True
    assert value([t, f], "&", [False, True]) is True
    with pytest.raises(ExpressionError):
        combine([F.lit(True)], "&")


def test_concat_files_rules(spark):
    a = spark.createDataFrame([(0, "A1", 1.5), (1, "a2", 2.0), (2, "A1", 9.0)], "ord long, id string, x double")
    b = spark.createDataFrame([(0, "a1", "p"), (1, "A1", "q"), (2, "003", "r")], "ord long, id string, y string")
    got = lambda **o: sorted(map(tuple, joins.concat_files([a, b], "id", "ord", **o).collect()))
    assert got() == [("A1", "1.5", "q"), ("A1", "9.0", "q"), ("a2", "2.0", ".")]
    assert got(ignore_case=True, distinct_first=True) == [("A1", "1.5", "p"), ("a2", "2.0", ".")]
    assert got(how="full", strip_zeros=True)[0] == ("003", ".", "r")
    with pytest.raises(joins.DuplicateIdentifiers):
        joins.concat_files([a, a.drop("x")], "id", "ord", duplicates="error")


def test_unique_rows_rules(spark):
    df = spark.createDataFrame([(0, "007", "a_1"), (1, "7", "A_2"), (2, "", ""), (3, None, ""), (4, "7", "b")], "ord long, k string, v string")
    s = distinct.unique_rows(df, ["k"], "ord", strip_zeros=True)
    assert [r.ord for r in s.passed.collect()] == [0] and sorted(r.ord for r in s.rejected.collect()) == [1, 4]
    s = distinct.unique_rows(df, ["v"], "ord", ignore_case=True, truncate_at="_", seen=spark.createDataFrame([("b",)], "v string"))
    assert [r.ord for r in s.passed.collect()] == [0] and sorted(r.ord for r in s.rejected.collect()) == [1, 4]
    assert distinct.keep_some_duplicates(df, ["k"], "ord", 1.0, strip_zeros=True).count() == 3


def test_row_filters_by_keys(spark):
    rows = spark.createDataFrame([(i, "t") for i in [*range(2000), 5, 5, None]], "id long, t string")
    drop = spark.createDataFrame([(i,) for i in range(0, 2000, 3)], "id long")
    once = spark.createDataFrame([(5,)], "id long")
    got = sorted((r.id is None, r.id or 0) for r in without_keys(rows, "id", drop, once).collect())
    assert got == sorted((i is None, i or 0) for i in [*(i for i in range(2000) if i % 3), None])
    assert only_keys(rows, drop, "id").count() == 667
    assert without_keys(rows, "id", drop.limit(0)).count() == 2003


def test_percentile_index_rule(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 1, 4, 2, 3, 3, None] if v is not None], "x double")
    values = sorted([5, 1, 4, 2, 3, 3])
    for p in (0, 10, 50, 99, 100):
        want = values[min(int(p * 6 / 100 + 0.4999), 5)]
        assert aggregate.percentiles(df, "x", [p]).first().value == want


def test_correlate_keeps_the_columns():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    y = scale.correlate(x, np.array([[1, 0.8], [0.8, 1]]), tolerance=0.02)
    assert abs(np.corrcoef(y.T)[0, 1] - 0.8) < 0.03
    assert np.allclose(np.sort(x, axis=0), np.sort(y, axis=0))


def test_cross_validation_scores_each_record_once(spark):
    rng = random.Random(7)
    fp = spark.createDataFrame([(i, b + 10 * (i % 2), 1) for i in range(60) for b in rng.sample(range(10), 4)], "id long, bit long, cnt int")
    y = spark.createDataFrame([(i, i % 2) for i in range(60)], "id long, c int")
    got = models.cross_validate(fp, y, "id", "c", 4).collect()
    assert sorted(r.id for r in got) == list(range(60)) and all(r.label == r.id % 2 for r in got)


def test_sampling_is_repeatable(spark):
    df = spark.range(500)
    a = {r.id for r in sample.random_records(df, 50, "id", 1).collect()}
    assert len(a) == 50 and a == {r.id for r in sample.random_records(df.repartition(7), 50, "id", 1).collect()} != {r.id for r in sample.random_records(df, 50, "id", 2).collect()}
    assert 20 < sample.bernoulli(df, 0.1, "id").count() < 90
    assert filters.first_rows(windows.islands(df.withColumn("g", F.lit(1)), ["g"], ["g"], ["id"]), ["g"], "id", 1).first().island == 1


def test_tagged_records(spark, tmp_path):
    p = tmp_path / "x.gfp"
    p.write_text("$SMI<CC>\nPCN<a 3>\nFP<1>\nFP<2>\n|\n$SMI<C>\nPCN<b 12>\n|\n")
    df = records.read_items(spark, str(p))
    rows = df.select(records.item("PCN").alias("n"), records.item("FP", 1).alias("f"), records.items_text().alias("t")).collect()
    assert [(r.n, r.f) for r in rows] == [("a 3", "2"), ("b 12", None)] and rows[1].t == "$SMI<C>\nPCN<b 12>\n|"
    assert df.where(records.item_filter("PCN", ">", 5, column=2)).count() == 1
    assert [r.n for r in records.sort_items(df, "PCN", column=2, reverse=True).select(records.item("PCN").alias("n")).collect()] == ["b 12", "a 3"]
    records.write_items(df.withColumn("items", records.add_item("NEW", F.lit(7))), str(tmp_path / "out"))
    assert records.read_items(spark, str(tmp_path / "out")).where(records.item_filter("NEW", "=", 7)).count() == 2


def test_descriptor_smiles_sdf_and_svm_files(spark, tmp_path):
    (tmp_path / "d.txt").write_text("Name a b\nx 1.5 .\ny . 2\n")
    assert [tuple(r) for r in records.read_descriptors(spark, str(tmp_path / "d.txt")).collect()] == [("x", 1.5, None), ("y", None, 2.0)]
    (tmp_path / "m.smi").write_text("CC id1 extra\n\nC id2\n")
    assert [(r.smiles, r.id, r.name_tokens) for r in records.read_smiles(spark, str(tmp_path / "m.smi")).collect()] == [("CC", "id1", ["id1", "extra"]), ("C", "id2", ["id2"])]
    (tmp_path / "m.sdf").write_text("mol1\n\n\n  0  0\nM  END\n>  <ID>\n7\n\n>  <X>\na\nb\n\n$$$$\nmol2\n\n\nM  END\n$$$$\n")
    got = records.read_sdf(spark, str(tmp_path / "m.sdf")).collect()
    assert [r.id for r in got] == ["mol1", "mol2"] and got[0].tags["ID"] == "7" and got[1].tags == {}
    (tmp_path / "s.svm").write_text("1 3:0.5 9:2 # c\n-1 1:1\n")
    assert [(r.label, r.features) for r in records.read_svm_lite(spark, str(tmp_path / "s.svm")).collect()] == [("1", {3: 0.5, 9: 2.0}), ("-1", {1: 1.0})]
    assert records.count_matching(spark, str(tmp_path / "m.smi"), "id") == 2
    rows = records.text_records(spark, str(tmp_path / "d.txt"))
    assert records.skip_records(rows, 1).count() == 2 and records.skip_records(rows, past="^x").count() == 1


def test_framed_records_and_stores(spark, tmp_path):
    data = [b"", b"abc", bytes(range(256))]
    (tmp_path / "r.tfdata").write_bytes(b"".join(map(records.frame, data)))
    assert [bytes(r.record) for r in records.read_framed(spark, str(tmp_path / "r.tfdata")).orderBy("n").collect()] == data
    with pytest.raises(ValueError):
        list(records.unframe(records.frame(b"abc")[:-1] + b"x"))
    df = spark.createDataFrame([("CC", "a"), ("CC", "b"), ("C", "c")], "key string, ids string")
    records.build_store(df, "key", "ids", str(tmp_path / "store"))
    found, absent = records.look_up(spark.createDataFrame([("CC",), ("N",)], "key string"), spark.read.parquet(str(tmp_path / "store")), "key")
    assert [tuple(r) for r in found.collect()] == [("CC", "a:b")] and [r.key for r in absent.collect()] == ["N"]


def test_fingerprint_text_forms():
    rng = random.Random(1)
    for n in (8, 16, 24, 2048):
        bits = sorted(rng.sample(range(n), n // 3))
        assert fingerprint_text.dense_from_ascii(fingerprint_text.dense_to_ascii(bits, n)) == bits
    counts = {rng.getrandbits(32): rng.randint(1, 255) for _ in range(9)}
    assert fingerprint_text.counted_from_ascii(fingerprint_text.counted_to_ascii(counts)) == counts
    assert fingerprint_text.counted_from_ascii("") == {} and fingerprint_text.dense_from_01("0101") == [1, 3]
    assert fingerprint_text.dense_from_hex("a0") == [0, 2] and fingerprint_text.dense_from_list("1,3-5;8") == [1, 3, 4, 5]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    df = spark.sql("SELECT id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, id % 3 AS k, cast(id AS double) AS v FROM range(200)")
    df.write.parquet(str(src))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(src))
    q = filter_mode.run_to_table(filter_mode.filter_stream(stream(), "v<20||k==0"), str(tmp_path / "f"), str(tmp_path / "fc"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "f")).count() == df.where("v < 20 or k = 0").count()
    q = filter_mode.run_to_table(filter_mode.distinct_stream(stream(), ["k"], "ts", "1 day"), str(tmp_path / "d"), str(tmp_path / "dc"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "d")).count() == 3

    def assign(batch, centres):
        new = batch.groupBy("k").agg(F.min("id").alias("id"))
        return new if centres is None else new.join(centres, "k", "left_anti")

    for _ in range(2):  # the second run finds nothing new
        filter_mode.leader_stream(stream(), spark, str(tmp_path / "c"), str(tmp_path / "cc"), assign).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "c")).collect()) == [0, 1, 2]
