"""Registered queries: every operator applied to the driver's tables, with the SQL that says what it computes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ferrule.chem import enumeration, frames
from ferrule.functions import metrics, strings
from ferrule.functions.expressions import combine
from ferrule.operators import aggregate, bags, cluster, distinct, filters, joins, models, project, sample, scale, similarity, windows
from ferrule.plans.shipping import shipped
from ferrule.plans.spreading import spread
from ferrule.plans.staging import shared_dir, staged
from ferrule.sources import records
from ferrule.streaming import filter_mode

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = shipped(f)
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# -- projection ---------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_tax, l_extendedprice, l_extendedprice AS l_extendedprice_2, l_discount FROM lineitem")
def t01_cut(spark, sf):
    """Columns by number, from the end, by name and pattern, in request order, one twice."""
    return project.cut(t(spark, sf, "lineitem"), ["l_linenumber", -4, 6, "l_extendedprice", "/disc/"], id_column="l_orderkey")


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part")
def t01_cut_invert(spark, sf):
    return project.cut(t(spark, sf, "part"), ["5-6"], invert=True)


@query("""
SELECT coalesce(c.k, s.k) AS id, coalesce(c.name, s.name) AS name, coalesce(c.bal, s.bal) AS bal, coalesce(c.seg, '.') AS seg
FROM (SELECT c_custkey AS k, c_name AS name, c_acctbal::VARCHAR AS bal, c_mktsegment AS seg FROM customer) c
FULL JOIN (SELECT s_suppkey + 100 AS k, s_name AS name, s_acctbal::VARCHAR AS bal FROM supplier) s ON c.k = s.k""")
def t02_rearrange(spark, sf):
    """Two tables merged by identifier in the first one's column order; the first that has a value gives it."""
    a = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    b = t(spark, sf, "supplier").select((F.col("s_suppkey") + 100).alias("id"), F.col("s_acctbal").alias("bal"), F.col("s_name").alias("name"))
    return project.rearrange([a, b], "id", fill=".")


@query("SELECT p_partkey AS partkey, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size, p_retailprice AS retailprice FROM part")
def t03_rename(spark, sf):
    return project.rename(t(spark, sf, "part"), strip_prefix="p_")


# -- filters ------------------------------------------------------------------


@query("SELECT * FROM lineitem WHERE (l_quantity < 5 AND l_discount >= 0.05) OR (l_returnflag = 'R' AND l_tax = 0)")
def t05_filter(spark, sf):
    return filters.descriptor_filter(t(spark, sf, "lineitem"), "l_quantity<5&&l_discount.ge.0.05||l_returnflag=~^R$&&l_tax==0").passed


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT ((l_quantity < 5 AND l_discount >= 0.05) OR (l_returnflag = 'R' AND l_tax = 0))")
def t05_filter_rejected(spark, sf):
    return filters.descriptor_filter(t(spark, sf, "lineitem"), "l_quantity<5&&l_discount.ge.0.05||l_returnflag=~^R$&&l_tax==0").rejected.select("l_orderkey", "l_linenumber")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(l.quality = 1, false) OR coalesce(l.toxic = 1, false)")
def t05_filter_missing(spark, sf):
    """Missing cells fail every condition."""
    df = t(spark, sf, "documents").select("doc_id").join(t(spark, sf, "labels"), "doc_id", "left")
    return filters.descriptor_filter(df, "quality==1||toxic==1").passed.select("doc_id", "quality")


@query("SELECT p_partkey FROM part WHERE ((p_size < 10 AND p_retailprice > 950) OR p_brand = 'Brand#2') AND p_type <> 'ECONOMY'")
def t06_logical(spark, sf):
    c = F.col
    test = combine([c("p_size") < 10, c("p_retailprice") > 950, c("p_brand") == "Brand#2", c("p_type") == "ECONOMY"], "&|;", [False, False, False, True])
    return t(spark, sf, "part").where(test).select("p_partkey")


def _turns(spark, sf):
    """Conversations as tagged records: an id, then one item per turn, tagged by role."""
    turns = t(spark, sf, "conversations")
    seq = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("tag"), F.col("text").alias("value"))))
    head = F.array(F.struct(F.lit("PCN").alias("tag"), F.col("conv_id").cast("string").alias("value")))
    per = turns.groupBy("conv_id").agg(seq.alias("s"))
    return per.select("conv_id", F.concat(head, F.transform("s", lambda x: F.struct(x["tag"].alias("tag"), x["value"].alias("value")))).alias("items"))


@query("""SELECT conv_id, min(text) FILTER (WHERE turn = f) AS first_user, count(*) FILTER (WHERE role = 'user') AS users FROM
(SELECT *, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS f FROM conversations) GROUP BY conv_id
HAVING count(*) FILTER (WHERE role = 'assistant') > 0 AND conv_id > 5""")
def t07_item_filter(spark, sf):
    """Records with an assistant item and a numeric identifier above 5."""
    rows = _turns(spark, sf).where(records.item_filter("assistant", "present") & records.item_filter("PCN", ">", 5))
    return rows.select("conv_id", records.item("user").alias("first_user"), F.size(F.filter("items", lambda x: x["tag"] == "user")).cast("long").alias("users"))


@query("""SELECT c AS "column", m AS missing, n - m AS present FROM (SELECT count(*) AS n, count(*) - count(quality) AS a, count(*) - count(toxic) AS b, count(*) FILTER (WHERE lang = 'en') AS e
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), LATERAL (SELECT unnest(['quality', 'toxic', 'lang']) AS c, unnest([a, b, e]) AS m)""")
def t08_missing(spark, sf):
    df = t(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "en", ".").otherwise(F.col("lang")).alias("lang")).join(t(spark, sf, "labels"), "doc_id", "left")
    return filters.missing_counts(df, ["quality", "toxic", "lang"])


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE (l.quality IS NULL)::INT + (l.toxic IS NULL)::INT + (d.lang = 'en')::INT <= 1")
def t08_few_missing(spark, sf):
    df = t(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "en", ".").otherwise(F.col("lang")).alias("lang")).join(t(spark, sf, "labels"), "doc_id", "left")
    return filters.few_missing(df, ["quality", "toxic", "lang"], 1).passed.select("doc_id")


_FETCH = "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) o"


@query(f"SELECT o.o_orderkey, o.o_custkey, c.c_name FROM {_FETCH} JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.r = 1 AND c.c_mktsegment = 'MACHINERY'")
def t09_fetch(spark, sf):
    """The first order of each listed customer, with the list's own column."""
    ids = t(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey", "c_name")
    return filters.fetch(t(spark, sf, "orders"), ids, "o_custkey", "o_orderkey", id_key="c_custkey", append=True).found.select("o_orderkey", "o_custkey", "c_name")


@query("SELECT c_custkey AS o_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def t09_fetch_leftover(spark, sf):
    ids = t(spark, sf, "customer").select("c_custkey")
    return filters.fetch(t(spark, sf, "orders"), ids, "o_custkey", "o_orderkey", id_key="c_custkey").identifiers_not_found


@query(r"SELECT len(regexp_extract_all(text, '\S+')) AS tokens, count(*) AS records FROM benchmark GROUP BY 1")
def t11_tokens(spark, sf):
    return filters.token_counts(t(spark, sf, "benchmark"), "text")


@query("""SELECT conv_id, turn, a AS tokens, b AS expected FROM (SELECT *, len(string_split(text, '.')) AS a, lag(len(string_split(text, '.'))) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL AND a <> b""")
def t11_irregular(spark, sf):
    return filters.irregular(t(spark, sf, "conversations"), "text", "turn", "conv_id", sep=".").select("conv_id", "turn", "tokens", "expected")


@query("""SELECT c AS "column", count(x) AS n, 0::BIGINT AS missing, count(DISTINCT x) AS distinct_values, (SELECT 1)::BIGINT * max(k) AS most_common, min(x) AS minval, max(x) AS maxval, round(var_samp(x), 3) AS var FROM
(SELECT *, count(*) OVER (PARTITION BY c, x) AS k FROM (SELECT unnest(['l_quantity', 'l_tax', 'l_discount']) AS c, unnest([l_quantity, l_tax, l_discount]) AS x FROM lineitem)) GROUP BY c""")
def t12_variance(spark, sf):
    return rounded(filters.column_profile(t(spark, sf, "lineitem"), ["l_quantity", "l_tax", "l_discount"]), 3, "var")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def t12_enough_variance(spark, sf):
    """Columns with too few values go; what is left is selected."""
    df = t(spark, sf, "lineitem")
    return df.select("l_orderkey", "l_linenumber", *filters.enough_variance(df, ["l_extendedprice", "l_tax", "l_discount"], min_distinct=60))


# -- joins --------------------------------------------------------------------

_O = "(SELECT o_custkey AS k, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)"


def _concat(spark, sf, how):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"), "c_name")
    o = t(spark, sf, "orders").select((F.col("o_custkey") + 10).alias("id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority"))
    return joins.concat_files([c, o], "id", "ord", how)


_CONCAT = "SELECT coalesce(c.c_custkey, o.id) AS id, coalesce(c.c_name, '.') AS c_name, coalesce(o.p, '.') AS o_orderpriority FROM customer c {} JOIN (SELECT o_custkey + 10 AS id, arg_min(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1) o ON c.c_custkey = o.id"


@query(_CONCAT.format("LEFT"))
def t13_concat_left(spark, sf):
    return _concat(spark, sf, "left")


@query(_CONCAT.format("INNER"))
def t13_concat_inner(spark, sf):
    return _concat(spark, sf, "inner")


@query(_CONCAT.format("FULL"))
def t13_concat_full(spark, sf):
    return _concat(spark, sf, "full")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey + 10 FROM orders)")
def t13_lost(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    o = t(spark, sf, "orders").select((F.col("o_custkey") + 10).alias("id"))
    return joins.lost_rows([c, o], "id").select(F.col("id").cast("long").alias("id"))


@query("""SELECT c.conv_id, 1 + count(*) + coalesce(max(e.k), 0) AS n_items, max(e.kind) AS kind FROM conversations c
LEFT JOIN (SELECT user_id, 2 AS k, min(event_type) AS kind FROM events GROUP BY user_id) e ON c.conv_id = e.user_id GROUP BY c.conv_id""")
def f03_item_join(spark, sf):
    left = _turns(spark, sf)
    per = t(spark, sf, "events").groupBy("user_id").agg(F.min("event_type").alias("kind"))
    pair = lambda tag, c: F.struct(F.lit(tag).alias("tag"), c.cast("string").alias("value"))
    right = per.select(F.array(pair("PCN", F.col("user_id")), pair("KIND", F.col("kind")), pair("user", F.lit("x")), pair("SRC", F.lit("events"))).alias("items"))
    out = joins.join_items(left, right, "PCN", drop_repeats=True)
    return out.select("conv_id", F.size("items").cast("long").alias("n_items"), records.item("KIND").alias("kind"))


@query("SELECT l.l_orderkey, l.l_linenumber, p.p_retailprice AS activity FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_size > 45")
def t14_activity(spark, sf):
    act = t(spark, sf, "part").where("p_size > 45").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("activity"))
    return t(spark, sf, "lineitem").join(act, "l_partkey").select("l_orderkey", "l_linenumber", "activity")


# -- fingerprints of texts and similarity joins ----------------------------------


def tokens(c: str):
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))


def doc_fp(spark, sf):
    """Staged, for operators that read it more than once."""
    return staged(doc_tokens(spark, sf), "docfp")


def doc_tokens(spark, sf):
    return scale.fingerprint_of_tokens(spread(t(spark, sf, "documents").select("doc_id", "text")), "doc_id", tokens("text"))


def doc_bags(spark, sf):
    return bags.token_bags(spread(t(spark, sf, "documents").select("doc_id", "text")), "doc_id", F.col("text"))


def item_fp(spark, sf):
    return scale.fingerprint_of_tokens(t(spark, sf, "benchmark"), "item_id", tokens("text"))


_FP = """fp AS MATERIALIZED (SELECT id, ('0x' || substr(md5(tok), 1, 8))::BIGINT AS bit, count(*)::INT AS cnt FROM (SELECT {id} AS id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS tok FROM {table}) GROUP BY ALL)"""
_DOC, _ITEM = _FP.format(id="doc_id", table="documents"), _FP.format(id="item_id", table="benchmark")
_PAIRS = """n AS (SELECT id, sum(cnt) AS n FROM fp GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, sum(least(a.cnt, b.cnt)) AS c FROM fp a JOIN fp b ON a.bit = b.bit AND a.id < b.id GROUP BY ALL),
d AS MATERIALIZED (SELECT a, b, 1 - c / (x.n + y.n - c)::DOUBLE AS d FROM p JOIN n x ON a = x.id JOIN n y ON b = y.id)"""
_NEEDLES = f"""WITH {_ITEM}, h AS (SELECT * FROM ({_DOC.replace('fp AS MATERIALIZED (', '', 1)[:-1]})),
na AS (SELECT id, sum(cnt) AS n FROM fp GROUP BY id), nb AS (SELECT id, sum(cnt) AS n FROM h GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, sum(least(a.cnt, b.cnt)) AS c FROM fp a JOIN h b ON a.bit = b.bit GROUP BY ALL),
d AS (SELECT a AS needle, b AS hay, 1 - c / (na.n + nb.n - c)::DOUBLE AS d FROM p JOIN na ON a = na.id JOIN nb ON b = nb.id)"""


@query(f"{_NEEDLES} SELECT needle, hay, round(d, 9) AS d, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY d, hay) AS r FROM d WHERE d < 0.99) WHERE r <= 5")
def f05_nearest(spark, sf):
    """The five documents nearest to each benchmark item by counted Tanimoto, strictly nearer than 0.99."""
    pairs = similarity.closest(item_fp(spark, sf), doc_tokens(spark, sf), 5, upper=0.99)
    return rounded(similarity.nearest(pairs, 5, upper=0.99), 9, "d").select("needle", "hay", "d", "rank")


@query(f"""{_NEEDLES}, w AS (SELECT *, d < 0.9 AS i, sum((d < 0.9)::INT) OVER (PARTITION BY needle) AS n FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY CASE WHEN n >= 2 AND NOT i THEN 1 ELSE 0 END, d, hay) AS r FROM w)
SELECT needle, hay, round(d, 9) AS d, r::INT AS rank FROM r WHERE CASE WHEN n >= 2 THEN i AND r <= 5 ELSE r <= 2 END""")
def f05_nearest_rescan(spark, sf):
    pairs = similarity.closest(item_fp(spark, sf), doc_tokens(spark, sf), 5, upper=0.9, least=2)
    return rounded(similarity.nearest_at_least(pairs, 5, 2, upper=0.9), 9, "d").select("needle", "hay", "d", "rank")


@query(f"WITH {_ITEM}, {_PAIRS} SELECT needle, hay, round(d, 9) AS d, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY d, hay) AS r FROM (SELECT a AS needle, b AS hay, d FROM d UNION ALL SELECT b, a, d FROM d)) WHERE r <= 3")
def f06_nearest_self(spark, sf):
    one = similarity.pair_distances(item_fp(spark, sf), item_fp(spark, sf), same=True)
    both = one.union(one.select(F.col("hay").alias("needle"), F.col("needle").alias("hay"), "d"))
    return rounded(similarity.nearest(both, 3), 9, "d").select("needle", "hay", "d", "rank")


@query(f"WITH {_DOC}, {_PAIRS} SELECT a, b, round(d, 9) AS d FROM d WHERE d <= 0.3")
def f06_within(spark, sf):
    """All pairs of documents within a distance, by prefixes of rare bits."""
    return rounded(bags.pairs_within(doc_bags(spark, sf), 0.3), 9, "d")


@query(f"{_NEEDLES}, g AS (SELECT needle, count(*) AS n, min(d) AS m FROM d WHERE d < 0.8 GROUP BY 1) SELECT i.item_id AS id, coalesce(n, 0) AS n_close, round(m, 9) AS nearest, coalesce(n, 0) >= 2 AS rejected FROM benchmark i LEFT JOIN g ON i.item_id = g.needle")
def f08_distance_filter(spark, sf):
    return rounded(similarity.distance_filter(item_fp(spark, sf), doc_fp(spark, sf), 0.8, at_least=2), 9, "nearest")


def _listed(spark, sf):
    items = t(spark, sf, "benchmark").select("item_id")
    return items.select(F.col("item_id").alias("id1"), (F.col("item_id") + 7).alias("id2"))


_MAPS = f"""WITH {_ITEM}, l AS (SELECT item_id AS id1, item_id + 7 AS id2 FROM benchmark),
u AS (SELECT id1, id2, k.bit, coalesce(a.cnt, 0) AS x, coalesce(b.cnt, 0) AS y FROM (SELECT DISTINCT id1, id2, bit FROM l JOIN fp ON fp.id IN (id1, id2)) k
LEFT JOIN fp a ON a.id = id1 AND a.bit = k.bit LEFT JOIN fp b ON b.id = id2 AND b.bit = k.bit WHERE id1 IN (SELECT id FROM fp) AND id2 IN (SELECT id FROM fp))"""


def _metric(name, sql, f):
    @query(f"{_MAPS} SELECT id1, id2, round((1 - ({sql}))::DOUBLE, 9) AS d FROM u GROUP BY id1, id2")
    def run(spark, sf):
        maps = scale.as_maps(item_fp(spark, sf))
        return rounded(similarity.listed_pairs(_listed(spark, sf), maps, f(F.col("a"), F.col("b"))), 9, "d")

    QUERIES[f"f10_pairs_{name}"] = QUERIES.pop("run")
    ORACLES[f"f10_pairs_{name}"] = ORACLES.pop("run")


_metric("tanimoto", "sum(least(x, y)) / sum(greatest(x, y))", metrics.tanimoto)
_metric("binary", "count(*) FILTER (WHERE x > 0 AND y > 0) / count(*)", metrics.tanimoto_binary)
_metric("dice", "2 * sum(least(x, y)) / sum(x + y)", metrics.dice)
_metric("cosine", "sum(x * y) / sqrt(sum(x * x)::DOUBLE * sum(y * y))", metrics.cosine)
_metric("ctan", "sum(x * y) / (sum(x * x) + sum(y * y) - sum(x * y))", metrics.continuous_tanimoto)
_metric("manhattan", "1 / (1 + sum(abs(x - y)))", metrics.manhattan)
_metric("soergel", "1 - sum(abs(x - y)) / sum(greatest(x, y))", metrics.soergel)
_metric("soergel_mean", "1 - avg(abs(x - y) / greatest(x, y))", metrics.soergel_mean)
_metric("dot", "sum(x * y)", metrics.dot)
_metric("tversky", "sum(least(x, y)) / (0.5 * (sum(x) - sum(least(x, y))) + 1.5 * (sum(y) - sum(least(x, y))) + sum(least(x, y)))", lambda a, b: metrics.tversky(a, b, 0.5, 1.5))
_metric("optimistic", "1 - least(1 - sum(least(x, y)) / sum(greatest(x, y)), 1 - sum(least(x, y)) / (0.5 * (sum(x) - sum(least(x, y))) + 1.5 * (sum(y) - sum(least(x, y))) + sum(least(x, y))), 1 - sum(least(x, y)) / (0.5 * (sum(y) - sum(least(x, y))) + 1.5 * (sum(x) - sum(least(x, y))) + sum(least(x, y))))", lambda a, b: 1 - metrics.optimistic_distance(a, b, 0.5, 1.5))


_DENSE = f"""WITH {_ITEM}, w AS (SELECT DISTINCT id, bit % 256 AS bit FROM fp), l AS (SELECT item_id AS id1, item_id + 7 AS id2 FROM benchmark),
s AS (SELECT id1, id2, (SELECT count(*) FROM w WHERE id = id1) AS a, (SELECT count(*) FROM w WHERE id = id2) AS b, (SELECT count(*) FROM w x JOIN w y ON x.bit = y.bit WHERE x.id = id1 AND y.id = id2) AS c FROM l WHERE id1 IN (SELECT id FROM w) AND id2 IN (SELECT id FROM w))
SELECT id1, id2, {{}} FROM s"""


@query(_DENSE.format("round(c / (a + b - c)::DOUBLE, 9) AS tanimoto, round(c / 256, 9) AS russel_rao, round(c / (a * b)::DOUBLE, 9) AS forbes, round((256 - a - b + 2 * c) / 256, 9) AS simple_matching, round(2 * c / (a + b)::DOUBLE, 9) AS sorensen_dice, round(c / least(a, b)::DOUBLE, 9) AS overlap, round(((2 - (a + b) / 512) * (c / (a + b - c)::DOUBLE) + (1 + (a + b) / 512) * ((256 - a - b + c) / (256 - c)::DOUBLE)) / 3, 9) AS fvb, round(c / 256, 9) AS fraction"))
def f10_pairs_dense(spark, sf):
    """Eight coefficients of folded 256-bit fingerprints of listed pairs."""
    words = scale.to_dense(item_fp(spark, sf), 256)
    a, b = words.select(F.col("id").alias("id1"), F.col("words").alias("a")), words.select(F.col("id").alias("id2"), F.col("words").alias("b"))
    both = _listed(spark, sf).join(a, "id1").join(b, "id2")
    return both.select("id1", "id2", *[F.round(f(F.col("a"), F.col("b")), 9).alias(n) for n, f in metrics.DENSE.items()])


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda v: floor(abs(v::DOUBLE) * 10)::INT) AS p FROM embeddings),
z AS (SELECT a.vec_id AS id1, b.vec_id AS id2, unnest(a.p) AS x, unnest(b.p) AS y FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT id1, id2, round(avg(CASE WHEN x = y THEN 1 WHEN x = 0 OR y = 0 THEN 0.5 ELSE least(x, y) / greatest(x, y)::DOUBLE END), 9) AS ratio, round(CASE WHEN sum(x + y) = 0 THEN 1 ELSE 2 * sum(least(x, y)) / sum(x + y) END, 9) AS dice,
round(1 - sqrt(sum((x - y) * (x - y))), 9) AS cartesian, round(avg(exp(-abs(x - y))), 9) AS exp1, round(avg(exp(-(x - y) * (x - y)::DOUBLE)), 9) AS exp2 FROM z GROUP BY ALL""")
def f10_pairs_properties(spark, sf):
    """Similarities of vectors of small whole numbers, each with the next one."""
    v = t(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 10).cast("int")).alias("p"))
    a, b = v.select(F.col("vec_id").alias("id1"), F.col("p").alias("a"), (F.col("vec_id") + 1).alias("id2")), v.select(F.col("vec_id").alias("id2"), F.col("p").alias("b"))
    fs = {n: metrics.PROPERTY[n] for n in ("ratio", "dice", "cartesian", "exp1", "exp2")}
    return a.join(b, "id2").select("id1", "id2", *[F.round(f(F.col("a"), F.col("b")), 9).alias(n) for n, f in fs.items()])


@query(f"""WITH {_ITEM}, {_PAIRS} SELECT a AS id1, b AS id2, round(d, 2) AS d FROM d""")
def f11_distance_matrix(spark, sf):
    """The lower triangle in long form, rounded; pairs without a common bit are 1 and left out."""
    fp = item_fp(spark, sf)
    return similarity.pair_distances(fp, fp, same=True).select(F.col("needle").alias("id1"), F.col("hay").alias("id2"), F.round("d", 2).alias("d"))


@query(f"WITH {_ITEM}, n AS (SELECT id, count(*) AS k, sum(cnt) AS n FROM fp GROUP BY id), x AS (SELECT a.id AS id1, b.id AS id2, sum(least(a.cnt, b.cnt)) AS c FROM fp a JOIN fp b ON a.bit = b.bit AND a.id < b.id GROUP BY ALL) SELECT id1, id2, round(0.7 * c / (p.n + q.n - c)::DOUBLE + 0.3 * 2 * c / (p.n + q.n)::DOUBLE, 9) AS s FROM x JOIN n p ON id1 = p.id JOIN n q ON id2 = q.id WHERE abs(p.k - q.k) <= 2")
def f_composite(spark, sf):
    """A weighted sum of two similarities inside a window of sizes."""
    maps = scale.as_maps(item_fp(spark, sf))
    a, b = maps.select(F.col("id").alias("id1"), F.struct("fp").alias("a")), maps.select(F.col("id").alias("id2"), F.struct("fp").alias("b"))
    cand = similarity.pair_distances(item_fp(spark, sf), item_fp(spark, sf), same=True).select(F.col("needle").alias("id1"), F.col("hay").alias("id2"))
    both = similarity.natoms_window(cand.join(a, "id1").join(b, "id2"), F.size("a.fp"), F.size("b.fp"), 2)
    return both.select("id1", "id2", F.round(metrics.composite([(metrics.tanimoto, "fp", 0.7), (metrics.dice, "fp", None)]), 9).alias("s"))


@query(f"WITH {_ITEM}, {_PAIRS}, b2 AS (SELECT a AS id, b AS o, d FROM d UNION ALL SELECT b, a, d FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, o) AS r FROM b2 WHERE d < 0.97) SELECT id AS id1, o AS id2, round(d, 9) AS d FROM r WHERE r <= 4 AND d >= 0.5 AND id IN (SELECT id FROM r WHERE r <= 4 AND d >= 0.5 GROUP BY id HAVING count(*) >= 2)")
def f37_neighbour_lists(spark, sf):
    """Neighbour lists cut by number and distance, as three columns."""
    one = similarity.pair_distances(item_fp(spark, sf), item_fp(spark, sf), same=True)
    both = one.union(one.select(F.col("hay").alias("needle"), F.col("needle").alias("hay"), "d"))
    lists = similarity.neighbour_lists(similarity.nearest(both, 4, upper=0.97))
    return rounded(similarity.three_columns(similarity.trim_lists(lists, min_distance=0.5, least=2)), 9, "d")


@query(f"WITH {_ITEM}, {_PAIRS}, m AS (SELECT id, min(d) AS d FROM (SELECT a AS id, d FROM d UNION ALL SELECT b, d FROM d) GROUP BY id) SELECT floor(d / 0.05 + 1e-9)::INT AS bucket, count(*) AS n FROM m GROUP BY 1")
def f37_nearest_histogram(spark, sf):
    one = similarity.pair_distances(item_fp(spark, sf), item_fp(spark, sf), same=True)
    both = one.union(one.select(F.col("hay").alias("needle"), F.col("needle").alias("hay"), "d"))
    return similarity.nearest_histogram(similarity.neighbour_lists(both), 0.05)


# -- aggregation -------------------------------------------------------------------

_LONG = "(SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS c, unnest([l_quantity, l_extendedprice, l_discount]) AS x FROM lineitem)"


@query(f"""SELECT c AS "column", count(x) AS n, 0::BIGINT AS n_missing, min(x) AS minval, max(x) AS maxval, round(sum(x), 2) AS total, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, count(*) FILTER (WHERE x = 0) AS n_special FROM {_LONG} GROUP BY c""")
def t15_average(spark, sf):
    return rounded(rounded(aggregate.average(t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], special=0.0), 6, "mean", "sd"), 2, "total")


@query("""WITH r AS (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
p AS (SELECT unnest([0.0, 25.0, 50.0, 95.0, 100.0])::DOUBLE AS percent) SELECT l_returnflag, percent, x AS value FROM r, p WHERE i = least(floor(percent * n / 100 + 0.4999)::BIGINT, n - 1)""")
def t15_percentiles(spark, sf):
    return aggregate.percentiles(t(spark, sf, "lineitem"), "l_extendedprice", [0, 25, 50, 95, 100], ["l_returnflag"])


@query("SELECT l_linestatus, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted_mean, sum(l_quantity) AS weight FROM lineitem GROUP BY l_linestatus")
def t15_prevalence(spark, sf):
    return rounded(aggregate.prevalence_average(t(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_linestatus"]), 4, "weighted_mean")


@query("""WITH b AS (SELECT floor(c_acctbal / 500 + 0.5)::BIGINT AS v, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT unnest(range(min(v), max(v) + 1)) AS v FROM b)
SELECT s.v * 500.0::DOUBLE AS value, coalesce(n, 0)::BIGINT AS n, coalesce(n, 0) / (sum(n) OVER ())::DOUBLE AS share FROM s LEFT JOIN b ON s.v = b.v""")
def t16_distribution(spark, sf):
    return aggregate.distribution(t(spark, sf, "customer"), "c_acctbal", accuracy=500.0, normalise="area", zero_bins=True)


@query("SELECT l_shipdate, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL")
def t17_counts(spark, sf):
    return aggregate.key_counts(t(spark, sf, "lineitem"), ["l_shipdate", "l_returnflag"])


@query("SELECT least(floor((l_quantity - 1) / 7), 6)::INT AS bucket, count(*) AS n FROM lineitem WHERE l_quantity >= 1 AND l_quantity <= 50 GROUP BY 1")
def t19_histogram(spark, sf):
    return aggregate.histogram(t(spark, sf, "lineitem"), "l_quantity", 1, 50, 7)


@query("""WITH h AS (SELECT round_even((l_quantity - 1) / 7, 0)::INT AS b FROM lineitem WHERE l_quantity BETWEEN 1 AND 50), s AS (SELECT b + unnest([-1, 0, 1, 2]) AS bucket FROM h)
SELECT bucket, count(*) AS n FROM s WHERE bucket BETWEEN 0 AND 7 GROUP BY 1""")
def t19_fuzzy_histogram(spark, sf):
    return aggregate.fuzzy_histogram(t(spark, sf, "lineitem"), "l_quantity", 1, 50, 7, minus=1, plus=3)


def _predictions(spark, sf):
    li = t(spark, sf, "lineitem")
    return li.select("l_returnflag", "l_extendedprice", (F.col("l_quantity") * 1500 + 100 * F.col("l_linenumber")).alias("pred"), (F.col("l_orderkey") * 100000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("i"))


_PRED = "p AS (SELECT l_returnflag, l_extendedprice AS o, l_quantity * 1500 + 100 * l_linenumber AS p, l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS i FROM lineitem)"


@query(f"""WITH {_PRED}, e AS (SELECT *, abs(o - p) AS e FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY e, i) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM e),
s AS (SELECT l_returnflag, count(*) AS n, avg(e) AS mae, sqrt(avg(e * e)) AS rmse, avg(o) - avg(p) AS bias, corr(o, p) AS c, sum(e * e) AS sse, var_pop(o) * count(*) AS sst, max(CASE WHEN k = n // 2 THEN e END) AS ae50, max(CASE WHEN k = n * 95 // 100 THEN e END) AS ae95, max(e) AS maxerr FROM k GROUP BY 1)
SELECT l_returnflag, n, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(bias, 4) AS bias, round(sign(c) * c * c, 6) + 0.0 AS r2, round(CASE WHEN sse <= sst THEN 1 - sse / sst ELSE sst / sse - 1 END, 6) AS q2, round(ae50, 4) AS ae50, round(ae95, 4) AS ae95, round(maxerr, 4) AS maxerr FROM s""")
def f12_regression(spark, sf):
    out = aggregate.regression_metrics(_predictions(spark, sf), "l_extendedprice", "pred", "i", ["l_returnflag"])
    return rounded(rounded(out, 4, "mae", "rmse", "bias", "ae50", "ae95", "maxerr"), 6, "r2", "q2")


@query(f"""WITH {_PRED}, f AS (SELECT *, o - p AS d, abs(o - p) AS e, greatest(o, p) / least(o, p) AS q FROM p QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY p DESC, i) <= (count(*) OVER (PARTITION BY l_returnflag)) * 40 // 99.999),
r AS (SELECT *, count(*) OVER (PARTITION BY l_returnflag) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY d, i) - 1 AS k FROM f),
m AS (SELECT l_returnflag, max(d) AS mid FROM r WHERE k = n // 2 GROUP BY 1), a AS (SELECT r.*, abs(d - mid) AS off FROM r JOIN m USING (l_returnflag)),
h AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY off, i) - 1 AS j FROM a),
s AS (SELECT l_returnflag, count(*) AS n, avg((e < 5000)::INT) AS w0, avg((e < 20000)::INT) AS w1, avg((q < 2)::INT) AS r0, abs(avg(d)) AS b, 1.4826 * max(CASE WHEN j = n // 2 THEN off END) AS mad FROM h GROUP BY 1)
SELECT l_returnflag, n, round(w0, 9) AS within_0, round(w1, 9) AS within_1, round(r0, 9) AS ratio_0, round(b + (1.645 + 0.325 * exp(-4.134 * b / mad)) * mad, 4) AS cmsd FROM s""")
def f12_best_share(spark, sf):
    """The best two fifths by prediction: shares within error limits and the significant difference."""
    out = aggregate.regression_metrics(_predictions(spark, sf), "l_extendedprice", "pred", "i", ["l_returnflag"], percent=40, folds=(5000, 20000), ratios=(2,), cmsr=95)
    return rounded(rounded(out.select("l_returnflag", "n", "within_0", "within_1", "ratio_0", "cmsd"), 9, "within_0", "within_1", "ratio_0"), 4, "cmsd")


_RUN = "avg(o) OVER (PARTITION BY l_returnflag ORDER BY {} ROWS UNBOUNDED PRECEDING)"
_NTH = "row_number() OVER (PARTITION BY l_returnflag ORDER BY {})"
_DEPTHS = f"""WITH {_PRED}, best AS (SELECT l_returnflag, {_NTH.format("o DESC, i")} AS r, {_RUN.format("o DESC, i")} AS hi FROM p), worst AS (SELECT l_returnflag, {_NTH.format("o, i")} AS r, {_RUN.format("o, i")} AS lo FROM p),
own AS (SELECT l_returnflag, {_NTH.format("p DESC, i")} AS r, {_RUN.format("p DESC, i")} AS y, avg(o) OVER (PARTITION BY l_returnflag) AS m, max(o) OVER (PARTITION BY l_returnflag) - min(o) OVER (PARTITION BY l_returnflag) AS spread FROM p),
j AS (SELECT *, CASE WHEN y > m THEN hi - m ELSE m - lo END AS room, last_value(CASE WHEN hi - lo > 1e-9 * spread THEN hi - lo END IGNORE NULLS) OVER (PARTITION BY l_returnflag ORDER BY r ROWS UNBOUNDED PRECEDING) AS wt
FROM own JOIN best USING (l_returnflag, r) JOIN worst USING (l_returnflag, r))"""


@query(f"""{_DEPTHS}, n AS (SELECT l_returnflag, count(*) AS n FROM p GROUP BY 1), b AS (SELECT l_returnflag, sum((y - m) / room * wt) / sum(wt) AS b2 FROM j WHERE abs(y - m) > 1e-9 * spread AND room >= 1e-5 GROUP BY 1)
SELECT l_returnflag, n, round(b2, 6) AS b2 FROM n JOIN b USING (l_returnflag)""")
def f13_b_squared(spark, sf):
    return rounded(aggregate.b_squared(_predictions(spark, sf), "l_extendedprice", "pred", "i", "l_returnflag"), 6, "b2")


@query(f"""{_DEPTHS}, k AS (SELECT *, abs(y - m) > 1e-9 * spread AND room >= 1e-5 * spread AS told FROM j),
c AS (SELECT l_returnflag, r, told, sum(CASE WHEN told THEN (y - m) / room * wt END) OVER w / sum(wt) OVER w AS v FROM k WINDOW w AS (PARTITION BY l_returnflag ORDER BY r ROWS UNBOUNDED PRECEDING))
SELECT l_returnflag, r AS rank, round(coalesce(last_value(CASE WHEN told THEN v END IGNORE NULLS) OVER (PARTITION BY l_returnflag ORDER BY r ROWS UNBOUNDED PRECEDING), 0), 5) AS b2 FROM c""")
def f13_curve(spark, sf):
    """The statistic at every depth of the ranking."""
    return rounded(aggregate.b_squared_curve(_predictions(spark, sf), "l_extendedprice", "pred", "i", "l_returnflag"), 5, "b2")


@query("""WITH r AS (SELECT event_type, (user_id % 7 = 0)::INT AS act, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r, row_number() OVER (PARTITION BY event_type, user_id % 7 = 0 ORDER BY value DESC, event_id) AS j, count(*) OVER (PARTITION BY event_type) AS n FROM events),
s AS (SELECT event_type, max(n) AS n, sum(act)::BIGINT AS k, sum(act * r) AS rs, sum(act * exp(-20.0 * r / n)) AS es, sum((act = 1 AND r <= floor(n * 0.1))::INT) AS top FROM r GROUP BY 1),
-- Of each active row, the share of inactive rows that it beats.
a AS (SELECT event_type, avg((s.n - s.k - (r.r - r.j)) / (s.n - s.k)::DOUBLE) AS roc FROM r JOIN s USING (event_type) WHERE act = 1 GROUP BY 1),
x AS (SELECT *, k / n::DOUBLE AS ra, k / n::DOUBLE * exp(-20.0 / n) * (1 - exp(-20.0)) / (1 - exp(-20.0 / n)) AS chance FROM s JOIN a USING (event_type))
SELECT event_type, n, k AS actives, round(roc, 9) AS roc, round(es / chance, 9) AS rie, round(es / chance * ra * ((exp(10.0) - exp(-10.0)) / 2) / ((exp(10.0) + exp(-10.0)) / 2 - (exp(10 - 20 * ra) + exp(20 * ra - 10)) / 2) + 1 / (1 - exp(20 * (1 - ra))), 9) AS bedroc,
round(top / k::DOUBLE / 0.1, 9) AS ef, round(1 - rs / k / n::DOUBLE + 0.5 / n, 9) AS auac FROM x WHERE k > 0 AND k < n""")
def f14_enrichment(spark, sf):
    ev = t(spark, sf, "events").withColumn("active", (F.col("user_id") % 7 == 0).cast("int"))
    return rounded(aggregate.enrichment(ev, "value", "active", "event_id", "event_type"), 9, "roc", "rie", "bedroc", "ef", "auac")


@query(f"""WITH {_DOC}, a AS (SELECT doc_id AS id, n_chars::DOUBLE AS y FROM documents), k AS (SELECT bit, y FROM fp JOIN a USING (id)), w AS (SELECT count(*) AS n, sum(y) AS s FROM a WHERE id IN (SELECT id FROM fp)),
g AS (SELECT bit, count(*) AS n, sum(y) AS s FROM k GROUP BY bit HAVING count(*) >= 20) SELECT bit, g.n, round(g.s / g.n, 4) AS mean_with, round((w.s - g.s) / nullif(w.n - g.n, 0), 4) AS mean_without FROM g, w""")
def f15_profile(spark, sf):
    out = models.profile_activity(doc_fp(spark, sf), t(spark, sf, "documents"), "doc_id", "n_chars", support=20)
    return rounded(out, 4, "mean_with", "mean_without").drop("t")


@query(f"""WITH {_DOC}, c AS (SELECT bit, lang AS label, count(*) AS n FROM fp JOIN documents ON id = doc_id GROUP BY ALL) SELECT bit, label, n, n / (sum(n) OVER (PARTITION BY bit))::DOUBLE AS share FROM c QUALIFY sum(n) OVER (PARTITION BY bit) >= 20""")
def f15_profile_classes(spark, sf):
    return models.profile_classes(doc_tokens(spark, sf), t(spark, sf, "documents"), "doc_id", "lang", support=20)


@query(f"WITH {_DOC} SELECT bit, count(*) AS n, sum(cnt)::BIGINT AS total FROM fp GROUP BY bit")
def f16_modal(spark, sf):
    return models.modal_fingerprint(doc_tokens(spark, sf))


@query(f"WITH {_ITEM} SELECT a.bit, b.bit AS bit2, count(*) AS n FROM fp a JOIN fp b ON a.id = b.id AND a.bit < b.bit GROUP BY ALL")
def f16_modal_pairs(spark, sf):
    return models.modal_fingerprint(item_fp(spark, sf), pairs=True)


@query(f"WITH {_ITEM}, c AS (SELECT bit, count(*) AS n FROM fp GROUP BY bit) SELECT bit, row_number() OVER (ORDER BY n DESC, bit) - 1 AS ordinal, n FROM c")
def f17_bit_dictionary(spark, sf):
    return scale.bit_dictionary(item_fp(spark, sf))


def _structures(spark, sf):
    d = t(spark, sf, "documents")
    return d.select(F.md5(F.lower("text")).alias("key"), "doc_id", F.length("source").alias("a0"), ((F.col("doc_id") * 37) % 101).alias("act"))


_STRUCT = "s AS (SELECT md5(lower(text)) AS key, doc_id, (doc_id * 37) % 101 AS act FROM documents)"


@query(f"WITH {_STRUCT} SELECT key, count(*) AS n, min(act)::DOUBLE AS minval, max(act)::DOUBLE AS maxval, round(avg(act), 9) AS mean, max(act) - min(act) <= 20 AS consistent FROM s GROUP BY key")
def m05_consistency(spark, sf):
    groups, _ = aggregate.activity_consistency(_structures(spark, sf), "key", "act", "doc_id", "doc_id", tolerance=20)
    return rounded(groups, 9, "mean")


def _merged(name, sql):
    @query(f"WITH {_STRUCT} {sql}")
    def run(spark, sf):
        _, merged = aggregate.activity_consistency(_structures(spark, sf), "key", "act", "doc_id", "doc_id", merge=name)
        return rounded(merged, 9, "activity")

    QUERIES[f"m05_merge_{name}"] = QUERIES.pop("run")
    ORACLES[f"m05_merge_{name}"] = ORACLES.pop("run")


_merged("max", "SELECT key, doc_id AS id, act::DOUBLE AS activity FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY act DESC, doc_id) = 1")
_merged("median", "SELECT key, doc_id AS id, act::DOUBLE AS activity FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY act, doc_id) - 1 = count(*) OVER (PARTITION BY key) // 2")
_merged("vote", ", v AS (SELECT key, act, count(*) AS v, min(doc_id) AS id FROM s GROUP BY ALL) SELECT key, id, act::DOUBLE AS activity FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY v DESC, act) = 1")
_merged("range", "SELECT key, min(doc_id) AS id, (max(act) - min(act))::DOUBLE AS activity FROM s GROUP BY key")
_merged("ave", ", m AS (SELECT *, avg(act) OVER (PARTITION BY key) AS m FROM s) SELECT key, doc_id AS id, round(m, 9) AS activity FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY abs(act - m), doc_id) = 1")


@query(f"WITH {_STRUCT} SELECT key, string_agg(doc_id::VARCHAR, '+' ORDER BY doc_id) AS names, count(*) AS n FROM s GROUP BY key")
def m06_common_names(spark, sf):
    df = _structures(spark, sf).withColumn("name", F.col("doc_id").cast("string"))
    return aggregate.common_names(df, "key", "name", "doc_id", sep="+")


@query("SELECT o_orderpriority AS reason, count(*) AS n, count(*) / (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')::DOUBLE AS share, min(o_orderkey) AS example FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def m07_reasons(spark, sf):
    return aggregate.reason_summary(t(spark, sf, "orders").where("o_orderstatus = 'F'"), F.col("o_orderpriority"), "o_orderkey")


@query("""WITH t AS (SELECT p_partkey AS id, p_retailprice AS t FROM part), p AS (SELECT l_partkey AS id, l_extendedprice / l_quantity AS p FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_partkey, l_extendedprice / l_quantity FROM lineitem WHERE l_linenumber = 2)
SELECT id, count(p) AS n, round(avg(abs(p - t)), 6) AS mean_error, max(abs(p - t)) AS worst_error FROM p JOIN t USING (id) GROUP BY id""")
def m08_mispredicted(spark, sf):
    truth = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"))
    li = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"), "l_linenumber")
    return rounded(aggregate.mispredicted(truth, [li.where("l_linenumber = 1"), li.where("l_linenumber = 2")], "id", "v"), 6, "mean_error")


@query("SELECT quality AS observed, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL")
def s01_confusion(spark, sf):
    return aggregate.confusion_matrix(t(spark, sf, "labels"), "quality", "toxic")


# -- windows -----------------------------------------------------------------------


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING), 9) AS running FROM events")
def w01_running_average(spark, sf):
    return rounded(windows.running_average(t(spark, sf, "events"), "value", 5, ["user_id"], ["ts", "event_id"]), 9, "running").select("event_id", "running")


@query("SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING), ',') AS recent FROM events")
def w02_most_recent(spark, sf):
    return windows.most_recent(t(spark, sf, "events"), "event_type", 3, ["user_id"], ["ts", "event_id"]).select("event_id", F.array_join("recent", ",").alias("recent"))


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) <= 2")
def w03_first_rows(spark, sf):
    return filters.first_rows(t(spark, sf, "events"), ["user_id", "event_type"], "event_id", 2).select("event_id", "user_id")


@query("SELECT event_id, least(i // greatest(n // 4, 1), 3)::INT AS bucket FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)")
def w08_equal_population(spark, sf):
    return t(spark, sf, "events").select("event_id", windows.equal_population_bucket(["event_type"], ["value", "event_id"], 4).alias("bucket"))


@query("SELECT event_id, floor((value - a) / ((b - a) / 5))::INT AS bucket FROM (SELECT *, min(value) OVER (PARTITION BY event_type) AS a, max(value) OVER (PARTITION BY event_type) AS b FROM events)")
def w09_equal_width(spark, sf):
    return t(spark, sf, "events").select("event_id", windows.equal_width_bucket("value", ["event_type"], 5).alias("bucket"))


@query("SELECT event_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS island FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS f FROM events)")
def w10_islands(spark, sf):
    return windows.islands(t(spark, sf, "events"), ["event_type"], ["user_id"], ["ts", "event_id"]).select("event_id", "island")


# -- sorting and sampling -------------------------------------------------------------


@query("SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_size DESC, p_brand, p_partkey LIMIT 100")
def m10_sort_head(spark, sf):
    return sample.sort_by(t(spark, sf, "part"), ["-p_size", "p_brand"], "p_partkey").limit(100).select("p_partkey", "p_brand", "p_size")


@query("SELECT p_partkey, regexp_extract(p_brand, '(-?[0-9]+)', 1)::DOUBLE AS number FROM part")
def f18_leading_number(spark, sf):
    return t(spark, sf, "part").select("p_partkey", sample.leading_number(F.col("p_brand")).alias("number"))


@query("SELECT o_orderkey FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 50")
def t23_random(spark, sf):
    return sample.random_records(t(spark, sf, "orders"), 50, "o_orderkey", seed=7).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE substr(md5('3:' || o_orderkey), 1, 8) < '1999999a'")
def t23_bernoulli(spark, sf):
    return sample.bernoulli(t(spark, sf, "orders"), 0.10000000009, "o_orderkey", seed=3).select("o_orderkey")


@query("SELECT event_id, event_type FROM events WHERE event_id IN (3, 4, 5, 70, 71, 72)")
def t23_by_number(spark, sf):
    return sample.records_by_number(t(spark, sf, "events"), "event_id", [3, 70], following=2).select("event_id", "event_type")


@query("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('1:' || doc_id), doc_id) <= greatest(floor(floor(0.6 * (SELECT count(*) FROM documents)) / (SELECT count(DISTINCT lang) FROM documents)), 1) THEN 'train' ELSE 'test' END AS split FROM documents")
def t24_stratified(spark, sf):
    return sample.stratified_split(t(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.6, seed=1).select("doc_id", "split")


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 100 AS file FROM orders")
def t_split_file(spark, sf):
    return sample.split_file(t(spark, sf, "orders"), "o_orderkey", 100, ["o_orderpriority"]).select("o_orderkey", "file")


@query(f"""WITH {_ITEM}, {_PAIRS}, u AS (SELECT a, b, (('0x' || substr(md5('5:' || a || ':' || b), 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE AS u FROM d) SELECT a AS needle, b AS hay FROM u QUALIFY row_number() OVER (PARTITION BY a ORDER BY u DESC, b) <= 3""")
def f19_random_neighbours(spark, sf):
    pairs = similarity.pair_distances(item_fp(spark, sf), item_fp(spark, sf), same=True)
    return sample.random_neighbours(pairs, "needle", "hay", "d", 3, seed=5).select("needle", "hay")


# -- set operations -----------------------------------------------------------------


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) AS r FROM documents) WHERE r <= 1")
def t27_unique(spark, sf):
    return distinct.unique_rows(t(spark, sf, "documents"), ["text"], "doc_id", ignore_case=True).passed.select("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) AS r FROM documents) WHERE r > 1")
def t27_duplicates(spark, sf):
    return distinct.unique_rows(t(spark, sf, "documents"), ["text"], "doc_id", ignore_case=True).rejected.select("doc_id")


@query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY regexp_extract(o_orderpriority, '([0-9])', 1), o_orderstatus ORDER BY o_orderkey) <= 2")
def t27_unique_subset(spark, sf):
    return distinct.unique_rows(t(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey", keep=2, subset="([0-9A-Z])").passed.select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def t28_except(spark, sf):
    return distinct.except_keys(t(spark, sf, "customer"), t(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def t28_intersect(spark, sf):
    return distinct.intersect_keys(t(spark, sf, "customer"), t(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey")


@query("SELECT c_name AS name, c_mktsegment AS segment, NULL::BIGINT AS size FROM customer UNION ALL SELECT p_name, NULL, p_size::BIGINT FROM part")
def t26_union(spark, sf):
    a = t(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = t(spark, sf, "part").select(F.col("p_size").cast("long").alias("size"), F.col("p_name").alias("name"))
    return distinct.union_by_name([a, b])


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM customer p WHERE p.c_custkey = (c.c_custkey * 3) % 1000 AND p.c_custkey < c.c_custkey)")
def m12_variants(spark, sf):
    """Items whose transformed key was met earlier go."""
    c = t(spark, sf, "customer").select("c_custkey", F.col("c_custkey").alias("ord"))
    return distinct.drop_variants(c, c.select("c_custkey", ((F.col("c_custkey") * 3) % 1000).alias("product")), "c_custkey", "ord").select("c_custkey")


# -- scaling and encoding -------------------------------------------------------------


def _scaled(name, sql):
    @query(f"WITH s AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd FROM lineitem) SELECT l_orderkey, l_linenumber, round({sql}, 9) AS l_extendedprice FROM lineitem, s")
    def run(spark, sf):
        df = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
        return rounded(scale.normalise(df, scale.column_ranges(df, ["l_extendedprice"]), name), 9, "l_extendedprice")

    QUERIES[f"t29_normalise_{name}"] = QUERIES.pop("run")
    ORACLES[f"t29_normalise_{name}"] = ORACLES.pop("run")


_scaled("01", "(l_extendedprice - a) / (b - a)")
_scaled("11", "(l_extendedprice - a) / (b - a) * 2 - 1")
_scaled("uv", "(l_extendedprice - m) / sd")
_scaled("byte", "floor((l_extendedprice - a) / (b - a) * 255 + 0.5)::DOUBLE")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem")
def t29_unscale(spark, sf):
    """Scaling to [0, 10] and back."""
    df = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    r = scale.column_ranges(df, ["l_extendedprice"])
    return rounded(scale.unscale(scale.normalise(df, r, "01", 10.0, 1.0), r, "01", 10.0, 1.0), 6, "l_extendedprice")


@query("WITH c AS (SELECT c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1) SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS number, n FROM c")
def t31_labels(spark, sf):
    return scale.class_labels(t(spark, sf, "customer"), "c_mktsegment")


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS qe, round(corr(l_quantity, l_discount), 6) AS qd FROM lineitem")
def t32_correlation(spark, sf):
    return rounded(t(spark, sf, "lineitem").agg(F.corr("l_quantity", "l_extendedprice").alias("qe"), F.corr("l_quantity", "l_discount").alias("qd")), 6, "qe", "qd")


@query("""WITH r AS (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part)
SELECT p_partkey AS id, unnest([0, 1])::BIGINT AS bit, unnest([1 + least(floor((p_size - a) / ((b - a) / 10.0)), 9), 1 + least(floor((p_retailprice - c) / ((d - c) / 10.0)), 9)])::INT AS cnt FROM part, r""")
def t33_bins(spark, sf):
    df = t(spark, sf, "part")
    return scale.bin_descriptors(df, "p_partkey", ["p_size", "p_retailprice"], scale.column_ranges(df, ["p_size", "p_retailprice"]), 10)


@query("SELECT p_partkey AS id, unnest(list_filter([CASE WHEN p_size > 25 THEN 0 END, CASE WHEN p_retailprice > 25 THEN 1 END], lambda x: x IS NOT NULL))::BIGINT AS bit, 1 AS cnt FROM part")
def f20_thresholds(spark, sf):
    return scale.threshold_bits(t(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"], above=25)


@query(f"WITH {_DOC} SELECT * FROM fp")
def f21_tokens(spark, sf):
    """Every distinct token of a document is a bit, its count the times it occurs."""
    return doc_tokens(spark, sf)


@query("""WITH k AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark) SELECT id, len(list_filter(w, lambda x: x = 'the'))::INT AS b2411998317, len(list_filter(w, lambda x: x = 'on'))::INT AS b3979041793 FROM k""")
def f22_pivot(spark, sf):
    """Two named bits as columns: the words "the" and "on"."""
    bits = [int(hashlib.md5(w).hexdigest()[:8], 16) for w in (b"the", b"on")]
    return scale.to_descriptors(item_fp(spark, sf), bits)


@query(f"WITH {_DOC} SELECT id, bit % 1024 AS bit, sum(cnt)::INT AS cnt FROM fp GROUP BY ALL")
def f23_fold(spark, sf):
    return scale.fold_bits(doc_tokens(spark, sf), 1024)


@query(f"WITH {_DOC} SELECT id, coalesce(label, '.') || ' ' || f AS line FROM (SELECT id, string_agg(bit || ':' || cnt, ' ' ORDER BY bit) AS f FROM fp GROUP BY id) JOIN (SELECT doc_id, quality::VARCHAR AS label FROM labels) ON id = doc_id")
def f24_svm_lite(spark, sf):
    return scale.svm_lite(doc_tokens(spark, sf), t(spark, sf, "labels"), "doc_id", "quality")


@query(f"WITH {_DOC}, s AS (SELECT bit FROM fp GROUP BY bit HAVING count(*) BETWEEN 5 AND 50) SELECT fp.* FROM fp JOIN s USING (bit)")
def f25_bit_subset(spark, sf):
    fp = doc_fp(spark, sf)
    return scale.subset_bits(fp, scale.supported_bits(fp, 5, 50)).select("id", "bit", "cnt")


@query(f"WITH {_ITEM}, {_PAIRS} SELECT a AS id1, b AS id2, CASE WHEN d <= 0.5 THEN 0.0 WHEN d <= 0.9 THEN 0.5 ELSE 1.0 END::DOUBLE AS d FROM d")
def f26_distance_scaling(spark, sf):
    pairs = similarity.pair_distances(item_fp(spark, sf), item_fp(spark, sf), same=True)
    return pairs.select(F.col("needle").alias("id1"), F.col("hay").alias("id2"), metrics.scaled(F.col("d"), [(0.5, 0.0), (0.9, 0.5), (1.0, 1.0)]).alias("d"))


@query("SELECT v.vec_id AS id, p.p_retailprice::FLOAT::DOUBLE AS a, p.p_size::DOUBLE AS b FROM embeddings v JOIN part p ON v.vec_id = p.p_partkey")
def f01_add_descriptors(spark, sf):
    fp = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    out = scale.add_descriptors(fp, t(spark, sf, "part"), "p_partkey", ["p_retailprice", "p_size"])
    return out.select("id", F.element_at("desc", 1).cast("double").alias("a"), F.element_at("desc", 2).cast("double").alias("b"))


# -- clustering and models -------------------------------------------------------------


def _doc_edges(spark, sf):
    return staged(bags.pairs_within(doc_bags(spark, sf), 0.3), "edges")


def _doc_items(spark, sf):
    return t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"))


_NEAR = f"""WITH RECURSIVE {_DOC}, {_PAIRS}, e AS MATERIALIZED (SELECT a, b, d FROM d WHERE d <= 0.3 + 1e-12 UNION ALL SELECT b, a, d FROM d WHERE d <= 0.3 + 1e-12),
nb AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a) AS o, a AS id, list(b) AS nb FROM e GROUP BY a)"""


# Items in order: one without a leader among its neighbours leads; the first leader takes the others.
@query(f"""{_NEAR}, r AS (SELECT 0::BIGINT AS o, []::BIGINT[] AS ls UNION ALL SELECT nb.o, CASE WHEN list_has_any(r.ls, nb.nb) THEN r.ls ELSE list_append(r.ls, nb.id) END FROM r JOIN nb ON nb.o = r.o + 1),
l AS (SELECT unnest(ls) AS leader FROM r WHERE o = (SELECT max(o) FROM nb)), taken AS (SELECT a AS id, min(b) AS leader, arg_min(d, b) AS d FROM e JOIN l ON b = leader WHERE a NOT IN (SELECT leader FROM l) GROUP BY a)
SELECT doc_id AS id, coalesce(leader, doc_id) AS leader, round(coalesce(d, 0.0), 9) AS d FROM documents LEFT JOIN taken ON doc_id = id""")
def f27_leader(spark, sf):
    """Sphere exclusion of documents within 0.3 in order of doc_id."""
    return rounded(cluster.leader(_doc_items(spark, sf), _doc_edges(spark, sf)), 9, "d")


@query(f"""WITH RECURSIVE {_DOC}, {_PAIRS}, e AS MATERIALIZED (SELECT a, b FROM d WHERE d <= 0.3 + 1e-12 UNION ALL SELECT b, a FROM d WHERE d <= 0.3 + 1e-12),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a) SELECT id, min(c) AS cluster FROM r GROUP BY id""")
def f33_single_linkage(spark, sf):
    return cluster.single_linkage(_doc_items(spark, sf), _doc_edges(spark, sf))


# Again and again the item with most neighbours left, ties by number, and those neighbours.
@query(f"""{_NEAR}, r AS (SELECT (SELECT list(id) FROM nb) AS rem, NULL::BIGINT AS pick, []::BIGINT[] AS members UNION ALL
SELECT list_filter(rem, lambda x: x <> best.id AND NOT list_contains(best.nb, x)), best.id, list_intersect(best.nb, rem) FROM
(SELECT r.rem, min({{'c': -len(list_intersect(nb.nb, r.rem)), 'id': nb.id, 'nb': nb.nb}}) AS best FROM r JOIN nb ON list_contains(r.rem, nb.id) GROUP BY r.rem)),
c AS (SELECT pick AS leader, unnest(members) AS id FROM r WHERE pick IS NOT NULL), t AS (SELECT c.id, c.leader, e.d FROM c JOIN e ON e.a = c.id AND e.b = c.leader)
SELECT doc_id AS id, coalesce(leader, doc_id) AS leader, round(coalesce(d, 0.0), 9) AS d FROM documents LEFT JOIN t ON doc_id = id""")
def f34_taylor_butina(spark, sf):
    return rounded(cluster.taylor_butina(_doc_items(spark, sf), _doc_edges(spark, sf)), 9, "d")


@query(f"""WITH RECURSIVE {_ITEM}, {_PAIRS}, b2 AS (SELECT a AS id, b AS o, d FROM d UNION ALL SELECT b, a, d FROM d), h AS (SELECT id, o FROM b2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, o) <= 6),
s AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM h x JOIN h y ON x.o = y.o AND x.id <> y.id GROUP BY ALL HAVING count(*) >= 4), r AS (SELECT item_id AS id, item_id AS c FROM benchmark UNION SELECT s.b, r.c FROM r JOIN s ON r.id = s.a) SELECT id, min(c) AS cluster FROM r GROUP BY id""")
def f35_jarvis_patrick(spark, sf):
    one = similarity.pair_distances(item_fp(spark, sf), item_fp(spark, sf), same=True)
    both = one.union(one.select(F.col("hay").alias("needle"), F.col("needle").alias("hay"), "d"))
    near = similarity.nearest(both, 6)
    return cluster.jarvis_patrick(t(spark, sf, "benchmark").select(F.col("item_id").alias("id")), near, 6, 4)


@query("""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings), u AS MATERIALIZED (SELECT id, list_transform(q, lambda x: x / sqrt(list_inner_product(q, q))) AS p FROM v),
r AS (SELECT 0 AS pick, id, NULL::BIGINT AS nearest, NULL::DOUBLE AS d, [id] AS ids, [p] AS ps FROM u WHERE id = (SELECT min(vec_id) FROM embeddings) UNION ALL
SELECT pick + 1, best.id, ids[list_position(best.ds, -best.f)], -best.f, list_append(ids, best.id), list_append(ps, best.p) FROM
(SELECT r.pick, r.ids, r.ps, min({'f': -list_min(list_transform(r.ps, lambda x: 1 - list_inner_product(x, u.p))), 'id': u.id, 'p': u.p, 'ds': list_transform(r.ps, lambda x: 1 - list_inner_product(x, u.p))}) AS best
FROM r JOIN u ON NOT list_contains(r.ids, u.id) WHERE r.pick < 11 GROUP BY ALL)) SELECT pick, id, nearest, round(d, 9) AS d FROM r""")
def f29_spread(spark, sf):
    """Twelve vectors far from one another, by cosine."""
    def apart(p):
        dot = F.aggregate(F.zip_with(F.col("p"), p, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return 1 - dot

    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    items = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), norm.alias("n"), "embedding")
    items = items.select("id", "ord", F.transform("embedding", lambda x: x.cast("double") / F.col("n")).alias("p"))
    return rounded(cluster.spread(items, apart, "p", 12), 9, "d")


_BAYES = f"""WITH {_DOC}, y AS (SELECT doc_id AS id, quality AS label FROM labels), r AS (SELECT fp.id, bit, label FROM fp JOIN y USING (id)), p AS (SELECT label, count(*) / (SELECT count(*) FROM y)::DOUBLE AS p FROM y GROUP BY label),
nb AS (SELECT bit, count(*) AS nb FROM r GROUP BY bit), nc AS (SELECT bit, label, count(*) AS n FROM r GROUP BY ALL),
m AS (SELECT nb.bit, p.label, ln((coalesce(n, 0) + 1.0) / (nb * p + 1.0)) AS w FROM nb CROSS JOIN p LEFT JOIN nc ON nc.bit = nb.bit AND nc.label = p.label)"""


@query(f"{_BAYES} SELECT bit, label, round(w, 9) AS w FROM m")
def f38_bayes_model(spark, sf):
    return rounded(models.train_bayes(doc_fp(spark, sf), t(spark, sf, "labels"), "doc_id", "quality"), 9, "w")


@query(f"{_BAYES}, s AS (SELECT id, label, sum(w) AS score FROM fp JOIN m USING (bit) GROUP BY ALL) SELECT id, label, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, label) = 1")
def f38_bayes_classify(spark, sf):
    fp = doc_fp(spark, sf)
    model = staged(models.train_bayes(fp, t(spark, sf, "labels"), "doc_id", "quality"), "bayes")
    return rounded(models.classify(models.bayes_scores(fp, model)), 6, "score")


@query(f"""WITH {_ITEM}, y AS (SELECT item_id AS id, length(text) % 2 AS label, (('0x' || substr(md5('0:' || item_id), 1, 8))::BIGINT % 3)::INT AS fold FROM benchmark), tr AS (SELECT k, id, label FROM y JOIN (SELECT unnest([0, 1, 2]) AS k) ON fold <> k),
p AS (SELECT k, label, count(*) / (sum(count(*)) OVER (PARTITION BY k))::DOUBLE AS p FROM tr GROUP BY k, label), t AS (SELECT k, id, bit, label FROM fp JOIN tr USING (id)), nb AS (SELECT k, bit, count(*) AS nb FROM t GROUP BY ALL), nc AS (SELECT k, bit, label, count(*) AS n FROM t GROUP BY ALL),
m AS (SELECT nb.k, nb.bit, p.label, ln((coalesce(n, 0) + 1.0) / (nb * p + 1.0)) AS w FROM nb JOIN p ON p.k = nb.k LEFT JOIN nc ON nc.k = nb.k AND nc.bit = nb.bit AND nc.label = p.label),
s AS (SELECT id, fold, m.label, sum(w) AS score FROM fp JOIN y USING (id) JOIN m ON m.k = y.fold AND m.bit = fp.bit GROUP BY ALL) SELECT id, fold, label, round(score, 9) AS score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, label) = 1""")
def f38_bayes_folds(spark, sf):
    return rounded(models.cross_validate(item_fp(spark, sf), t(spark, sf, "benchmark").select("item_id", (F.length("text") % 2).alias("c")), "item_id", "c", 3), 9, "score")


@query(f"{_NEEDLES} SELECT needle AS id, round(sum((hay % 5 - 2) * (1 - d)) - 0.5, 9) AS score FROM d GROUP BY needle")
def f40_kernel(spark, sf):
    """A kernel model whose support vectors are all documents."""
    sv = doc_fp(spark, sf)
    w = sv.select(F.col("id").alias("hay"), (F.col("id") % 5 - 2).alias("w")).distinct()
    return rounded(models.kernel_scores(similarity.pair_distances(item_fp(spark, sf), sv), w, 0.5), 9, "score")


@query(f"WITH {_ITEM} SELECT id, sum(cnt * (bit % 7 - 3))::BIGINT AS score FROM fp GROUP BY id")
def s04_weighted_bits(spark, sf):
    fp = item_fp(spark, sf)
    return models.weighted_bits(fp, fp.select("bit", (F.col("bit") % 7 - 3).alias("w")).distinct())


@query(f"{_NEEDLES} SELECT DISTINCT needle AS id FROM d WHERE d <= 0.75 + 1e-12")
def f09_near_any(spark, sf):
    return similarity.near_any(item_fp(spark, sf), doc_fp(spark, sf), 0.75)


@query(f"{_NEEDLES}, b AS (SELECT hay, needle, d FROM d QUALIFY row_number() OVER (PARTITION BY hay ORDER BY d, needle) = 1) SELECT i.id, b.needle, round(b.d, 9) AS d FROM (SELECT DISTINCT id FROM h) i LEFT JOIN b ON i.id = b.hay")
def f09_nearest_needle(spark, sf):
    return rounded(similarity.nearest_needle(item_fp(spark, sf), doc_fp(spark, sf)), 9, "d")


@query()
def f36_leader_thresholds(spark, sf):
    return rounded(cluster.leader_thresholds(_doc_items(spark, sf), _doc_edges(spark, sf), [0.1, 0.3]), 9, "d")


@query()
def f32_spread_buckets(spark, sf):
    """Ten vectors far apart, of few labels at a time."""
    items = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("p"))
    apart = lambda p: F.sqrt(F.aggregate(F.zip_with(F.col("p"), p, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return rounded(cluster.spread_buckets(items, apart, "p", "label", 10), 9, "d")


# -- scalar functions -----------------------------------------------------------------


@query(r"""SELECT p_partkey, len(regexp_extract_all(p_name, '\S+'))::INT AS nwords, string_split(p_name, ' ')[2] AS second, string_split(p_name, ' ')[-1] AS last, length(p_name) - length(replace(p_name, 'e', '')) AS es,
CASE WHEN contains(p_brand, '#') THEN string_split(p_brand, '#')[1] ELSE '' END AS brand, string_split(p_brand, '#')[2] AS number, substr(p_type, 2, 3) AS mid, left(p_name, greatest(length(p_name) - 2, 0)) AS chopped, replace(p_name, 'ed', '*') AS starred, translate(p_name, 'aeiou', '') AS consonants,
lower(p_type) = 'economy' AS eco, p_size::DOUBLE AS num, length(p_partkey::VARCHAR) AS digits FROM part""")
def x_strings(spark, sf):
    c = F.col
    return t(spark, sf, "part").select(
        "p_partkey", strings.nwords(c("p_name")).alias("nwords"), strings.word(c("p_name"), 1).alias("second"), strings.word(c("p_name"), -1).alias("last"), strings.ccount(c("p_name"), "e").cast("long").alias("es"),
        strings.before(c("p_brand"), "#").alias("brand"), strings.after(c("p_brand"), "#").alias("number"), strings.from_to(c("p_type"), 1, 3).alias("mid"), strings.chop(c("p_name"), 2).alias("chopped"), strings.gsub(c("p_name"), "ed", "*").alias("starred"), strings.remove_chars(c("p_name"), "aeiou").alias("consonants"),
        strings.matches_ignore_case(c("p_type"), "economy").alias("eco"), strings.numeric_value(c("p_size").cast("string")).alias("num"), strings.ndigits(c("p_partkey")).cast("long").alias("digits"),
    )


# -- streams ----------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st_tumbling(spark, sf):
    """A stream of events counted by hour: run to the end of its input, the finished table read back."""
    static = t(spark, sf, "events")
    stream = spark.readStream.schema(static.schema).parquet(f"{sf}/events.parquet*")
    out = filter_mode.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", None, ["event_type"], "value", "1 hour")
    name = f"st_{uuid.uuid4().hex}"
    base = f"{shared_dir(spark)}/{name}"

    def keep(df, number):
        df.write.mode("overwrite").parquet(f"{base}/out")

    out.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.parquet(f"{base}/out"), 4, "total").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


# -- sources and sinks: written in a format and read back -----------------------------


def _folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _lines(spark, sf) -> str:
    path = _folder(spark, "lines")
    t(spark, sf, "part").select(F.concat_ws(" ", "p_partkey", "p_brand", "p_type").alias("value")).write.option("compression", "gzip").text(path)
    return path


@query("SELECT p_partkey || ' ' || p_brand || ' ' || p_type AS value FROM part WHERE p_type LIKE '%ECONOMY%' AND NOT p_brand LIKE '%3%'")
def s_text(spark, sf):
    """Lines of gzip files, filtered while they are read."""
    return records.text_records(spark, _lines(spark, sf), keep="ECONOMY", ignore=r"#\S*3").select("value")


@query("SELECT count(*) AS n FROM part WHERE p_partkey % 10 = 7")
def s_count(spark, sf):
    return spark.createDataFrame([(records.count_matching(spark, _lines(spark, sf), "^[0-9]*7 "),)], "n long")


@query("SELECT 'c' || c_custkey AS id, round(c_acctbal, 2) AS bal, CASE WHEN c_nationkey < 12 THEN c_nationkey::DOUBLE END AS nation FROM customer")
def s_descriptors(spark, sf):
    """A descriptor table with missing cells."""
    path = _folder(spark, "descriptors")
    df = t(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.round("c_acctbal", 2).alias("bal"), F.when(F.col("c_nationkey") < 12, F.col("c_nationkey")).alias("nation"))
    records.write_descriptors(df, path)
    return records.read_descriptors(spark, path)


@query("SELECT 'o' || o_orderkey AS id, o_orderpriority AS priority, 3::BIGINT AS items FROM orders WHERE o_custkey > 20")
def s_items(spark, sf):
    """Tagged items, filtered by one, without another and with a new one."""
    path = _folder(spark, "items")
    pair = lambda tag, c: F.struct(F.lit(tag).alias("tag"), c.cast("string").alias("value"))
    rows = t(spark, sf, "orders").select(F.array(pair("PCN", F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))), pair("CUST", F.col("o_custkey")), pair("PRIO", F.col("o_orderpriority"))).alias("items"))
    records.write_items(rows, path)
    back = records.read_items(spark, path).where(records.item_filter("CUST", ">", 20)).withColumn("items", records.add_item("NEW", F.lit(1)))
    back = back.withColumn("items", records.remove_items(["CUST"]))
    return back.select(records.item("PCN").alias("id"), records.item("PRIO").alias("priority"), F.size("items").cast("long").alias("items"))


# -- molecules --------------------------------------------------------------------
#
# A molecule is made of each row of ``part``: a core with a substituent at either end, drawn by the key.  What adds up over
# the three can be said in SQL; canonical smiles are compared by the rows that share them.

_LEFT = ("C", "CC", "O", "N", "Cl", "COC")
_CORE = ("c1ccc(cc1)", "c1ccc(nc1)", "N1CCN(CC1)", "C1CCC(CC1)", "CC", "c1ccc2cc(ccc2c1)", "C(=O)N", "S(=O)(=O)N")
_RIGHT = ("C", "O", "F", "C(=O)O", "C#N", "OC")

#: Atoms of the pieces: kind, place, C, H, Cl, F, N, O, S, hydrogens on N or O.
_MOL = """WITH piece(kind, i, c, h, cl, f, n, o, s, d) AS (VALUES
('a', 0, 1, 3, 0, 0, 0, 0, 0, 0), ('a', 1, 2, 5, 0, 0, 0, 0, 0, 0), ('a', 2, 0, 1, 0, 0, 0, 1, 0, 1), ('a', 3, 0, 2, 0, 0, 1, 0, 0, 2), ('a', 4, 0, 0, 1, 0, 0, 0, 0, 0), ('a', 5, 2, 5, 0, 0, 0, 1, 0, 0),
('k', 0, 6, 4, 0, 0, 0, 0, 0, 0), ('k', 1, 5, 3, 0, 0, 1, 0, 0, 0), ('k', 2, 4, 8, 0, 0, 2, 0, 0, 0), ('k', 3, 6, 10, 0, 0, 0, 0, 0, 0), ('k', 4, 2, 4, 0, 0, 0, 0, 0, 0), ('k', 5, 10, 6, 0, 0, 0, 0, 0, 0), ('k', 6, 1, 1, 0, 0, 1, 1, 0, 1), ('k', 7, 0, 1, 0, 0, 1, 2, 1, 1),
('b', 0, 1, 3, 0, 0, 0, 0, 0, 0), ('b', 1, 0, 1, 0, 0, 0, 1, 0, 1), ('b', 2, 0, 0, 0, 1, 0, 0, 0, 0), ('b', 3, 1, 1, 0, 0, 0, 2, 0, 1), ('b', 4, 1, 0, 0, 0, 1, 0, 0, 0), ('b', 5, 1, 3, 0, 0, 0, 1, 0, 0)),
mol AS (SELECT p_partkey AS ord, 'p' || p_partkey AS id, (p_partkey // 8 % 6)::INT AS a, (p_partkey % 8)::INT AS k, (p_partkey // 48 % 6)::INT AS b FROM part),
atoms AS (SELECT ord, id, sum(c)::INT AS c, sum(h)::INT AS h, sum(cl)::INT AS cl, sum(f)::INT AS f, sum(n)::INT AS n, sum(o)::INT AS o, sum(s)::INT AS s, sum(d)::INT AS d
FROM mol JOIN piece ON (kind = 'a' AND i = a) OR (kind = 'k' AND i = k) OR (kind = 'b' AND i = b) GROUP BY ALL),
-- Cores that look alike from both ends, and two ways to write butyl methyl ether.
same AS (SELECT ord, id, a, k, b, CASE WHEN k IN (0, 2, 3, 4, 5) AND a = 2 AND b = 0 THEN k || ':0:1' WHEN k = 4 AND a = 5 AND b = 0 THEN '4:1:5' ELSE k || ':' || a || ':' || b END AS key FROM mol)"""
_HILL = "concat_ws('', " + ", ".join(f"CASE WHEN {c} = 1 THEN '{e}' WHEN {c} > 1 THEN '{e}' || {c} END" for c, e in (("c", "C"), ("CASE WHEN c > 0 THEN h ELSE 0 END", "H"), ("cl", "Cl"), ("f", "F"), ("CASE WHEN c = 0 THEN h ELSE 0 END", "H"), ("n", "N"), ("o", "O"), ("s", "S"))) + ")"
_AMW = "c * 12.011::DOUBLE + h * 1.008 + cl * 35.45 + f * 18.998 + n * 14.007 + o * 15.999 + s * 32.06"

#: For operators that multiply their input: a few molecules with rings, charges, salts and groups that react.
MOLECULES = """CC(=O)Oc1ccccc1C(=O)O m1
OC(=O)c1ccccc1OC(C)=O m2
Cn1cnc2c1c(=O)n(C)c(=O)n2C m3
[Na+].[O-]C(=O)c1ccccc1 m4
NCCc1ccccc1 m5
NCC(C)C m6
Brc1ccc(OC)cc1 m7
CC(=O)Nc1ccc(O)cc1 m8
OC(=O)C1CCNCC1 m9
FC(F)(F)c1ccc(Cl)cc1 m10
CC(C)Cc1ccc(cc1)C(C)C(=O)O m11
C1CCC2CCCCC2C1 m12
C1CC m13
COc1ccc2nc(sc2c1)N1CCOCC1 m14"""


def few_molecules(spark: SparkSession) -> DataFrame:
    rows = [(i, *line.split()) for i, line in enumerate(MOLECULES.split("\n"))]
    return spark.createDataFrame(rows, "ord long, smiles string, id string")


def molecules(spark: SparkSession, sf: str) -> DataFrame:
    """Rows ``(ord, smiles, id)``, one of each row of ``part``."""
    key = F.col("p_partkey")
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), (at % len(names) + 1).cast("int"))
    smiles = F.concat(pick(_LEFT, F.floor(key / 8)), pick(_CORE, key), pick(_RIGHT, F.floor(key / 48)))
    return spread(t(spark, sf, "part").select(key.alias("ord"), smiles.alias("smiles"), F.concat(F.lit("p"), key.cast("string")).alias("id")))


def _chem(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None, few: bool = False) -> None:
    def run(spark, sf):
        return f(few_molecules(spark) if few else molecules(spark, sf))

    QUERIES[name] = shipped(run)
    if sql is not None:
        ORACLES[name] = sql


def _first_of_same(m: DataFrame) -> DataFrame:
    """Formula and masses, and the first row with the same canonical smiles."""
    c = F.col("smiles")
    rows = m.select("ord", "id", frames.canonical(c).alias("key"), frames.formula(c).alias("formula"), F.round(frames.weight(c), 3).alias("amw"))
    first = rows.groupBy("key").agg(F.min("ord").alias("first"))
    return rows.join(first, "key").select("id", "formula", "amw", "first")


_chem("c_canonical", _first_of_same, f"{_MOL}, f AS (SELECT key, min(ord) AS first FROM same GROUP BY key) SELECT atoms.id, {_HILL} AS formula, round({_AMW}, 3) AS amw, f.first FROM atoms JOIN same USING (ord) JOIN f USING (key)")
_chem("c_rejects", lambda m: frames.rejects(m).select("id"), few=True)
ORACLES["c_rejects"] = "SELECT 'm13' AS id"
_chem("c_descriptors", frames.describe)
_chem("c_rule_of_five", lambda m: frames.rule_of_five(m).select("id", F.col("ro5_nhoh").cast("int").alias("ro5_nhoh"), F.col("ro5_no").cast("int").alias("ro5_no"), F.col("natoms").cast("int").alias("natoms")), f"{_MOL} SELECT id, d AS ro5_nhoh, n + o AS ro5_no, c + cl + f + n + o + s AS natoms FROM atoms")
_chem("c_topology", frames.topology)
_chem("c_ring_table", enumeration.ring_table, few=True)
_chem("c_core_table", enumeration.core_table, few=True)
_chem("c_ring_replacement", lambda m: enumeration.replace(m, enumeration.ring_table(m)), few=True)
_chem("c_core_replacement", lambda m: enumeration.replace(m, enumeration.core_table(m), "core"), few=True)
_chem("c_mutations", lambda m: enumeration.mutations(m, tries=10, seed=1), few=True)
_chem("c_separations", enumeration.separations)
_chem("c_listed_products", lambda m: enumeration.listed_products(m.select(F.lit("m1").alias("id1"), F.lit("m6").alias("id2")).distinct(), m, "[C:1](=[O:2])[OH].[NH2:3][C:4]>>[C:1](=[O:2])[NH:3][C:4]"), few=True)
_chem("c_substructure", lambda m: m.where(frames.substructure(F.col("smiles"), "c1ccccc1")).select("id"), f"{_MOL} SELECT id FROM mol WHERE k IN (0, 5)")
_chem("c_embeddings", lambda m: m.select("id", F.size(frames.embeddings(F.col("smiles"), "c1ccccc1")).alias("hits")), f"{_MOL} SELECT id, CASE k WHEN 0 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS hits FROM mol")
_chem("c_match_counts", lambda m: frames.match_counts(m, {"acid": "C(=O)[OH,O-]", "ether": "C-O-C", "ring": "a1aaaaa1", "nitrile": "C#N", "halogen": "[F,Cl]"}).drop("smiles", "ord"), f"""{_MOL} SELECT id, (b = 3)::INT + (a = 2 AND k = 6)::INT AS acid, (a = 5)::INT + (b = 5 AND k IN (3, 4))::INT AS ether,
CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS ring, (b = 4)::INT AS nitrile, (a = 4)::INT + (b = 2)::INT AS halogen FROM mol""")
for _kind in ("linear", "circular", "pairs", "torsions", "rings", "ring_substitution", "rotatable", "keys"):
    _chem(f"c_fp_{_kind}", lambda m, k=_kind: frames.fingerprint(m, k))
_chem("c_properties", lambda m: m.select("id", frames.properties(F.col("smiles")).alias("mpr")))
_chem("c_dicer", lambda m: frames.dicer(m, depth=2, low=3))
_chem("c_dicer_statistics", lambda m: frames.fragment_statistics(frames.dicer(m, depth=1)))
_chem("c_cores", frames.cores)

_RING_FORMULA = "CASE k WHEN 0 THEN 'C6H6' WHEN 1 THEN 'C5H5N' WHEN 2 THEN 'C4H10N2' WHEN 3 THEN 'C6H12' WHEN 5 THEN 'C10H8' END"


def _product_formula(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda m: f(m).select("id", frames.formula(F.col("product")).alias("formula"))


_chem("c_scaffolds", _product_formula(frames.scaffolds), f"{_MOL} SELECT id, {_RING_FORMULA} AS formula FROM mol WHERE k IN (0, 1, 2, 3, 5)")
_chem("c_murcko", _product_formula(frames.murcko), f"{_MOL} SELECT id, {_RING_FORMULA} AS formula FROM mol WHERE k IN (0, 1, 2, 3, 5)")
_chem("c_skeletons", frames.skeletons)
_chem("c_rings", _product_formula(frames.rings), f"{_MOL} SELECT id, {_RING_FORMULA} AS formula FROM mol WHERE k IN (0, 1, 2, 3, 5)")
_chem("c_ring_trimming", frames.trimmed, few=True)
_chem("c_substituents", lambda m: frames.substituents(m, "c1ccccc1"))
_chem("c_subset", lambda m: frames.matched_atoms(m, "C(=O)O"))
_chem("c_remove_and_label", lambda m: frames.without_matched(m, "C(=O)[OH]", label=1))
_chem("c_random_smiles", lambda m: frames.random_smiles(m, 3, seed=1).join(m.select("id", "smiles"), "id").select("id", (frames.canonical(F.col("product")) == frames.canonical(F.col("smiles"))).alias("same")), f"{_MOL} SELECT id, unnest([true, true, true]) AS same FROM mol")
_chem("c_standardise", lambda m: m.select("id", frames.formula(frames.standardise(F.col("smiles"))).alias("formula")), f"{_MOL} SELECT id, {_HILL} AS formula FROM atoms")
_chem("c_tautomers", frames.tautomers, few=True)
_chem("c_reaction", lambda m: frames.react(m, "[c:1]F>>[c:1]C#N").select("id", F.round(frames.weight(F.col("product")), 3).alias("amw")), f"{_MOL} SELECT id, round({_AMW.replace('c * 12', '(c + 1) * 12').replace('f * 18', '(f - 1) * 18').replace('n * 14', '(n + 1) * 14')}, 3) AS amw FROM atoms JOIN mol USING (ord, id) WHERE b = 2 AND k IN (0, 1, 5)")
_chem("c_library", lambda m: frames.enumerate_library(m.select("id", "smiles"), m.select("id", "smiles"), "[C:1](=[O:2])[OH].[NH2:3][C:4]>>[C:1](=[O:2])[NH:3][C:4]"), few=True)
_chem("c_demerits", lambda m: frames.demerits(m))
_chem("c_first_pass", lambda m: m.select("id", frames.first_pass(F.col("smiles"), low=5).alias("reason")))
_chem("c_first_pass_summary", lambda m: aggregate.reason_summary(m.withColumn("reason", F.coalesce(frames.first_pass(F.col("smiles"), low=5), F.lit("passed"))), F.col("reason"), "id"))
_chem("c_need_available", lambda m: m.where(frames.need_available(F.col("smiles"), [("c1ccccc1", "[O]", 1)])).select("id"))
_chem("c_unique", lambda m: frames.unique_molecules(m, "ord")[0].select("id"), f"{_MOL} SELECT arg_min(id, ord) AS id FROM same GROUP BY key")
_chem("c_duplicates", lambda m: frames.unique_molecules(m, "ord")[1].select("id"), f"{_MOL} SELECT id FROM same QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) > 1")
_chem("c_sort", lambda m: frames.sort_molecules(m, ["-nrings", "natoms"], "ord").select("id", F.col("nrings").cast("int").alias("nrings"), F.col("natoms").cast("int").alias("natoms")), f"{_MOL} SELECT id, CASE WHEN k IN (4, 6, 7) THEN 0 WHEN k = 5 THEN 2 ELSE 1 END AS nrings, c + cl + f + n + o + s AS natoms FROM atoms JOIN mol USING (ord, id)")
_chem("c_common_names", lambda m: aggregate.common_names(m.withColumn("key", frames.structure_key(F.col("smiles"))).where("key is not null"), "key", "id", "ord", sep="+").select("names", "n"), f"{_MOL} SELECT string_agg(id, '+' ORDER BY ord) AS names, count(*) AS n FROM same GROUP BY key")
_chem("c_activity", lambda m: aggregate.activity_consistency(m.withColumn("key", frames.structure_key(F.col("smiles"), graph=True)).where("key is not null").withColumn("act", F.col("ord") * 1.5), "key", "act", "id", "ord")[0])
_chem("c_nearest", lambda m: similarity.nearest(similarity.pair_distances(frames.fingerprint(m), frames.fingerprint(m), same=True), 3), few=True)


@query(f"{_MOL} SELECT id, c + cl + f + n + o + s AS natoms, 2 AS tokens FROM atoms")
def s_smiles(spark, sf):
    """Smiles files with a name of two words."""
    path = _folder(spark, "smiles")
    molecules(spark, sf).select(F.concat_ws(" ", "smiles", "id", F.lit("x")).alias("value")).write.text(path)
    rows = frames.rule_of_five(records.read_smiles(spark, path))
    return rows.select("id", F.col("natoms").cast("int").alias("natoms"), F.size("name_tokens").alias("tokens"))


@query(f"{_MOL}, store AS (SELECT key, string_agg(id, ':' ORDER BY id) AS ids FROM same WHERE k < 4 GROUP BY key) SELECT same.id, store.ids FROM same LEFT JOIN store USING (key)")
def s_store(spark, sf):
    """Molecules looked up by structure in a stored table of those with a ring of six."""
    keyed = molecules(spark, sf).withColumn("key", frames.structure_key(F.col("smiles")))
    path = _folder(spark, "store")
    records.build_store(keyed.where("ord % 8 < 4").select("key", F.col("id").alias("ids")), "key", "ids", path)
    found, absent = records.look_up(keyed.select("id", "key"), spark.read.parquet(path), "key")
    return found.select("id", "ids").union(absent.select("id", F.lit(None).cast("string")))


@query("SELECT event_id, user_id FROM events WHERE value > 50 AND user_id < 40")
def st_filter(spark, sf):
    """A stream of events through a descriptor filter."""
    return _streamed(spark, sf, lambda s: filter_mode.filter_stream(s, "value>50&&user_id<40")).select("event_id", "user_id")


@query("SELECT DISTINCT user_id, event_type FROM events")
def st_distinct(spark, sf):
    """The first event of each user and type that arrives."""
    return _streamed(spark, sf, lambda s: filter_mode.distinct_stream(s, ["user_id", "event_type"], "ts", "3650 days")).select("user_id", "event_type")


def _streamed(spark, sf, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream of the events table writes until its input ends."""
    schema = t(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    out = f(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    path = _folder(spark, "stream")
    filter_mode.run_to_table(out, path, _folder(spark, "progress")).awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


@query()
def c_reaction_signature(spark, sf):
    df = spark.createDataFrame([(1, "[CH3:1][Br:2].[OH2:3]>>[CH3:1][OH:3].[BrH:2]")], "id int, reaction string")
    return frames.reaction_signatures(df)
