"""The registered queries of the corpus operators: each operator over its whole table, with the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ferrule.plans.shipping import shipped

from . import embeddings, exact, hilbert, html_crf, mixing, packing, pii, quality, simhash, substring
from .common import ASCII_LOWER, ASCII_UPPER, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = shipped(f)
    return f


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    pieces = packing.pack(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, most=3)


@query
def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract_main_text(table(spark, sf_dir, "pages"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op6_exact"] = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}') AS n FROM documents),
g AS (SELECT n, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.n) AS text_sha256 FROM t JOIN g ON t.n = g.n
"""


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), most=3, cycle=(1, 2, 3)).select("doc_id", "size", "source_size", "target", "taken")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query
def op5_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert.hilbert_shards(table(spark, sf_dir, "documents"), shards=16, dims=("source", "lang", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


@query
def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


@query
def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.cut_repeats(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op8_substring"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
v AS (SELECT p.r, p.i, md5_number(array_to_string(d.w[p.i:p.i + 34], ' ')) AS h FROM p JOIN d ON p.r = d.r),
t AS (SELECT h FROM v GROUP BY h HAVING count(*) > 1),
m AS (SELECT v.r, v.i FROM v JOIN t ON v.h = t.h),
g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM m),
x AS (SELECT r, list(i) AS gone FROM g GROUP BY r),
k AS (SELECT d.doc_id, len(d.w) AS n_words, coalesce(len(x.gone), 0) AS n_removed,
  CASE WHEN x.gone IS NULL THEN d.w ELSE list_filter(d.w, lambda q, j: NOT list_contains(x.gone, j)) END AS kept
  FROM d LEFT JOIN x ON d.r = x.r)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_personal_data(table(spark, sf_dir, "documents"))
    # A second parameter of the lambda would be the index in the array.
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k))
    counts = [of(k).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return out.select("doc_id", *counts, F.sha2(pii.spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))

#: Every pair is compared; the operator finds pairs at the threshold itself with a chance of 0.97 and closer ones more surely.
ORACLES["op7_embeddings"] = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
l AS MATERIALIZED (SELECT a, b FROM p WHERE isfinite(c) AND c >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a),
k AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, k.c AS component_id, v.vec_id = k.c AS kept FROM v JOIN k ON v.vec_id = k.id LEFT JOIN n ON n.a = v.vec_id
"""
