"""Queries of scans, filters, projections, search and graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from koengine.api import Session
from koengine.functions.text import tokens
from koengine.functions.vectors import cosine, search_block
from koengine.operators import graph, search
from koengine.runtime import table
from koengine.sources.registry import edges

QUERY = "import batch lease snapshot reader"
TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"


def _match(source: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Session(spark, sf_dir).query(source)

    return run


def _json(source: dict):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Session(spark, sf_dir).query_json(source)

    return run


_ORDERS = "CAST(o_orderkey AS VARCHAR) AS koid, 'orders' AS type_name, 1::BIGINT AS version"


def _strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict tags: a float literal never equals an integer property, and always differs from it."""
    return Session(spark, sf_dir, strict=True).query("MATCH orders WHERE o_orderkey == 35 OR o_orderstatus > 5 OR o_custkey != 7 RETURN o_orderkey")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("koid"), "doc_id", "text", "lang", "source")


def text_jaccard_topk(spark, sf_dir):
    return search.text_search(_docs(spark, sf_dir), F.col("text"), QUERY, 10).select("doc_id", "score")


def text_inverted_candidates(spark, sf_dir):
    """Every known entry against every typed name: all pairs that share a token."""
    q = table(spark, sf_dir, "kb_entry").select(F.col("koid").alias("query_id"), F.col("name").alias("text"))
    names = table(spark, sf_dir, "entity_candidate").select("name").where("name IS NOT NULL").distinct().select(F.col("name").alias("koid"), "name")
    return search.token_candidates(names, F.col("name"), q).select("query_id", F.col("koid").alias("name"), "shared")


def text_bm25_topk(spark, sf_dir):
    return search.bm25_search(_docs(spark, sf_dir), F.col("text"), QUERY, 10).select("doc_id", "score")


def text_indexed_topk(spark, sf_dir):
    """Through the inverted table."""
    d = _docs(spark, sf_dir)
    return search.indexed_search(search.token_index(d, F.col("text")), QUERY, 10).select("koid", "score")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def ann_topk(spark, sf_dir):
    """Exact search: every vector whose id is divisible by 50, against all, top 10."""
    v = _vectors(spark, sf_dir)
    return search_block(v.where("id % 50 = 0"), v, 10, None).select("query_id", "id", "cosine", F.col("rank").cast("int").alias("rank"))


def ann_model_filter(spark, sf_dir):
    """The same within the vectors of label 3, which stands for a model."""
    v = _vectors(spark, sf_dir).where("label = 3")
    return search_block(v.where("id % 50 = 0"), v, 5, None).select("query_id", "id", "cosine", F.col("rank").cast("int").alias("rank"))


def _hybrid(spark, sf_dir, k):
    """Vector list (of the documents that have a vector) for the vector of object 1, and text list of all documents."""
    d = _docs(spark, sf_dir)
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    one = F.broadcast(v.where("doc_id = 1").select(F.col("vec").alias("q")))  # one row by key
    near = v.join(d.select("doc_id", "koid"), "doc_id").crossJoin(one).withColumn("score", F.round(cosine(F.col("vec"), F.col("q")), 6))
    return search.top(near, k).select("koid", "score"), search.text_search(d, F.col("text"), QUERY, k).select("koid", "score")


def fuse_rrf_runtime(spark, sf_dir):
    a, b = _hybrid(spark, sf_dir, 10)
    return search.rrf(a, b, 10, rank_base=1).select("koid", "score")


def fuse_rrf_kernel(spark, sf_dir):
    a, b = _hybrid(spark, sf_dir, 100)
    return search.rrf(a, b, 10, rank_base=0).select("koid", "score")


def fuse_weighted(spark, sf_dir):
    a, b = _hybrid(spark, sf_dir, 100)
    return search.weighted(a, b, 10, 0.7, 0.3).select("koid", "score")


def find_similar_filtered(spark, sf_dir):
    d = _docs(spark, sf_dir).where("lang = 'en' AND source = 'wiki_export'")
    return search.text_search(d, F.col("text"), QUERY, 5, include_zero=False).select("doc_id", "score")


def infer_similar(spark, sf_dir):
    d = _docs(spark, sf_dir).where("source = 'api_docs'")
    return search.text_search(d, F.col("text"), "which rule protects the audit chain", 10).select("doc_id", "score")


def predict_properties(spark, sf_dir):
    s = search.text_search(_docs(spark, sf_dir), F.col("text"), QUERY, 20)
    return search.predict(s, ["lang", "source"]).select("property", "value", "support")


def weighted_token_search(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("koid"), "p_partkey", "p_name", "p_type", "p_brand")
    return search.weighted_tokens(p, {"p_name": 3.0, "p_type": 2.0, "p_brand": 0.5}, "small red steel brand", 10).select("p_partkey", "score")


_T = TOKENS.format("text")
_WORDS = "[" + ", ".join(f"'{w}'" for w in QUERY.split()) + "]"


def _jac(words: str, tokens_sql: str = "t") -> str:
    return f"CASE WHEN len({tokens_sql}) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect({tokens_sql}, {words}))::DOUBLE / len(list_distinct(list_concat({tokens_sql}, {words}))), 6) END"


def _cos(a: str, b: str) -> str:
    d = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
    return f"round({d.format(a, b)} / sqrt({d.format(a, a)} * {d.format(b, b)}), 6)"


_HYBRID = f"""
WITH docs AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS koid, {_T} AS t FROM documents), one AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 1),
vec AS (SELECT koid, {_cos('embedding', 'q')} AS score FROM docs JOIN embeddings ON vec_id = doc_id, one ORDER BY score DESC, koid LIMIT <K>),
txt AS (SELECT koid, {_jac(_WORDS)} AS score FROM docs ORDER BY score DESC, koid LIMIT <K>),
rv AS (SELECT koid, row_number() OVER (ORDER BY score DESC, koid) AS r FROM vec WHERE score > 0),
rt AS (SELECT koid, row_number() OVER (ORDER BY score DESC, koid) AS r FROM txt WHERE score > 0)
"""


def _rrf_sql(k: int, base: int) -> str:
    return _HYBRID.replace("<K>", str(k)) + f"""
SELECT koid, round(coalesce(1.0::DOUBLE / (61 + rv.r - 1 + {base}), 0) + coalesce(1.0::DOUBLE / (61 + rt.r - 1 + {base}), 0), 9) AS score
FROM rv FULL JOIN rt USING (koid) ORDER BY score DESC, koid LIMIT 10"""


# ---- graph


def _seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "koid string")


def edges_outbound(spark, sf_dir):
    return graph.outbound(edges(spark, sf_dir), "customer:7")


def edges_inbound(spark, sf_dir):
    return graph.inbound(edges(spark, sf_dir), "nation:7")


def _traverse(depth: int, direction: str = "out", rel: str | None = None):
    def run(spark, sf_dir):
        """From every order, or against the edges from one region."""
        seeds = table(spark, sf_dir, "orders").select(F.concat(F.lit("orders:"), "o_orderkey").alias("koid")) if direction == "out" else _seed(spark, "region:1")
        return graph.traverse(edges(spark, sf_dir), seeds, depth, rel, direction).select("koid", "rel_type", "depth")

    return run


def traverse_multi_seed(spark, sf_dir):
    return graph.traverse(edges(spark, sf_dir), _seed(spark, "customer:1", "customer:2", "supplier:3", "nation:4"), 2).select("koid", "rel_type", "depth")


_EDGES = """
WITH RECURSIVE edge AS (
  SELECT 'nation:' || n_nationkey AS src, 'in_region' AS rel_type, 'region:' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'in_nation', 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'in_nation', 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'orders:' || o_orderkey, 'placed_by', 'customer:' || o_custkey FROM orders
)"""


def _traverse_sql(depth: int, seeds: str, both: bool = False, inward: bool = False) -> str:
    step = {
        (False, False): "SELECT src AS at, rel_type, dst AS koid FROM edge",
        (False, True): "SELECT dst AS at, rel_type, src AS koid FROM edge",
        (True, False): "SELECT src AS at, rel_type, dst AS koid FROM edge UNION ALL SELECT dst, rel_type, src FROM edge",
    }[both, inward]
    hops = []
    for i in range(1, depth + 1):
        hops.append(f"h{i} AS (SELECT s.koid, min(s.rel_type) AS rel_type, {i} AS depth FROM step s JOIN h{i - 1} p ON p.koid = s.at WHERE " + " AND ".join(f"s.koid NOT IN (SELECT koid FROM h{j})" for j in range(i)) + " GROUP BY s.koid)")
    return _EDGES + f", step AS ({step}), h0 AS ({seeds}), " + ", ".join(hops) + " " + " UNION ALL ".join(f"SELECT koid, rel_type, depth FROM h{i}" for i in range(1, depth + 1))


_ALL = "SELECT DISTINCT 'orders:' || o_orderkey AS koid FROM orders"

QUERIES = {
    "match_query_text": _match('MATCH orders WHERE o_orderstatus == "F" AND o_totalprice > 150000 RETURN o_orderkey, o_totalprice'),
    "match_query_json": _json({"scan": {"type": "documents"}, "filter": {"lang": "en", "source": "wiki_export"}, "project": ["doc_id", "n_chars"]}),
    "scan_type": _match("MATCH orders RETURN *"),
    "filter_eq": _match('MATCH orders WHERE o_orderstatus == "F" RETURN o_orderkey'),
    "filter_neq_missing": _match('MATCH documents WHERE lang != "en" RETURN doc_id, lang'),
    "filter_range": _match("MATCH orders WHERE o_totalprice >= 100000 AND o_totalprice < 120000 RETURN o_orderkey, o_totalprice"),
    "filter_and": _match('MATCH customer WHERE c_mktsegment == "BUILDING" AND c_acctbal > 5000 RETURN c_custkey'),
    "filter_or": _match('MATCH customer WHERE c_mktsegment == "BUILDING" OR c_acctbal > 9000 AND c_nationkey == 3 RETURN c_custkey'),
    "filter_null": _match("MATCH documents WHERE mime_type == null AND lang != null RETURN doc_id"),
    "filter_type_mismatch": _strict,
    "project_fields": _match("MATCH part RETURN p_name, no_such_field, p_size"),
    "ontology_expand_union": _match("MATCH Party RETURN *"),
    "text_jaccard_topk": text_jaccard_topk,
    "text_inverted_candidates": text_inverted_candidates,
    "text_bm25_topk": text_bm25_topk,
    "text_indexed_topk": text_indexed_topk,
    "ann_topk": ann_topk,
    "ann_model_filter": ann_model_filter,
    "fuse_rrf_runtime": fuse_rrf_runtime,
    "fuse_rrf_kernel": fuse_rrf_kernel,
    "fuse_weighted": fuse_weighted,
    "find_similar_filtered": find_similar_filtered,
    "infer_similar": infer_similar,
    "predict_properties": predict_properties,
    "weighted_token_search": weighted_token_search,
    "edges_outbound": edges_outbound,
    "edges_inbound": edges_inbound,
    "traverse_depth1": _traverse(1),
    "traverse_depth2": _traverse(2),
    "traverse_depth3": _traverse(3),
    "traverse_inbound": _traverse(2, "in"),
    "traverse_both": _traverse(2, "both"),
    "traverse_multi_seed": traverse_multi_seed,
}

_BM25 = f"""
WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS koid, {_T} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS l FROM d),
w AS (SELECT unnest({_WORDS}) AS w),
idf AS (SELECT w, ln(1 + (n - c + 0.5) / (c + 0.5)) AS idf FROM (SELECT w, (SELECT count(*) FROM d WHERE list_contains(t, w)) AS c FROM w), st)
SELECT doc_id, round(sum(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(t) / l))), 6) AS score
FROM d JOIN idf ON list_contains(t, w), st GROUP BY doc_id, koid ORDER BY score DESC, koid LIMIT 10"""

_PERSONS = TOKENS.format("name")
ORACLES = {
    "match_query_text": f"SELECT {_ORDERS}, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000",
    "match_query_json": "SELECT CAST(doc_id AS VARCHAR) AS koid, 'documents' AS type_name, 1::BIGINT AS version, doc_id, n_chars FROM documents WHERE lang = 'en' AND source = 'wiki_export'",
    "scan_type": "SELECT CAST(o_orderkey AS VARCHAR) AS koid, 'orders' AS type_name, 1::BIGINT AS version, * FROM orders",
    "filter_eq": f"SELECT {_ORDERS}, o_orderkey FROM orders WHERE o_orderstatus = 'F'",
    "filter_neq_missing": "SELECT CAST(doc_id AS VARCHAR) AS koid, 'documents' AS type_name, 1::BIGINT AS version, doc_id, lang FROM documents WHERE lang IS DISTINCT FROM 'en'",
    "filter_range": f"SELECT {_ORDERS}, o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 120000",
    "filter_and": "SELECT CAST(c_custkey AS VARCHAR) AS koid, 'customer' AS type_name, 1::BIGINT AS version, c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000",
    "filter_or": "SELECT CAST(c_custkey AS VARCHAR) AS koid, 'customer' AS type_name, 1::BIGINT AS version, c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR (c_acctbal > 9000 AND c_nationkey = 3)",
    "filter_null": "SELECT CAST(doc_id AS VARCHAR) AS koid, 'documents' AS type_name, 1::BIGINT AS version, doc_id FROM documents WHERE mime_type IS NULL AND lang IS NOT NULL",
    "filter_type_mismatch": f"SELECT {_ORDERS}, o_orderkey FROM orders",
    "project_fields": "SELECT CAST(p_partkey AS VARCHAR) AS koid, 'part' AS type_name, 1::BIGINT AS version, p_name, p_size FROM part",
    "ontology_expand_union": """
SELECT CAST(c_custkey AS VARCHAR) AS koid, 'customer' AS type_name, 1::BIGINT AS version, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
  NULL::BIGINT AS s_suppkey, NULL::VARCHAR AS s_name, NULL::INTEGER AS s_nationkey, NULL::DOUBLE AS s_acctbal FROM customer
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'supplier', 1::BIGINT, NULL, NULL, NULL, NULL, NULL, s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier""",
    "text_jaccard_topk": f"SELECT doc_id, score FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS koid, {_jac(_WORDS)} AS score FROM (SELECT doc_id, {_T} AS t FROM documents)) ORDER BY score DESC, koid LIMIT 10",
    "text_inverted_candidates": f"""
WITH q AS (SELECT koid AS query_id, unnest({_PERSONS}) AS token FROM kb_entry),
d AS (SELECT name, unnest({_PERSONS}) AS token FROM (SELECT DISTINCT name FROM entity_candidate WHERE name IS NOT NULL))
SELECT query_id, name, count(*) AS shared FROM d JOIN q USING (token) GROUP BY ALL""",
    "text_bm25_topk": _BM25,
    "text_indexed_topk": f"SELECT koid, score FROM (SELECT CAST(doc_id AS VARCHAR) AS koid, {_jac(_WORDS)} AS score FROM (SELECT doc_id, {_T} AS t FROM documents)) WHERE score > 0 ORDER BY score DESC, koid LIMIT 10",
    "ann_topk": f"""
SELECT query_id, id, cosine, rank::INTEGER AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS id, {_cos('a.embedding', 'b.embedding')} AS cosine,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY {_cos('a.embedding', 'b.embedding')} DESC, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 10""",
    "ann_model_filter": f"""
SELECT query_id, id, cosine, rank::INTEGER AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS id, {_cos('a.embedding', 'b.embedding')} AS cosine,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY {_cos('a.embedding', 'b.embedding')} DESC, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND a.label = 3 AND b.label = 3) WHERE rank <= 5""",
    "fuse_rrf_runtime": _rrf_sql(10, 1),
    "fuse_rrf_kernel": _rrf_sql(100, 0),
    "fuse_weighted": _HYBRID.replace("<K>", "100") + "SELECT koid, round(0.7::DOUBLE * coalesce(vec.score, 0) + 0.3::DOUBLE * coalesce(txt.score, 0), 7) AS score FROM vec FULL JOIN txt USING (koid) ORDER BY score DESC, koid LIMIT 10",
    "find_similar_filtered": f"SELECT doc_id, score FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS koid, {_jac(_WORDS)} AS score FROM (SELECT doc_id, {_T} AS t FROM documents WHERE lang = 'en' AND source = 'wiki_export')) WHERE score > 0 ORDER BY score DESC, koid LIMIT 5",
    "infer_similar": f"SELECT doc_id, score FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS koid, {_jac(str('which rule protects the audit chain'.split()))} AS score FROM (SELECT doc_id, {_T} AS t FROM documents WHERE source = 'api_docs')) ORDER BY score DESC, koid LIMIT 10",
    "predict_properties": f"""
WITH s AS (SELECT *, row_number() OVER (ORDER BY score DESC, koid) AS r FROM (
  SELECT CAST(doc_id AS VARCHAR) AS koid, lang, source, {_jac(_WORDS)} AS score FROM (SELECT *, {_T} AS t FROM documents)) ORDER BY score DESC, koid LIMIT 20)
SELECT 'lang' AS property, arg_min(lang, r) AS value, count(*) AS support FROM s WHERE lang IS NOT NULL
UNION ALL SELECT 'source', arg_min(source, r), count(*) FROM s WHERE source IS NOT NULL""",
    "weighted_token_search": f"""
WITH q AS (SELECT ['small', 'red', 'steel', 'brand'] AS w)
SELECT p_partkey, score FROM (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS koid, round(
  3.0::DOUBLE * len(list_intersect(w, {TOKENS.format('p_name')})) / 4 + 2.0::DOUBLE * len(list_intersect(w, {TOKENS.format('p_type')})) / 4 + 0.5::DOUBLE * len(list_intersect(w, {TOKENS.format('p_brand')})) / 4, 6) AS score FROM part, q)
WHERE score > 0 ORDER BY score DESC, koid LIMIT 10""",
    "edges_outbound": _EDGES + " SELECT * FROM edge WHERE src = 'customer:7'",
    "edges_inbound": _EDGES + " SELECT * FROM edge WHERE dst = 'nation:7'",
    "traverse_depth1": _traverse_sql(1, _ALL),
    "traverse_depth2": _traverse_sql(2, _ALL),
    "traverse_depth3": _traverse_sql(3, _ALL),
    "traverse_inbound": _traverse_sql(2, "SELECT 'region:1' AS koid", inward=True),
    "traverse_both": _traverse_sql(2, "SELECT 'region:1' AS koid", both=True),
    "traverse_multi_seed": _traverse_sql(2, "SELECT unnest(['customer:1', 'customer:2', 'supplier:3', 'nation:4']) AS koid"),
}
