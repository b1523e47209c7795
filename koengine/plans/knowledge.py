"""Queries of the document pipeline and of knowledge analytics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from koengine.functions import text as tx
from koengine.functions.vectors import search_block
from koengine.operators import documents as d, knowledge as k
from koengine.runtime import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def text_lines(spark, sf_dir):
    return d.text_lines(_docs(spark, sf_dir), "doc_id")


def document_blocks(spark, sf_dir):
    return d.blocks(_docs(spark, sf_dir), "doc_id").select("doc_id", "block_no", "block_type", "heading_level")


def extract_entities(spark, sf_dir):
    return d.entities(table(spark, sf_dir, "ast_node"), "node_id")


def extract_dates(spark, sf_dir):
    return d.temporal_spans(table(spark, sf_dir, "ast_node"), "node_id").distinct()


def cooccur_relations(spark, sf_dir):
    return d.cooccurrence(table(spark, sf_dir, "ast_node"), "node_id")


def chunk_documents(spark, sf_dir):
    return d.chunks(_docs(spark, sf_dir), "doc_id")


def document_links(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(d.links(F.col("text"))).alias("target")).distinct()


def redact_secrets(spark, sf_dir):
    n = table(spark, sf_dir, "ast_node").select("node_id", "text").where("text IS NOT NULL").distinct()
    return n.select("node_id", tx.redact_secrets(F.col("text")).alias("text"), tx.secret_count(F.col("text")).cast("int").alias("secrets"))


def injection_guard(spark, sf_dir):
    return _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", d.trust(F.col("text")).alias("trust"))


def pages_needing_ocr(spark, sf_dir):
    return table(spark, sf_dir, "ocr_page").where(d.page_needs_ocr(F.col("text"), 200)).select("page_id").distinct()


def resolve_entities(spark, sf_dir):
    return k.resolve(table(spark, sf_dir, "entity_candidate").select("name"), table(spark, sf_dir, "kb_entry"))


def commit_actions(spark, sf_dir):
    e = table(spark, sf_dir, "entity_candidate").where("name IS NOT NULL")
    hints = e.groupBy("name").agg(F.min("type_hint").alias("type_hint"))
    kb = table(spark, sf_dir, "kb_entry")
    return k.commit_actions(k.resolve(e.select("name"), kb), hints, kb).groupBy("action").agg(F.count("*").alias("entities"))


def _entities(spark, sf_dir):
    e = table(spark, sf_dir, "entity_candidate").select("candidate_id", "name", "type_hint", "mentions", "confidence", F.col("evidence.document_id").alias("document_id"))
    return e.where("name IS NOT NULL").dropDuplicates(["candidate_id"])


def merge_entities(spark, sf_dir):
    return k.merge_entities(_entities(spark, sf_dir)).select("document_id", F.col("key").alias("name_key"), "type_hint", F.size("mentions").alias("mentions"), "confidence")


def _facts(spark, sf_dir):
    c = table(spark, sf_dir, "entity_conflict").where("koid IS NOT NULL AND document_value IS NOT NULL").dropDuplicates(["conflict_id"])
    prop = F.regexp_replace(F.lower("property_name"), "[^a-z]", "")
    return c.select("koid", prop.alias("property"), F.lower(F.trim("document_value")).alias("value"), "document_id", F.try_element_at("evidence", F.lit(1))["confidence"].cast("double").alias("confidence"), F.col("detected_at").alias("at"))


def dedup_facts(spark, sf_dir):
    f = _facts(spark, sf_dir)
    return k.dedup_facts(f.select(F.concat_ws(" ", "koid", "property", "value").alias("statement"), "document_id", F.round("confidence", 6).alias("confidence")))


def find_conflicts(spark, sf_dir):
    """Opposed or nearly equal statements about one entity."""
    f = _facts(spark, sf_dir).select(F.col("koid").alias("entity"), F.concat_ws(" ", "property", "value").alias("statement"))
    return k.statement_conflicts(f)


def conflict_values(spark, sf_dir):
    return k.conflict_classes(_facts(spark, sf_dir)).select("koid", "property", "value", "documents", F.col("values").alias("n_values"))


def detect_staleness(spark, sf_dir):
    return k.staleness(_facts(spark, sf_dir))


def reconcile_impact(spark, sf_dir):
    """Impact of a change to every document whose number ends in 7."""
    c = table(spark, sf_dir, "entity_conflict")
    changed = c.where("document_id LIKE '%7'").select("document_id")
    return k.impact(c.select("koid", "document_id"), changed)


_TASK = "merge alexander analytics minerals with international shipping"


def _ranked(spark, sf_dir):
    return k.rank_entities(k.merge_entities(_entities(spark, sf_dir)), _TASK)


def context_rank_entities(spark, sf_dir):
    return _ranked(spark, sf_dir).select("document_id", F.col("key").alias("name_key"), "score")


def context_budget_pack(spark, sf_dir):
    return k.pack_budget(_ranked(spark, sf_dir), 500).select("document_id", F.col("key").alias("name_key"), "score", "cost", "used")


def contradictions(spark, sf_dir):
    """Vectors near a queried one (every id divisible by 50, against all rows) whose label differs."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    near = search_block(v.where("id % 50 = 0"), v, None, 0.3)
    lab = v.select("id", "label")
    j = near.join(lab.withColumnRenamed("label", "label_b"), "id").join(lab.select(F.col("id").alias("query_id"), F.col("label").alias("label_a")), "query_id")
    return j.where("label_a <> label_b").select("query_id", "id", "cosine")


def recall_at_k(spark, sf_dir):
    """How many of the 10 nearest vectors the first half of the dimensions finds."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = v.where("id % 50 = 0")
    half = v.withColumn("vec", F.slice("vec", 1, 32))
    exact = search_block(q, v, 10, None).select("query_id", "id")
    got = search_block(half.where("id % 50 = 0"), half, 10, None).select("query_id", "id")
    return k.recall(exact, got)


def lag_percentiles(spark, sf_dir):
    j = table(spark, sf_dir, "journal").where("received_at IS NOT NULL").dropDuplicates(["seq"])
    lag = F.unix_seconds(F.col("received_at").cast("timestamp")) - F.floor(F.shiftright("commit_ts", 16) / 1000)
    return k.lag_stats(j.select("origin", lag.cast("long").alias("lag")), "origin")


QUERIES = {f.__name__: f for f in (
    text_lines, document_blocks, extract_entities, extract_dates, cooccur_relations, chunk_documents, document_links, redact_secrets, injection_guard, pages_needing_ocr, resolve_entities, commit_actions, merge_entities,
    dedup_facts, find_conflicts, conflict_values, detect_staleness, reconcile_impact, context_rank_entities, context_budget_pack, contradictions, recall_at_k, lag_percentiles,
)}

_RUN = r"[A-Z][A-Za-z0-9]+(?: [A-Z][A-Za-z0-9]+)+"


def _windows(runs: str) -> str:
    w = "list_transform(range(1, len(string_split(r, ' ')) - {n} + 2), lambda i: array_to_string(string_split(r, ' ')[i:i + {n} - 1], ' '))"
    return f"list_distinct(list_filter(list_concat(flatten(list_transform({runs}, lambda r: {w.format(n=2)})), flatten(list_transform({runs}, lambda r: {w.format(n=3)}))), lambda e: length(e) > 4))"


_SECRET_SQL = "text"
for _kind, _pattern in tx.SECRETS:
    _SECRET_SQL = f"regexp_replace({_SECRET_SQL}, '{_pattern}', '[REDACTED:{_kind}]', 'g')"
_COUNT_SQL = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for _, p in tx.SECRETS)
_TOK = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"
_SIM = f"""CASE WHEN a = b THEN 1.0 WHEN lower(a) = lower(b) THEN 0.95
  WHEN a <> '' AND b <> '' AND (contains(lower(a), lower(b)) OR contains(lower(b), lower(a))) THEN 0.8::DOUBLE * least(strlen(a), strlen(b)) / greatest(strlen(a), strlen(b)) + 0.1
  WHEN sh > 0 AND len(ta) >= 2 AND len(tb) >= 2 THEN 0.7::DOUBLE * sh / (len(ta) + len(tb) - sh) WHEN sh > 0 THEN 0.5 ELSE 0 END"""
_RESOLVED = f"""
WITH n AS (SELECT DISTINCT name AS a FROM entity_candidate WHERE name IS NOT NULL), nt AS (SELECT a, {_TOK.format('a')} AS ta FROM n),
kt AS (SELECT koid, name AS b, {_TOK.format('name')} AS tb FROM kb_entry),
p AS (SELECT a, koid, b, ta, tb, len(list_intersect(ta, tb)) AS sh FROM nt, kt WHERE list_has_any(ta, tb) OR contains(lower(a), lower(b)) OR contains(lower(b), lower(a))),
s AS (SELECT a, koid, round({_SIM}, 6)::DOUBLE AS score FROM p), g AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, koid) AS r FROM s WHERE score >= 0.5),
r AS (
  SELECT n.a AS name, one.koid AS koid, coalesce(one.score, 0) AS score,
    CASE WHEN one.score IS NULL THEN 'unmatched' WHEN two.score IS NOT NULL AND round(one.score - two.score, 6) < 0.15 THEN 'ambiguous' ELSE 'matched' END AS status
  FROM n LEFT JOIN g one ON one.a = n.a AND one.r = 1 LEFT JOIN g two ON two.a = n.a AND two.r = 2)
"""
_KEY = "regexp_replace(regexp_replace(trim(regexp_replace(lower(name), '\\s+', ' ', 'g')), '(type)+$', ''), '(_t)+$', '')"
_MERGED = f"""
WITH e AS (SELECT DISTINCT ON (candidate_id) candidate_id, name, type_hint, mentions, confidence, evidence.document_id AS document_id FROM entity_candidate WHERE name IS NOT NULL),
q AS (SELECT *, {_KEY} AS key FROM e),
m AS (SELECT document_id, key, min(name) AS name, min(type_hint) AS type_hint, coalesce(list_sort(list_distinct(list_filter(flatten(list(mentions)), lambda x: x IS NOT NULL))), []) AS mentions,
  least(1.0, round(sum(confidence::DOUBLE), 4)) AS confidence FROM q WHERE key <> '' GROUP BY document_id, key)
"""
_WORDS = [w for w in _TASK.split() if len(w) >= 3]


def _kw(t: str) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(lower({t}), '{w}') THEN 1.0::DOUBLE WHEN " + (f"len(list_filter({_TOK.format(t)}, lambda y: starts_with(y, '{w[:4]}'))) > 0" if len(w) >= 4 else "false") + " THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END" for w in _WORDS) + ")"


_RANK = _MERGED + f""", c AS (SELECT document_id, key, name, mentions, {_kw('name')} AS base FROM m),
x AS (SELECT document_id, key, sum({_kw('mention')}) AS ms FROM (SELECT document_id, key, unnest(mentions) AS mention FROM m) GROUP BY document_id, key),
s AS (SELECT c.document_id, c.key, c.name, round((base + 0.5::DOUBLE * coalesce(ms, 0)) * (1 + least(0.1::DOUBLE * len(mentions), 0.5::DOUBLE)), 6) AS score FROM c LEFT JOIN x ON x.document_id IS NOT DISTINCT FROM c.document_id AND x.key = c.key)
"""
_FACTS = """
WITH f AS (SELECT DISTINCT ON (conflict_id) koid, regexp_replace(lower(property_name), '[^a-z]', '', 'g') AS property, lower(trim(document_value, ' ')) AS value, document_id,
  evidence[1].confidence::DOUBLE AS confidence, detected_at AS told FROM entity_conflict WHERE koid IS NOT NULL AND document_value IS NOT NULL)
"""


def _cos(n: int) -> str:
    z = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
    a, b = f"a.embedding[1:{n}]", f"b.embedding[1:{n}]"
    return f"round({z.format(a, b)} / sqrt({z.format(a, a)} * {z.format(b, b)}), 6)"


def _words_sql(t: str) -> str:
    return f"list_distinct(list_filter(string_split(trim(regexp_replace({t}, '\\s+', ' ', 'g')), ' '), lambda z: z <> ''))"


def _jac_sql(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b})))"


ORACLES = {
    "text_lines": "SELECT doc_id, line_number::INTEGER AS line_number, line FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_number FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS l FROM documents)) WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')",
    "extract_entities": f"SELECT DISTINCT node_id, unnest({_windows('runs')}) AS entity FROM (SELECT node_id, regexp_extract_all(text, '{_RUN}') AS runs FROM ast_node)",
    "document_links": "SELECT DISTINCT doc_id, unnest(list_concat(regexp_extract_all(text, '\\[[^\\]\\n]+\\]\\(([^)\\s]+)\\)', 1), regexp_extract_all(text, '\\[\\[([^\\]|\\n]+)(?:\\|[^\\]\\n]*)?\\]\\]', 1))) AS target FROM documents",
    "extract_dates": f"""
WITH x AS (SELECT DISTINCT node_id, unnest(regexp_extract_all(text, '{tx.DATE_PATTERN}')) AS t FROM ast_node),
y AS (SELECT *, list_position({list(tx.MONTHS)}, regexp_extract(t, '^[A-Z][a-z]+')) AS m, TRY_CAST(regexp_extract(t, '(\\d{{4}})$', 1) AS INTEGER) AS y, TRY_CAST(regexp_extract(t, ' (\\d{{1,2}}),', 1) AS INTEGER) AS d, TRY_CAST(regexp_extract(t, '^Q([1-4])', 1) AS INTEGER) AS q FROM x),
b AS (SELECT node_id, t, q, m, d, CASE WHEN regexp_matches(t, '^\\d{{4}}-') THEN TRY_CAST(t AS DATE) WHEN q IS NOT NULL THEN make_date(y, q * 3 - 2, 1) WHEN d IS NOT NULL THEN TRY_CAST(format('{{:04d}}-{{:02d}}-{{:02d}}', y, m, d) AS DATE) WHEN m > 0 THEN make_date(y, m::INTEGER, 1) END AS s FROM y)
SELECT node_id, t AS date_text, CAST(s AS VARCHAR) AS start_date, CAST(CASE WHEN q IS NOT NULL THEN last_day(s + INTERVAL 2 MONTH) WHEN m > 0 AND d IS NULL THEN last_day(s) ELSE s END AS VARCHAR) AS end_date FROM b""",
    "redact_secrets": f"SELECT node_id, {_SECRET_SQL} AS text, ({_COUNT_SQL})::INTEGER AS secrets FROM (SELECT DISTINCT node_id, text FROM ast_node WHERE text IS NOT NULL)",
    "injection_guard": "SELECT doc_id, CASE WHEN regexp_matches(lower(text), '" + "|".join(tx.INJECTIONS) + "') THEN 'Untrusted' ELSE 'Trusted' END AS trust FROM documents WHERE text IS NOT NULL",
    "pages_needing_ocr": "SELECT DISTINCT page_id FROM ocr_page WHERE length(coalesce(trim(text, ' '), '')) < 200",
    "resolve_entities": _RESOLVED + "SELECT * FROM r",
    "commit_actions": _RESOLVED + """, h AS (SELECT name, min(type_hint) AS type_hint FROM entity_candidate WHERE name IS NOT NULL GROUP BY name)
SELECT action, count(*) AS entities FROM (SELECT CASE WHEN status = 'ambiguous' THEN 'NeedsReview' WHEN status = 'unmatched' THEN 'CreateKO' WHEN lower(type_hint) <> lower(type_name) THEN 'NeedsReview' WHEN score = 1.0 THEN 'Skip' ELSE 'UpdateKO' END AS action
  FROM r LEFT JOIN h USING (name) LEFT JOIN kb_entry k ON k.koid = r.koid) GROUP BY action""",
    "merge_entities": _MERGED + "SELECT document_id, key AS name_key, type_hint, len(mentions)::INTEGER AS mentions, confidence FROM m",
    "context_rank_entities": _RANK + "SELECT document_id, key AS name_key, score FROM s WHERE score > 0",
    "context_budget_pack": _RANK + """, p AS (SELECT *, greatest(ceil(strlen(name) / 4.0), 1)::BIGINT AS cost FROM s WHERE score > 0),
u AS (SELECT *, sum(cost) OVER (ORDER BY score DESC, coalesce(document_id, ''), key ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM p)
SELECT document_id, key AS name_key, score, cost, used FROM u WHERE used <= 500""",
    "dedup_facts": _FACTS + "SELECT concat_ws(' ', koid, property, value) AS statement, min(document_id) AS document_id, max(round(confidence, 6)) AS confidence, count(*) AS copies FROM f GROUP BY 1",
    "conflict_values": _FACTS + "SELECT * FROM (SELECT koid, property, value, count(DISTINCT document_id) AS documents, count(*) OVER (PARTITION BY koid, property) AS n_values FROM f GROUP BY koid, property, value) WHERE n_values > 1",
    "find_conflicts": _FACTS + f""", s AS (SELECT DISTINCT koid AS entity, concat_ws(' ', property, value) AS st FROM f),
o AS (SELECT * FROM (VALUES {', '.join(str(x) for x in k.OPPOSED)}) t(yes, no)),
pos AS (SELECT entity, st, yes, {_words_sql("replace(replace(lower(st), no, ''), yes, '')")} AS w FROM s, o WHERE contains(replace(lower(st), no, ''), yes)),
neg AS (SELECT entity, st, yes, {_words_sql("replace(lower(st), no, '')")} AS w FROM s, o WHERE contains(lower(st), no)),
al AS (SELECT entity, st, {_words_sql('st')} AS w FROM s)
SELECT DISTINCT p.entity, least(p.st, n.st) AS a, greatest(p.st, n.st) AS b, 'contradiction' AS kind FROM pos p JOIN neg n USING (entity, yes) WHERE p.st <> n.st AND {_jac_sql('p.w', 'n.w')} > 0.4
UNION ALL SELECT x.entity, x.st, y.st, 'ambiguous' FROM al x JOIN al y ON x.entity = y.entity AND x.st < y.st WHERE {_jac_sql('x.w', 'y.w')} > 0.7 AND {_jac_sql('x.w', 'y.w')} < 0.95""",
    "detect_staleness": _FACTS + f""", v AS (SELECT koid, property, value, max(struct_pack(c := coalesce(confidence, -1), a := told)) AS t FROM f GROUP BY ALL),
r AS (SELECT koid, property, value, row_number() OVER w AS r, first_value(value) OVER w AS best FROM v WINDOW w AS (PARTITION BY koid, property ORDER BY t DESC, value)),
q AS (SELECT *, {_words_sql('lower(value)')} AS wv, {_words_sql('lower(best)')} AS wb FROM r),
h AS (SELECT *, count(*) OVER (PARTITION BY koid, property) AS n FROM q WHERE r = 1 OR NOT (lower(value) = lower(best) OR (len(list_distinct(list_concat(wv, wb))) > 0 AND {_jac_sql('wv', 'wb')} > 0.85)))
SELECT koid, property, value, CASE WHEN r = 1 THEN 'authoritative'
  WHEN {' OR '.join(f"contains(lower(best), '{t}') <> contains(lower(value), '{t}')" for t in k.TURNS)} THEN 'conflict'
  WHEN trim(coalesce(string_split(lower(best), 'uses')[2], '')) <> '' AND trim(coalesce(string_split(lower(value), 'uses')[2], '')) <> '' AND trim(string_split(lower(best), 'uses')[2]) <> trim(string_split(lower(value), 'uses')[2]) THEN 'conflict'
  ELSE 'divergence' END AS status FROM h WHERE n > 1""",
    "reconcile_impact": """
WITH e AS (SELECT DISTINCT koid, document_id FROM entity_conflict WHERE koid IS NOT NULL AND document_id IS NOT NULL), d AS (SELECT DISTINCT koid FROM e WHERE document_id LIKE '%7')
SELECT koid, 'Direct' AS severity FROM d UNION ALL SELECT DISTINCT koid, 'Indirect' FROM e WHERE document_id IN (SELECT document_id FROM e WHERE koid IN (SELECT koid FROM d)) AND koid NOT IN (SELECT koid FROM d)""",
    "contradictions": f"SELECT a.vec_id AS query_id, b.vec_id AS id, {_cos(64)} AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label <> b.label WHERE a.vec_id % 50 = 0 AND {_cos(64)} >= 0.3",
    "recall_at_k": f"""
WITH x AS (SELECT a.vec_id AS q, b.vec_id AS i, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_cos(64)} DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY r <= 10),
y AS (SELECT a.vec_id AS q, b.vec_id AS i, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_cos(32)} DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY r <= 10)
SELECT x.q AS query_id, count(*) AS expected, count(y.i) AS hits, round(count(y.i) / count(*), 6) AS recall FROM x LEFT JOIN y ON y.q = x.q AND y.i = x.i GROUP BY x.q""",
    "lag_percentiles": """
WITH l AS (SELECT origin, floor(epoch(received_at))::BIGINT - (commit_ts >> 16) // 1000 AS lag FROM (SELECT DISTINCT ON (seq) * FROM journal WHERE received_at IS NOT NULL)),
s AS (SELECT origin, lag, row_number() OVER (PARTITION BY origin ORDER BY lag) AS r, count(*) OVER (PARTITION BY origin) AS n FROM l)
SELECT origin, n, floor(avg(lag))::BIGINT AS mean_lag, max(lag) AS max_lag, max(CASE WHEN r = floor((n - 1) * 0.95) + 1 THEN lag END) AS p_lag FROM s GROUP BY origin, n""",
}
