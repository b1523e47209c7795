"""Queries of versions, the journal, security, constraints and schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from koengine.functions import checks
from koengine.functions.checks import Lit, Op, Prop
from koengine.operators import constraints as c, graph, schema, security, temporal  # noqa: F401
from koengine.runtime import table
from koengine.sources.registry import edges

AT = 114_600_000_000_000_000


def latest_version(spark, sf_dir):
    return temporal.latest(table(spark, sf_dir, "ko").select("koid", "version", "commit_ts", "state", "type_name"))


def snapshot_at(spark, sf_dir):
    return temporal.snapshot(table(spark, sf_dir, "ko").select("koid", "version", "commit_ts", "state"), AT)


def lineage_trace(spark, sf_dir):
    """Versions and distance in time to the version before, for every object."""
    from pyspark.sql import Window as W

    k = table(spark, sf_dir, "ko").select("koid", "version", "commit_ts", "state", "origin").dropDuplicates(["koid", "version"])
    return k.withColumn("elapsed", F.col("commit_ts") - F.lag("commit_ts").over(W.partitionBy("koid").orderBy("version")))


def replay_after_seq(spark, sf_dir):
    return temporal.replay(table(spark, sf_dir, "journal"), 3000).select("seq", "koid", "version", "kind").distinct()


def event_kind_filter(spark, sf_dir):
    return table(spark, sf_dir, "journal").where(F.col("kind").isin("Created", "Forgotten")).groupBy("kind", "origin").agg(F.count_distinct("seq").alias("events"))


def audit_chain_build(spark, sf_dir):
    """A hash chain of every user's events, in order of event id."""
    e = table(spark, sf_dir, "events")
    return temporal.build_chain(e, chain="user_id", order="event_id", payload=F.concat_ws("|", "event_id", "event_type", "props"))


def audit_chain_verify(spark, sf_dir):
    return temporal.verify_chain(table(spark, sf_dir, "journal")).groupBy("status").agg(F.count("*").alias("rows"))


def commit_clock(spark, sf_dir):
    return table(spark, sf_dir, "journal").groupBy("origin").agg(F.min(temporal.millis_of(F.col("commit_ts"))).alias("first_ms"), F.max(temporal.millis_of(F.col("commit_ts"))).alias("last_ms"))


# ---- security


def _ko(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "ko").select("koid", "version", "type_name", "tenant", "classification", "state", "origin")


def acl_row_filter(spark, sf_dir):
    """Access lists derived from the classification: staff may read internal rows, nobody outside may read restricted ones."""
    entry = lambda p, a, e: F.struct(F.lit(p).alias("principal"), F.lit(a).alias("action"), F.lit(e).alias("effect"))
    acl = F.when(F.col("classification") == "internal", F.array(entry("staff", "read", "allow"))).when(F.col("classification") == "public", F.array(entry("everyone", "read", "allow"), entry("staff", "admin", "allow"))).when(
        F.col("classification") == "restricted", F.array(entry("staff", "read", "deny"), entry("everyone", "read", "allow"))
    )
    subject = security.Subject("ann", frozenset({"staff"}))
    k = _ko(spark, sf_dir)
    return k.where(security.authorized(k, subject, "read", acl=acl, parents={"staff": ["everyone"]})).select("koid", "version").distinct()


def tenant_filter(spark, sf_dir):
    k = _ko(spark, sf_dir)
    ok = security.authorized(k, security.Subject("root", frozenset({"admin"}), "tn-lease-034"), "read")
    return k.where(ok).select("koid", "version", "tenant").distinct()


POLICIES = [("intern", "*", "fact", "deny"), ("*", "read", "doc", "allow"), ("staff", "*", "runbook", "allow"), ("*", "*", "*", "deny")]


def policy_eval(spark, sf_dir):
    k = _ko(spark, sf_dir)
    effect = security.policy_effect(k, POLICIES, {"bob", "staff"}, "read", F.col("type_name"))
    return k.select("koid", "version", "type_name", F.coalesce(effect, F.lit("none")).alias("effect")).distinct().groupBy("type_name", "effect").agg(F.count("*").alias("rows"))


def role_closure(spark, sf_dir):
    got = security.role_closure({"lead"}, {"lead": ["staff"], "staff": ["everyone"], "intern": ["everyone"]})
    return spark.createDataFrame([(r,) for r in sorted(got)], "role string")


def tenant_quota(spark, sf_dir):
    k = temporal.latest(_ko(spark, sf_dir))
    return security.tenant_quota(k, 20)


# ---- constraints


def constraint_range(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return c.evaluate(o, "o_orderkey", {"price.range": c.range_rule(F.col("o_totalprice"), 1000, 400000)})


def constraint_format(spark, sf_dir):
    k = table(spark, sf_dir, "entity_conflict").select("conflict_id", "existing_value").distinct().where("existing_value RLIKE '^[0-9]{4}-'")
    return c.evaluate(k, "conflict_id", {"value.date": c.format_rule(F.col("existing_value"), "date")})


def constraint_enum(spark, sf_dir):
    k = table(spark, sf_dir, "entity_conflict").select("conflict_id", "severity").distinct()
    return c.evaluate(k, "conflict_id", {"severity.enum": c.enum_rule(F.col("severity"), ["Info", "Warning", "Blocking"]), "severity.required": c.required_rule(F.col("severity"))})


def constraint_length(spark, sf_dir):
    return c.evaluate(table(spark, sf_dir, "documents"), "doc_id", {"text.length": c.length_rule(F.col("text"), 1, 2000)})


def constraint_pattern(spark, sf_dir):
    return c.evaluate(table(spark, sf_dir, "customer"), "c_custkey", {"name.pattern": c.pattern_rule(F.col("c_name"), "[0-4]$")})


def constraint_check_expr(spark, sf_dir):
    """A parsed check and a built one with arithmetic and IF; a missing value is a violation."""
    d = table(spark, sf_dir, "documents")
    built = Op("if", (Op("==", (Prop("source"), Lit("glossary"))), Op(">=", (Prop("n_chars"), Lit(100))), Op("<=", (Op("*", (Prop("n_chars"), Lit(2))), Lit(4000)))))
    return c.evaluate(d, "doc_id", {"check.lang": c.check_rule('lang == "en" or n_chars > 500 and not source == "glossary"'), "check.size": checks.violates(built)})


def unique_violations(spark, sf_dir):
    return c.unique_violations(table(spark, sf_dir, "journal").where("koid IS NOT NULL"), ["koid", "version"])


def dangling_refs(spark, sf_dir):
    """Node-to-region edges against a set of nodes without the regions of odd key."""
    e = edges(spark, sf_dir)
    nodes = e.select(F.col("src").alias("koid")).unionByName(table(spark, sf_dir, "region").where("r_regionkey % 2 = 0").select(F.concat(F.lit("region:"), "r_regionkey").alias("koid"))).distinct()
    return c.dangling(e, nodes)


def cardinality_violations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    e = o.select(F.concat(F.lit("customer:"), "o_custkey").alias("src"), F.lit("placed").alias("rel_type"), F.col("o_orderkey").alias("dst"))
    return c.cardinality(e, "placed", 12)


def _stats(spark, sf_dir):
    """Of every column of documents."""
    return c.mine(table(spark, sf_dir, "documents"))


def mine_not_null(spark, sf_dir):
    return c.mine_not_null(_stats(spark, sf_dir), 0.5)


def mine_unique(spark, sf_dir):
    return c.mine_unique(_stats(spark, sf_dir))


def mine_range(spark, sf_dir):
    return c.mine_range(_stats(spark, sf_dir))


def immutable_provenance(spark, sf_dir):
    return c.immutable_changes(table(spark, sf_dir, "ko").select("koid", "version", "tenant", "origin"), ["tenant", "origin"])


# ---- schema


def type_counts(spark, sf_dir):
    k = temporal.latest(_ko(spark, sf_dir)).where("state IS DISTINCT FROM 'deleted'")
    return k.groupBy("type_name").agg(F.count("*").alias("live"))


def audit_inventory(spark, sf_dir):
    return temporal.latest(_ko(spark, sf_dir)).groupBy("type_name", "state").agg(F.count("*").alias("objects"))


def discover_ontology_props(spark, sf_dir):
    """Properties of each class of known entries: how many entries bear them, smallest example by key."""
    return schema.discover_properties(table(spark, sf_dir, "kb_entry"), "koid", "type_name", "properties")


def conform_rename(spark, sf_dir):
    """Physical columns under their canonical names, tagged with the class."""
    return schema.conform(table(spark, sf_dir, "supplier"), {"s_suppkey": "key", "s_name": "name", "s_nationkey": "nation", "s_acctbal": "balance"}, "Party")


def type_check_values(spark, sf_dir):
    """Reported values of conflicts that have not their property's declared type, or no declared property."""
    v = table(spark, sf_dir, "entity_conflict").select("conflict_id", F.lit("conflict").alias("type_name"), F.regexp_replace(F.lower("property_name"), "[^a-z]", "").alias("k"), F.trim("document_value").alias("v")).distinct()
    declared = {"foundedon": "Date", "headcount": "Int", "status": "Text", "jobtitle": "Text", "reportsto": "Text", "filingreference": "Text", "annualrevenue": "Float"}
    return schema.type_check(v, {"conflict": declared}, key="conflict_id", closed=True)


def migration_validate(spark, sf_dir):
    """Objects of the schema version before that would break the next version's rules."""
    k = temporal.latest(table(spark, sf_dir, "ko").select("koid", "version", "schema_version", "tenant", "classification"))
    return schema.validate_migration(k, "schema_version", 1, {"tenant.required": F.col("tenant").isNull(), "classification.enum": ~F.col("classification").isin("internal", "public")}, "koid")


def subclass_closure(spark, sf_dir):
    """All ancestors of each class, with the number of steps."""
    rows = [("Manager", "Employee"), ("Employee", "Person"), ("Person", "Party"), ("Organization", "Party")]
    return schema.ancestors(spark.createDataFrame(rows, "class string, parent string"))


def domain_range_violations(spark, sf_dir):
    """Edges whose ends are not of the relation's classes, subclasses counted in."""
    classes = schema.ancestors(spark.createDataFrame([("customer", "Party"), ("supplier", "Party")], "class string, parent string"))
    e = edges(spark, sf_dir)
    nodes = e.select(F.col("src").alias("koid")).unionByName(e.select(F.col("dst").alias("koid"))).distinct().select("koid", F.substring_index("koid", ":", 1).alias("type_name"))
    rules = spark.createDataFrame([("in_nation", "Party", "nation"), ("in_region", "nation", "region"), ("placed_by", "orders", "supplier")], "rel_type string, domain string, range string")
    return schema.relation_violations(e, nodes, rules, classes).groupBy("rel_type", "reason").agg(F.count("*").alias("edges"))


QUERIES = {f.__name__: f for f in (
    latest_version, snapshot_at, lineage_trace, replay_after_seq, event_kind_filter, audit_chain_build, audit_chain_verify, commit_clock, acl_row_filter, tenant_filter, policy_eval, role_closure, tenant_quota,
    constraint_range, constraint_format, constraint_enum, constraint_length, constraint_pattern, constraint_check_expr, unique_violations, dangling_refs, cardinality_violations, mine_not_null, mine_unique, mine_range,
    immutable_provenance, type_counts, audit_inventory, discover_ontology_props, conform_rename, type_check_values, migration_validate, subclass_closure, domain_range_violations,
)}

_HEADS = "WITH heads AS (SELECT DISTINCT ON (koid) * FROM ko WHERE koid IS NOT NULL ORDER BY koid, version DESC)"
_MINE = """
WITH s AS (
  SELECT 'n_chars' AS property, count(*) AS rows, count(n_chars) AS filled, count(DISTINCT n_chars) AS d, min(n_chars)::DOUBLE AS low, max(n_chars)::DOUBLE AS high FROM documents
  UNION ALL SELECT 'doc_id', count(*), count(doc_id), count(DISTINCT doc_id), min(doc_id)::DOUBLE, max(doc_id)::DOUBLE FROM documents)
"""
_TEXTS = ("text", "lang", "source", "collection", "mime_type", "ingested_at")
_MINE_ALL = _MINE.rstrip().removesuffix(")") + "".join(f"  UNION ALL SELECT '{p}', count(*), count({p}), count(DISTINCT {p}), NULL, NULL FROM documents\n" for p in _TEXTS) + ")\n"
ORACLES = {
    "latest_version": _HEADS + " SELECT koid, version, commit_ts, state, type_name FROM heads",
    "snapshot_at": f"SELECT DISTINCT ON (koid) koid, version, commit_ts, state FROM ko WHERE commit_ts <= {AT} ORDER BY koid, version DESC",
    "lineage_trace": "SELECT *, commit_ts - lag(commit_ts) OVER (PARTITION BY koid ORDER BY version) AS elapsed FROM (SELECT DISTINCT koid, version, commit_ts, state, origin FROM ko)",
    "replay_after_seq": "SELECT DISTINCT seq, koid, version, kind FROM journal WHERE seq > 3000",
    "event_kind_filter": "SELECT kind, origin, count(DISTINCT seq) AS events FROM journal WHERE kind IN ('Created', 'Forgotten') GROUP BY ALL",
    "audit_chain_build": """
WITH RECURSIVE e AS (
  SELECT user_id, event_id, sha256(concat_ws('|', event_id, event_type, props)) AS h, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events
), c AS (
  SELECT user_id, event_id, i, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || h) AS audit_hash FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, c.audit_hash, sha256(c.audit_hash || e.h) FROM c JOIN e ON e.user_id = c.user_id AND e.i = c.i + 1
) SELECT user_id, event_id, prev_hash, audit_hash FROM c""",
    "audit_chain_verify": """
WITH one AS (SELECT seq, max(prev_audit_hash) AS p, max(audit_hash) AS a FROM journal GROUP BY seq)
SELECT status, count(*) AS rows FROM (
  SELECT CASE WHEN o.seq = (SELECT min(seq) FROM one) THEN 'ok' WHEN b.a IS NULL THEN 'gap' WHEN b.a = o.p THEN 'ok' ELSE 'broken' END AS status FROM one o LEFT JOIN one b ON b.seq = o.seq - 1
) GROUP BY status""",
    "commit_clock": "SELECT origin, min(commit_ts >> 16) AS first_ms, max(commit_ts >> 16) AS last_ms FROM journal GROUP BY origin",
    "acl_row_filter": "SELECT DISTINCT koid, version FROM ko WHERE classification IN ('internal', 'public')",
    "tenant_filter": "SELECT DISTINCT koid, version, tenant FROM ko WHERE tenant = 'tn-lease-034' OR tenant IS NULL",
    "policy_eval": "SELECT type_name, CASE WHEN type_name IN ('doc', 'runbook') THEN 'allow' ELSE 'deny' END AS effect, count(*) AS rows FROM (SELECT DISTINCT koid, version, type_name FROM ko) GROUP BY ALL",
    "role_closure": """
WITH RECURSIVE p AS (SELECT * FROM (VALUES ('lead', 'staff'), ('staff', 'everyone'), ('intern', 'everyone')) t(role, parent)),
c AS (SELECT 'lead' AS role UNION SELECT p.parent FROM c JOIN p ON p.role = c.role) SELECT role FROM c""",
    "tenant_quota": _HEADS + " SELECT tenant, count(*) AS live, count(*) > 20 AS over FROM heads WHERE state IS DISTINCT FROM 'deleted' GROUP BY tenant",
    "constraint_range": "SELECT o_orderkey, 'price.range' AS rule FROM orders WHERE o_totalprice < 1000 OR o_totalprice > 400000",
    "constraint_format": r"SELECT DISTINCT conflict_id, 'value.date' AS rule FROM entity_conflict WHERE regexp_matches(existing_value, '^[0-9]{4}-') AND NOT regexp_matches(existing_value, '^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])$')",
    "constraint_enum": "SELECT DISTINCT conflict_id, CASE WHEN severity IS NULL THEN 'severity.required' ELSE 'severity.enum' END AS rule FROM entity_conflict WHERE severity IS NULL OR severity NOT IN ('Info', 'Warning', 'Blocking')",
    "constraint_length": "SELECT doc_id, 'text.length' AS rule FROM documents WHERE strlen(text) < 1 OR strlen(text) > 2000",
    "constraint_pattern": "SELECT c_custkey, 'name.pattern' AS rule FROM customer WHERE NOT regexp_matches(c_name, '[0-4]$')",
    "constraint_check_expr": """
SELECT doc_id, 'check.lang' AS rule FROM documents WHERE CASE WHEN lang IS NULL THEN true WHEN lang = 'en' THEN false WHEN n_chars IS NULL THEN true WHEN n_chars <= 500 THEN true ELSE source IS NULL OR source = 'glossary' END
UNION ALL SELECT doc_id, 'check.size' FROM documents WHERE source IS NULL OR n_chars IS NULL OR CASE WHEN source = 'glossary' THEN n_chars < 100 ELSE n_chars * 2 > 4000 END""",
    "unique_violations": "SELECT koid, version, count(*) AS rows FROM journal WHERE koid IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "dangling_refs": "SELECT 'nation:' || n_nationkey AS src, 'in_region' AS rel_type, 'region:' || n_regionkey AS dst FROM nation WHERE n_regionkey % 2 = 1",
    "cardinality_violations": "SELECT 'customer:' || o_custkey AS src, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "mine_not_null": _MINE_ALL + "SELECT property, round(filled / rows, 6) AS confidence FROM s WHERE filled / rows >= 0.5",
    "mine_unique": _MINE_ALL + "SELECT property, round(d / filled, 6) AS confidence, filled - d AS violations FROM s WHERE filled >= 2",
    "mine_range": _MINE_ALL + "SELECT property, low, high, 1.0::DOUBLE AS confidence FROM s WHERE low <> high",
    "immutable_provenance": """
WITH v AS (SELECT DISTINCT koid, version, tenant, origin FROM ko),
l AS (SELECT *, lag(version) OVER w AS pv, lag(tenant) OVER w AS pt, lag(origin) OVER w AS po FROM v WINDOW w AS (PARTITION BY koid ORDER BY version))
SELECT koid, version, 'tenant' AS property FROM l WHERE pv IS NOT NULL AND tenant IS DISTINCT FROM pt
UNION ALL SELECT koid, version, 'origin' FROM l WHERE pv IS NOT NULL AND origin IS DISTINCT FROM po""",
    "type_counts": _HEADS + " SELECT type_name, count(*) AS live FROM heads WHERE state IS DISTINCT FROM 'deleted' GROUP BY type_name",
    "audit_inventory": _HEADS + " SELECT type_name, state, count(*) AS objects FROM heads GROUP BY ALL",
    "discover_ontology_props": r"""
SELECT type_name, k AS property, count(DISTINCT koid) AS entries, arg_min(CASE WHEN regexp_matches(v, '^-?\d+$') THEN 'Int' WHEN regexp_matches(v, '^-?\d+\.\d+$') THEN 'Float' ELSE 'Text' END, koid) AS value_type
FROM (SELECT koid, type_name, p.k AS k, p.v AS v FROM (SELECT koid, type_name, unnest(properties) AS p FROM kb_entry)) GROUP BY ALL""",
    "type_check_values": r"""
WITH v AS (SELECT DISTINCT conflict_id, regexp_replace(lower(property_name), '[^a-z]', '', 'g') AS property, trim(document_value, ' ') AS v FROM entity_conflict)
SELECT conflict_id, property, 'type' AS reason FROM v WHERE (property = 'foundedon' AND NOT regexp_matches(v, '^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])$'))
  OR (property = 'headcount' AND NOT regexp_matches(v, '^-?\d+$')) OR (property = 'annualrevenue' AND NOT regexp_matches(v, '^-?\d+(?:\.\d+)?$'))
UNION ALL SELECT conflict_id, property, 'undeclared' FROM v WHERE property NOT IN ('foundedon', 'headcount', 'status', 'jobtitle', 'reportsto', 'filingreference', 'annualrevenue')""",
    "migration_validate": _HEADS + """ SELECT koid, 'tenant.required' AS rule FROM heads WHERE schema_version = 1 AND tenant IS NULL
UNION ALL SELECT koid, 'classification.enum' FROM heads WHERE schema_version = 1 AND classification NOT IN ('internal', 'public')""",
    "subclass_closure": """
WITH RECURSIVE p AS (SELECT * FROM (VALUES ('Manager', 'Employee'), ('Employee', 'Person'), ('Person', 'Party'), ('Organization', 'Party')) t(class, parent)),
a AS (SELECT DISTINCT class, class AS ancestor, 0 AS steps FROM (SELECT class FROM p UNION SELECT parent FROM p) UNION SELECT a.class, p.parent, a.steps + 1 FROM a JOIN p ON p.class = a.ancestor)
SELECT class, ancestor, min(steps)::INTEGER AS steps FROM a GROUP BY ALL""",
    "domain_range_violations": "SELECT 'placed_by' AS rel_type, 'range' AS reason, count(*) AS edges FROM orders",
    "conform_rename": "SELECT s_suppkey AS key, s_name AS name, s_nationkey AS nation, s_acctbal AS balance, 'Party' AS class FROM supplier",
}
