"""Tools around the store: explanations, memory, reports, rules, rendering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from koengine.functions.text import token_list
from koengine.operators.search import top
from koengine.operators.temporal import latest, verify_chain

#: Authorities from the strongest to the weakest, with their weights.
AUTHORITY = {
    "canonical": 1.0, "verified_source": 0.95, "official_document": 0.90, "domain_expert": 0.85, "code": 0.80, "test": 0.75, "documentation": 0.70, "agent": 0.50, "conversation": 0.35, "inference": 0.15, "unknown": 0.05,
}


def authority_filter(df: DataFrame, authority: str, least: str) -> DataFrame:
    """Rows whose authority is at least as strong as ``least``, with their weight."""
    order = list(AUTHORITY)
    keep = order[: order.index(least) + 1]
    weight = F.create_map(*[x for k in order for x in (F.lit(k), F.lit(AUTHORITY[k]))])
    return df.where(F.col(authority).isin(*keep)).withColumn("authority_weight", weight[F.col(authority)])


def memory_search(memories: DataFrame, query: str, now: int, k: int = 10) -> DataFrame:
    """Memories that are not past their time, by shared words: name 3, description 2, body 0.5; repeated query words count."""
    words = [w for w in query.lower().replace("-", " ").replace("_", " ").split() if w]
    alive = memories.where(F.col("ttl").isNull() | (F.col("commit_ts") + F.col("ttl") > now))
    total: Column = F.lit(0.0)
    for field, weight in (("name", 3.0), ("description", 2.0), ("body", 0.5)):
        toks = token_list(F.coalesce(F.col(field), F.lit("")))
        hits = F.lit(0)
        for w in words:
            hits = hits + F.array_contains(toks, w).cast("int")
        total = total + F.lit(weight) * hits / max(1, len(words))
    return top(alive.withColumn("score", F.round(total, 6)).where("score > 0"), k).withColumn("snippet", F.substring("body", 1, 200))


def reason(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(rule, koid, claim) of every row that meets a rule's SQL condition: one filter a rule, united."""
    out = None
    for name, condition in rules:
        hit = df.where(condition).select(F.lit(name).alias("rule"), "koid", F.concat(F.col("type_name"), F.lit("-claim")).alias("claim"))
        out = hit if out is None else out.unionByName(hit)
    return out


def explain(ko: DataFrame, journal: DataFrame, koid: str) -> DataFrame:
    """One row about an object's newest version: origin, source, confidence, state and its number of events."""
    head = latest(ko.where(F.col("koid") == koid)).select("koid", "version", "origin", F.col("semantic.source").alias("source"), F.col("semantic.confidence").alias("confidence"), (F.col("state") == "verified").alias("verified"))
    n = journal.where(F.col("koid") == koid).agg(F.count_distinct("seq").alias("events"))
    return head.crossJoin(F.broadcast(n))  # one row each


def prove(journal: DataFrame) -> DataFrame:
    """(rows, intact): whether the whole chain holds together."""
    return verify_chain(journal).agg(F.count("*").alias("rows"), F.bool_and(F.col("status") == "ok").alias("intact"))


def explain_component(entities: DataFrame, facts: DataFrame, relations: DataFrame, name: str) -> DataFrame:
    """(kind, item) of all that is known of a component: facts, dependencies, dependents, tests."""
    f = facts.where(F.array_contains("entities", name)).select(F.lit("fact").alias("kind"), F.col("statement").alias("item"))
    out = relations.where((F.col("subject") == name) & (F.col("predicate") != "tested_by")).select(F.lit("dependency").alias("kind"), F.col("object").alias("item"))
    back = relations.where((F.col("object") == name) & (F.col("predicate") != "tested_by")).select(F.lit("dependent").alias("kind"), F.col("subject").alias("item"))
    tests = relations.where((F.col("subject") == name) & (F.col("predicate") == "tested_by")).select(F.lit("test").alias("kind"), F.col("object").alias("item"))
    return f.unionByName(out).unionByName(back).unionByName(tests).distinct()


def trace_requirement(relations: DataFrame, requirement: str, steps: Sequence[str] = ("decided_by", "realised_by", "contains", "tested_by")) -> DataFrame:
    """(step, item) along a chain of relations from a requirement."""
    at = relations.where((F.col("subject") == requirement) & (F.col("predicate") == steps[0])).select(F.col("object").alias("item")).distinct()
    out = at.select(F.lit(steps[0]).alias("step"), "item")
    for s in steps[1:]:
        at = relations.where(F.col("predicate") == s).join(at.withColumnRenamed("item", "subject"), "subject").select(F.col("object").alias("item")).distinct()
        out = out.unionByName(at.select(F.lit(s).alias("step"), "item"))
    return out


def stale_documentation(documented: DataFrame, coded: DataFrame) -> DataFrame:
    """(name, status): documented but not coded, or coded but not documented."""
    a = documented.select("name").distinct()
    b = coded.select("name").distinct()
    return a.join(b, "name", "left_anti").withColumn("status", F.lit("not_in_code")).unionByName(b.join(a, "name", "left_anti").withColumn("status", F.lit("not_documented")))


def validate_change(entities: DataFrame, facts: DataFrame, change: str) -> dict[str, int | str]:
    """Entities and facts a textual change touches, and its risk: HIGH above 5 entities, MEDIUM above 10 facts, LOW otherwise."""
    low = change.lower()
    hit = entities.where((F.length("name") > 2) & (F.contains(F.lit(low), F.lower("name")) | F.contains(F.lower("name"), F.lit(low)))).select("name").distinct()
    n = hit.count()
    m = facts.select("statement", F.explode("entities").alias("name")).join(hit, "name", "left_semi").select("statement").distinct().count()
    return {"entities": n, "facts": m, "risk": "HIGH" if n > 5 else "MEDIUM" if m > 10 else "LOW"}


def metrics(ko: DataFrame, journal: DataFrame) -> DataFrame:
    """(objects, live, versions, last_seq) of a store."""
    heads = latest(ko)
    a = heads.agg(F.count("*").alias("objects"), F.count_if(~F.coalesce("state", F.lit("")).eqNullSafe("deleted")).alias("live"))
    b = ko.agg(F.count_distinct("koid", "version").alias("versions"))
    return a.crossJoin(b).crossJoin(journal.agg(F.max("seq").alias("last_seq")))  # one row each


def compliance(df: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """(field, rows, filled) of the named expressions, in one pass."""
    s = df.agg(F.count("*").alias("rows"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(fields.values())])
    lines = F.array(*[F.struct(F.lit(n).alias("field"), F.col("rows"), F.col(f"c{i}").alias("filled")) for i, n in enumerate(fields)])
    return s.select(F.explode(lines).alias("x")).select("x.*")


def render_markdown(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """(name, markdown): a section for each entity with its facts as a list, in order of confidence."""
    f = facts.select(F.explode("entities").alias("name"), "statement", "confidence").groupBy("name").agg(F.sort_array(F.collect_set(F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), F.col("statement").alias("s")))).alias("fs"))
    j = entities.select("name", "type_hint").distinct().join(f, "name", "left")
    items = F.array_join(F.transform("fs", lambda x: F.concat(F.lit("- "), x["s"])), "\n")
    return j.select("name", F.concat(F.lit("## "), F.col("name"), F.coalesce(F.concat(F.lit(" ("), F.col("type_hint"), F.lit(")")), F.lit("")), F.lit("\n\n"), F.coalesce(items, F.lit(""))).alias("markdown"))


def key_events(journal: DataFrame, prefix: str = "key") -> DataFrame:
    return journal.where(F.lower("kind").startswith(prefix)).groupBy("kind").agg(F.count_distinct("seq").alias("events"))
