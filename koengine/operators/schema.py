"""Schema work: types of values, closed worlds, migrations, class hierarchies, canonical names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from koengine.runtime import materialize

#: Forms of the value types, as texts.
VALUE_FORMS = {"Int": r"^-?\d+$", "Float": r"^-?\d+(?:\.\d+)?$", "Bool": r"^(?i:true|false)$", "Date": r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])$", "Text": r"(?s)^.*$"}


def conform(df: DataFrame, names: Mapping[str, str], tag: str) -> DataFrame:
    """Physical columns under their canonical names, each row tagged with its class; other columns keep their names."""
    return df.withColumnsRenamed(dict(names)).withColumn("class", F.lit(tag))


def value_type(v: Column) -> Column:
    """Int, Float or Text, by the form of a text."""
    return F.when(v.rlike(VALUE_FORMS["Int"]), "Int").when(v.rlike(r"^-?\d+\.\d+$"), "Float").otherwise("Text")


def discover_properties(df: DataFrame, key: str, kind: str, properties: str) -> DataFrame:
    """(kind, property, entries, value_type) of every property that objects of a class bear; the type is that of the value of the smallest key."""
    p = df.select(F.col(key).alias("key_"), kind, F.explode(properties).alias("p")).select("key_", kind, "p.k", "p.v")
    return p.groupBy(kind, F.col("k").alias("property")).agg(F.count_distinct("key_").alias("entries"), F.min_by(value_type(F.col("v")), "key_").alias("value_type"))


def type_check(values: DataFrame, declared: Mapping[str, Mapping[str, str]], *, key: str, closed: bool = False) -> DataFrame:
    """(key, property, reason) of every value (key, type_name, k, v) that breaks its class's declared types.

    'type' if the value has not the declared form, 'undeclared' (in a closed world only) if the class
    declares no such property. Null values pass; classes that are not declared at all are open. The
    declarations are a handful of literals, so the check is one projection without a join.
    """
    kind, prop = F.col("type_name"), F.col("k")
    known, bad, stray = F.lit(False), F.lit(False), F.lit(False)
    for cls, props in declared.items():
        mine = kind == cls
        named = F.lit(False)
        for p, t in props.items():
            named = named | (prop == p)
            bad = bad | (mine & (prop == p) & F.col("v").isNotNull() & ~F.col("v").rlike(VALUE_FORMS[t]))
        known = known | mine
        stray = stray | (mine & ~named)
    reason = F.when(F.coalesce(bad, F.lit(False)), "type")
    if closed:
        reason = reason.when(F.coalesce(stray, F.lit(False)), "undeclared")
    return values.select(F.col(key), prop.alias("property"), reason.alias("reason")).where("reason IS NOT NULL")


def validate_migration(objects: DataFrame, version: str, from_version: int, rules: Mapping[str, Column], key: str) -> DataFrame:
    """(key, rule) of the objects of one schema version that would break the next version's rules: a dry run, nothing is written."""
    hits = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()])
    old = objects.where(F.col(version) == from_version)
    return old.select(F.col(key), F.explode(F.filter(hits, lambda r: r.isNotNull())).alias("rule"))


def ancestors(parents: DataFrame, most: int = 64) -> DataFrame:
    """(class, ancestor, steps) of every class (class, parent), itself at 0 steps; the least number of steps, cycles end.

    Each round doubles the reach, so a hierarchy of depth d takes log2(d) joins.
    """
    edge = parents.where("class IS NOT NULL AND parent IS NOT NULL").select("class", F.col("parent").alias("ancestor"), F.lit(1).alias("steps")).distinct()
    own = edge.select("class").unionByName(edge.select(F.col("ancestor").alias("class"))).distinct().select("class", F.col("class").alias("ancestor"), F.lit(0).alias("steps"))
    reach, size, upto = materialize(own.unionByName(edge).groupBy("class", "ancestor").agg(F.min("steps").alias("steps")), "ancestors"), -1, 1
    while upto < most:
        n = reach.count()
        if n == size:
            break
        size, upto = n, upto * 2
        further = reach.select("class", F.col("ancestor").alias("via"), F.col("steps").alias("s1")).join(reach.select(F.col("class").alias("via"), "ancestor", F.col("steps").alias("s2")), "via")
        reach = materialize(further.groupBy("class", "ancestor").agg(F.min(F.col("s1") + F.col("s2")).alias("steps")), "ancestors")
    return reach


def is_subclass(rows: DataFrame, cls: str, wanted: str, closure: DataFrame) -> DataFrame:
    """``rows`` whose class is ``wanted``'s class or below it (both are columns); classes outside the hierarchy equal themselves only."""
    up = closure.select(F.col("class").alias(cls), F.col("ancestor").alias(wanted), F.lit(True).alias("below_"))
    joined = rows.join(up, [cls, wanted], "left")
    return joined.where(F.coalesce("below_", F.col(cls) == F.col(wanted))).drop("below_")


def relation_violations(edges: DataFrame, nodes: DataFrame, rules: DataFrame, closure: DataFrame) -> DataFrame:
    """(src, rel_type, dst, reason) of edges whose source is not of the relation's domain ('domain') or target not of its range ('range').

    ``rules`` has (rel_type, domain, range), null for any; relations without a rule are free; ends that
    are no nodes are the referential check's business. Subclasses count as their classes.
    """
    e = edges.join(F.broadcast(rules), "rel_type")  # a list of relations kept by hand
    e = e.join(nodes.select(F.col("koid").alias("src"), F.col("type_name").alias("src_type")), "src").join(nodes.select(F.col("koid").alias("dst"), F.col("type_name").alias("dst_type")), "dst")
    up = closure.groupBy("class").agg(F.collect_set("ancestor").alias("up"))  # as many as a class has ancestors
    e = e.join(up.select(F.col("class").alias("src_type"), F.col("up").alias("src_up")), "src_type", "left").join(up.select(F.col("class").alias("dst_type"), F.col("up").alias("dst_up")), "dst_type", "left")
    fits = lambda t, u, want: F.col(want).isNull() | (F.col(t) == F.col(want)) | F.coalesce(F.array_contains(F.col(u), F.col(want)), F.lit(False))
    reasons = F.array(F.when(~fits("src_type", "src_up", "domain"), F.lit("domain")), F.when(~fits("dst_type", "dst_up", "range"), F.lit("range")))
    return e.select("src", "rel_type", "dst", F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("reason"))
