"""Constraint evaluation and mining: violations as rows, statistics in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import NumericType

from koengine.functions.checks import parse_check, violates

#: What the named formats accept.
FORMATS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "url": r"^https?://[^\s]+$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "date": r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])$",
    "datetime": r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?$",
}


def range_rule(c: Column, low=None, high=None) -> Column:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (c < low)
    if high is not None:
        bad = bad | (c > high)
    return c.isNotNull() & bad


def length_rule(c: Column, least: int = 0, most: int | None = None) -> Column:
    """Length in UTF-8 bytes."""
    n = F.octet_length(c)
    return c.isNotNull() & ((n < least) | (F.lit(False) if most is None else n > most))


def enum_rule(c: Column, values: Sequence) -> Column:
    return c.isNotNull() & ~c.isin(*values)


def pattern_rule(c: Column, pattern: str) -> Column:
    """The pattern is searched, not matched as a whole."""
    return c.isNotNull() & ~c.rlike(pattern)


def format_rule(c: Column, name: str) -> Column:
    return pattern_rule(c, FORMATS[name])


def required_rule(c: Column) -> Column:
    return c.isNull()


def evaluate(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """(key, rule) of every violation: all rules in one pass over the rows."""
    hits = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()])
    return df.select(F.col(key), F.explode(F.filter(hits, lambda r: r.isNotNull())).alias("rule"))


def check_rule(source: str) -> Column:
    return violates(parse_check(source))


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., rows) of key values that come more than once; counted map-side."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is no node."""
    return edges.join(nodes.select(F.col("koid").alias("dst")), "dst", "left_anti").select("src", "rel_type", "dst")


def cardinality(edges: DataFrame, rel_type: str, most: int) -> DataFrame:
    """(src, n) of sources with more than ``most`` edges of one relation."""
    return edges.where(F.col("rel_type") == rel_type).groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > most)


def mine(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(property, rows, filled, distinct_values, low, high) of the columns (all, unless given): low and high of numbers only.

    Each column is counted by value first, reading that column alone and reducing map-side: no row is multiplied by the
    number of columns, as one aggregation of many distinct counts would.
    """
    mined = list(df.columns if columns is None else columns)
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    out = None
    for c in mined:
        by_value = df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
        number = F.col("v").cast("double") if c in numeric else F.lit(None).cast("double")
        stats = by_value.agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).cast("long").alias("filled"), F.count("v").alias("distinct_values"),
            F.min(number).alias("low"), F.max(number).alias("high"),
        ).select(F.lit(c).alias("property"), "rows", "filled", "distinct_values", "low", "high")
        out = stats if out is None else out.unionByName(stats)
    return out


def mine_not_null(stats: DataFrame, least: float = 0.9) -> DataFrame:
    return stats.where((F.col("rows") > 0) & (F.col("filled") / F.col("rows") >= least)).select("property", F.round(F.col("filled") / F.col("rows"), 6).alias("confidence"))


def mine_unique(stats: DataFrame) -> DataFrame:
    """Confidence and violations (rows beyond the first of each value) of every property with two values or more."""
    return stats.where("filled >= 2").select("property", F.round(F.col("distinct_values") / F.col("filled"), 6).alias("confidence"), (F.col("filled") - F.col("distinct_values")).alias("violations"))


def mine_range(stats: DataFrame) -> DataFrame:
    return stats.where("low IS NOT NULL AND low <> high").select("property", "low", "high", F.lit(1.0).alias("confidence"))


def immutable_changes(versions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(koid, version, property) where a column that may not change differs from the version before."""
    w = W.partitionBy("koid").orderBy("version")
    hits = F.array(*[F.when(F.lag("version").over(w).isNotNull() & ~F.col(c).eqNullSafe(F.lag(c).over(w)), F.lit(c)) for c in columns])
    return versions.dropDuplicates(["koid", "version"]).withColumn("hits", hits).select("koid", "version", F.explode(F.filter("hits", lambda x: x.isNotNull())).alias("property"))
