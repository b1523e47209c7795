"""Writes as batches: new versions, tombstones, journal rows, edges. One writer at a time.

A batch is checked as a whole (optimistic versions by a join with the heads) and gives the rows to
append; nothing is written unless every check passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from koengine.lang import logical as lp

#: Allowed lifecycle transitions.
TRANSITIONS = (
    ("draft", "active"), ("active", "verified"), ("active", "archived"), ("verified", "archived"), ("draft", "review"), ("review", "approved"), ("review", "draft"), ("approved", "published"),
    ("published", "deprecated"), ("deprecated", "retired"), ("published", "superseded"), ("superseded", "retired"), ("active", "published"), ("verified", "published"), ("archived", "retired"), ("deprecated", "archived"), ("active", "deprecated"), ("verified", "deprecated"),
)


def remember(heads: DataFrame, batch: DataFrame, key: str = "koid") -> tuple[DataFrame, DataFrame]:
    """(accepted with their new version, rejected) of a batch with (key, expected_version, ...).

    A row is rejected if its expected version is not the head's (null: the key must be new), or if
    the key comes twice in the batch.
    """
    h = heads.groupBy(key).agg(F.max("version").alias("head"))
    twice = batch.groupBy(key).count().where("count > 1").select(key)
    j = batch.join(h, key, "left")
    ok = F.coalesce(F.col("head"), F.lit(0)) == F.coalesce(F.col("expected_version"), F.lit(0))
    rejected = j.where(~ok).unionByName(j.where(ok).join(twice, key, "left_semi"))
    accepted = j.where(ok).join(twice, key, "left_anti").withColumn("version", (F.coalesce(F.col("head"), F.lit(0)) + 1).cast("long"))
    return accepted.drop("head", "expected_version"), rejected.drop("head")


def forget(heads: DataFrame, koids: DataFrame, commit_ts: int) -> DataFrame:
    """Tombstone versions of the given keys."""
    newest = heads.groupBy("koid").agg(F.max("version").alias("v"))
    return newest.join(koids.select("koid").distinct(), "koid", "left_semi").select("koid", (F.col("v") + 1).alias("version"), F.lit("deleted").alias("state"), F.lit(commit_ts).cast("long").alias("commit_ts"))


def evolve(heads: DataFrame, wanted: DataFrame) -> DataFrame:
    """(koid, from_state, to_state, allowed) of wanted transitions (koid, to_state); a state may always stay."""
    spark = heads.sparkSession
    allow = spark.createDataFrame(TRANSITIONS, "from_state string, to_state string").withColumn("allowed", F.lit(True))
    j = heads.select("koid", F.col("state").alias("from_state")).join(wanted, "koid")
    return j.join(F.broadcast(allow), ["from_state", "to_state"], "left").select("koid", "from_state", "to_state", F.coalesce("allowed", F.col("from_state") == F.col("to_state")).alias("allowed"))


def relate(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with the new ones; adding an edge again changes nothing."""
    return edges.unionByName(new.select("src", "rel_type", "dst")).distinct()


def journal_rows(versions: DataFrame, kind: str, actor: str, last_seq: int) -> DataFrame:
    """Journal rows of a batch with gapless sequence numbers after ``last_seq``, in key order.

    Sequence numbers come from per-partition offsets over a range-partitioned order, not from one task.
    """
    ordered = versions.repartitionByRange("koid", "version").sortWithinPartitions("koid", "version").withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    ordered = ordered.withColumn("_i", F.col("_i") - F.shiftleft(F.col("_p").cast("long"), 33))
    sizes = ordered.groupBy("_p").count().collect()  # one row a partition
    starts, at = {}, last_seq
    for r in sorted(sizes, key=lambda r: r["_p"]):
        starts[r["_p"]] = at
        at += r["count"]
    offset = F.lit(last_seq)
    for p, s in starts.items():
        offset = F.when(F.col("_p") == p, F.lit(s)).otherwise(offset)
    return ordered.select((offset + F.col("_i") + 1).cast("long").alias("seq"), "koid", "version", F.lit(kind).alias("kind"), F.lit(actor).alias("actor"))


def apply_write(registry, w: lp.Write) -> DataFrame:
    """The object rows after a CREATE, UPDATE or DELETE of the query language, registered as the type's new state."""
    from koengine.plans.build import predicate

    spark = registry.spark
    if w.action == "create":
        cols = {k: v for k, v in w.values.items()}
        base = registry.objects(w.type_name) if registry.known(w.type_name) else None
        koid = F.substring(F.sha2(F.lit(w.type_name + repr(sorted(cols.items()))), 256), 1, 32)
        row = spark.range(1).select(koid.alias("koid"), F.lit(w.type_name).alias("type_name"), F.lit(1).cast("long").alias("version"), *[F.lit(v).alias(k) for k, v in cols.items()])
        out = row if base is None else base.unionByName(row, allowMissingColumns=True)
    else:
        base = registry.objects(w.type_name)
        hit = predicate(base, w.predicate) if w.predicate is not None else F.lit(True)
        if w.action == "delete":
            out = base.where(~F.coalesce(hit, F.lit(False)))
        else:
            out = base.withColumn("_hit", F.coalesce(hit, F.lit(False)))
            for k, v in w.values.items():
                old = F.col(k) if k in base.columns else F.lit(None)
                out = out.withColumn(k, F.when(F.col("_hit"), F.lit(v)).otherwise(old))
            out = out.withColumn("version", F.col("version") + F.col("_hit").cast("long")).drop("_hit")
    registry.register(w.type_name, out)
    return out
