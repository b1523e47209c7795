"""Applying a change feed of inserts, updates and deletes: newest-first resolution.

The feed is cut into batches by version octave pairs and the batches are processed backwards, the
highest versions first. In each batch, changes of keys that a newer batch already resolved drop out
by anti-join; the remaining keys take their newest image or tombstone. Base rows of keys that no
batch touched are appended at the end. A key's changes inside a batch are reduced map-side, so a
key that holds a third of the feed never meets in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from koengine.runtime import materialize


def kind_code(kind: Column) -> Column:
    """A change kind in one spelling: lower case, letters only (``LIFECYCLE_CHANGED`` = ``LifecycleChanged``)."""
    return F.regexp_replace(F.lower(kind), "[^a-z]", "")


def apply_changes(
    changes: DataFrame, *, key: str, version: str, kind: str, deletes: tuple[str, ...] = ("forgotten",), ignored: tuple[str, ...] = ("audit",),
    base: DataFrame | None = None, octaves: int = 2,
) -> DataFrame:
    """Current (key, version) of every key that is alive after all changes.

    The version orders the changes of a key, whatever their order of arrival; equal versions are
    one change. Kinds are compared by :func:`kind_code`; a null kind counts as an update. Rows with
    a null key or version change nothing, as do ``ignored`` kinds. A key whose newest change is one
    of ``deletes`` is not alive. If one version comes with several kinds, a delete among them wins.
    ``base`` (key, version) holds rows of an earlier state: they stay for untouched keys, and a
    base row newer than every change wins. Further columns are ignored; an empty feed gives the
    base, or no rows.
    """
    code = kind_code(F.col(kind))
    feed = changes.select(F.col(key).alias("k"), F.col(version).cast("long").alias("v"), F.coalesce(code.isin(*deletes), F.lit(False)).alias("gone"), code.alias("code"))
    feed = feed.where(F.col("k").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.col("code").isin(*ignored), F.lit(False)))
    # batch 0 is the newest; octave of v: 0 for v < 2, else floor(log2(v))
    octave = F.when(F.col("v") < 2, F.lit(0)).otherwise(F.floor(F.log2(F.col("v").cast("double"))).cast("int"))
    feed = feed.select("k", "v", "gone", F.floor(octave / octaves).cast("int").alias("batch"))
    # map-side reduction to one row a key and batch, written once, read once by batch
    staged = materialize(feed.groupBy("k", "batch").agg(F.max(F.struct("v", "gone")).alias("x")).select("k", "batch", "x.v", "x.gone"), "changes", partition_by="batch")
    batches = sorted((r["batch"] for r in staged.select("batch").distinct().collect()), reverse=True)  # at most 64 / octaves
    resolved: list[DataFrame] = []
    for b in batches:
        seen = staged.where(F.col("batch") == b).select("k", "v", "gone")
        newer = [staged.where(F.col("batch") == n).select("k") for n in batches if n > b]
        if newer:
            seen = seen.join(reduce(DataFrame.unionByName, newer), "k", "left_anti")
        resolved.append(seen)
    if not resolved:
        state = staged.select("k", "v", "gone")
    else:
        state = reduce(DataFrame.unionByName, resolved)
    if base is not None:
        old = base.select(F.col(key).alias("k"), F.col(version).cast("long").alias("bv")).where("k IS NOT NULL AND bv IS NOT NULL").groupBy("k").agg(F.max("bv").alias("bv"))
        touched = state.join(old, "k", "left").select("k", F.greatest("v", F.coalesce("bv", "v")).alias("v"), (F.col("gone") & ~F.coalesce(F.col("bv") > F.col("v"), F.lit(False))).alias("gone"))
        untouched = old.join(state.select("k"), "k", "left_anti").select("k", F.col("bv").alias("v"), F.lit(False).alias("gone"))
        state = touched.unionByName(untouched)
    return state.where(~F.col("gone")).select(F.col("k").alias(key), F.col("v").alias(version))


def current_rows(changes: DataFrame, alive: DataFrame, *, key: str, version: str, kind: str, payload: str, ignored: tuple[str, ...] = ("audit",)) -> DataFrame:
    """The payload of each alive (key, version); repeats of one change count once, the largest payload stays."""
    images = changes.where(F.col(key).isNotNull() & F.col(version).isNotNull() & ~F.coalesce(kind_code(F.col(kind)).isin(*ignored), F.lit(False))).select(key, F.col(version).cast("long").alias(version), payload)
    images = images.join(alive, [key, version], "left_semi").groupBy(key, version).agg(F.max(payload).alias(payload))
    return alive.join(images, [key, version], "left")
