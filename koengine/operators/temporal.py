"""Versions, snapshots, lineage and the hash-chained journal."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from koengine.operators.changes import kind_code
from koengine.runtime import ship_code


def latest(df: DataFrame, key: str = "koid", version: str = "version") -> DataFrame:
    """Each key's row of highest version; equal versions are one. Two steps: the keys' newest version is
    found map-side on two narrow columns, then rows are kept by semi-join."""
    newest = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(version).alias(version))
    return df.join(newest, [key, version], "left_semi").dropDuplicates([key, version])


def snapshot(df: DataFrame, at: int, key: str = "koid", version: str = "version", ts: str = "commit_ts") -> DataFrame:
    """State as of a commit time: each key's highest version committed at or before ``at``."""
    return latest(df.where(F.col(ts) <= at), key, version)


def lineage(df: DataFrame, koid: str) -> DataFrame:
    return df.where(F.col("koid") == koid).dropDuplicates(["koid", "version"]).orderBy("version")


def events_of(journal: DataFrame, koid: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    e = journal.where(F.col("koid") == koid)
    return e.where(F.col("kind").isin(*kinds)) if kinds else e


def replay(journal: DataFrame, after: int, until: int | None = None) -> DataFrame:
    """Events with a sequence number above ``after``."""
    e = journal.where(F.col("seq") > after)
    return e.where(F.col("seq") <= until) if until is not None else e


def millis_of(commit_ts: Column) -> Column:
    """Wall-clock milliseconds of a hybrid logical clock value."""
    return F.shiftright(commit_ts, 16)


def build_chain(events: DataFrame, *, chain: str, order: str, payload: Column, genesis: str = "0" * 64) -> DataFrame:
    """(chain, order, prev_hash, audit_hash): SHA-256 chains, one for each value of ``chain``.

    A chain is sequential by nature. Chains are spread over partitions, sorted inside them, and
    hashed in a stream that keeps only the last hash, so a chain of any length needs constant
    memory; different chains run in parallel.
    """
    import hashlib

    ship_code(events.sparkSession)
    d = events.select(F.col(chain).alias("c"), F.col(order).alias("o"), F.sha2(payload.cast("binary"), 256).alias("h"))
    d = d.repartition("c").sortWithinPartitions("c", "o")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, genesis
        for b in batches:
            prev, own = [], []
            for c, h in zip(b["c"], b["h"]):
                if c != key:
                    key, last = c, genesis
                prev.append(last)
                last = hashlib.sha256((last + h).encode()).hexdigest()
                own.append(last)
            yield pd.DataFrame({"c": b["c"], "o": b["o"], "prev_hash": prev, "audit_hash": own})

    kinds = dict(events.select(chain, order).dtypes)
    out = d.select("c", "o", "h").mapInPandas(run, f"c {kinds[chain]}, o {kinds[order]}, prev_hash string, audit_hash string")
    return out.select(F.col("c").alias(chain), F.col("o").alias(order), "prev_hash", "audit_hash")


def verify_chain(journal: DataFrame) -> DataFrame:
    """(seq, status) of every journal row: 'ok', 'broken' (the hash before differs) or 'gap' (no row before).

    Each row meets its predecessor by an equi-join on the sequence number, so nothing is sorted in
    one task. Repeated rows count once; the first row of all is 'ok'.
    """
    one = journal.groupBy("seq").agg(F.max("prev_audit_hash").alias("prev_audit_hash"), F.max("audit_hash").alias("audit_hash"))
    before = one.select((F.col("seq") + 1).alias("seq"), F.col("audit_hash").alias("expected"))
    first = one.agg(F.min("seq").alias("first"))
    j = one.join(before, "seq", "left").crossJoin(F.broadcast(first))
    status = F.when(F.col("seq") == F.col("first"), "ok").when(F.col("expected").isNull(), "gap").when(F.col("expected") == F.col("prev_audit_hash"), "ok").otherwise("broken")
    return j.select("seq", status.alias("status"))


def event_fields(columns: tuple[str, ...] = ("seq", "koid", "version", "kind", "commit_ts", "payload_hash", "signature", "actor", "note")) -> Column:
    """One text of all fields that an audit hash covers; each is preceded by its length, so no two rows make the same text."""
    part = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")))
    return F.concat_ws("|", *[part(c) for c in columns])


def seal(events: DataFrame) -> DataFrame:
    """``events`` (seq, koid, version, kind, commit_ts, payload, signature, actor, note) with payload_hash, prev_audit_hash and audit_hash.

    The payload's hash and all other fields enter the audit hash, and so does the hash before.
    """
    e = events.withColumn("payload_hash", F.sha2(F.coalesce("payload", F.lit("")).cast("binary"), 256))
    chain = build_chain(e.withColumn("one_", F.lit(0)), chain="one_", order="seq", payload=event_fields())
    return e.join(chain.select("seq", F.col("prev_hash").alias("prev_audit_hash"), "audit_hash"), "seq")


def prove(journal: DataFrame) -> DataFrame:
    """(seq, status) of every row of a sealed journal, all hashes recomputed.

    'payload' if the payload no longer gives its hash, 'hash' if the fields and the hash before no
    longer give the audit hash, else the status of :func:`verify_chain`. A forgotten object's payload
    may be gone (null payload, hash kept): that is no damage if the kind is a ``Forgotten``. Each row
    needs only itself and its predecessor, so all rows are proved in parallel.
    """
    text = F.coalesce("payload", F.lit("")).cast("binary")
    gone = F.col("payload").isNull() & (kind_code(F.col("kind")) == "forgotten")
    audit = F.sha2(F.concat("prev_audit_hash", F.sha2(event_fields().cast("binary"), 256)).cast("binary"), 256)
    bad = F.when(~F.coalesce(gone, F.lit(False)) & ~F.col("payload_hash").eqNullSafe(F.sha2(text, 256)), 2).when(~F.col("audit_hash").eqNullSafe(audit), 1).otherwise(0)
    own = journal.groupBy("seq").agg(F.max(bad).alias("bad"))
    status = F.when(F.col("bad") == 2, "payload").when(F.col("bad") == 1, "hash").otherwise(F.col("status"))
    return own.join(verify_chain(journal), "seq").select("seq", status.alias("status"))
