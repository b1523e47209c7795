"""Streaming queries, each drained to a table, with the SQL of the same batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from koengine.streaming import cdc


def _path(sf_dir: str) -> str:
    return f"{sf_dir.rstrip('/')}/journal.parquet"


def cdc_append_available_now(spark, sf_dir):
    s = cdc.journal_stream(spark, _path(sf_dir), kinds=("created", "forgotten"))
    return cdc.drain(s.select("seq", "koid", "version", "kind")).distinct()


def index_maintain_foreachbatch(spark, sf_dir):
    """Head versions kept by a stream."""
    fold = lambda b: b.where("koid IS NOT NULL AND version IS NOT NULL").groupBy("koid").agg(F.max("version").alias("version"), F.max("seq").alias("seq"))
    merge = lambda p: p.groupBy("koid").agg(F.max("version").alias("version"), F.max("seq").alias("seq"))
    return cdc.maintain(cdc.journal_stream(spark, _path(sf_dir)), fold, merge)


def trigger_fire(spark, sf_dir):
    triggers = spark.createDataFrame([("Forgotten", None, "sweep"), ("ClaimAsserted", None, "review"), ("Created", None, "index")], "event_kind string, type_filter string, program string")
    fired = cdc.drain(cdc.fire_triggers(cdc.journal_stream(spark, _path(sf_dir)), triggers)).distinct()
    return fired.groupBy("program").agg(F.count("*").alias("fired"))


def index_lag(spark, sf_dir):
    return cdc.index_lag(spark.read.parquet(_path(sf_dir)), 1000)


QUERIES = {f.__name__: f for f in (cdc_append_available_now, index_maintain_foreachbatch, trigger_fire, index_lag)}

_CODE = "regexp_replace(lower(kind), '[^a-z]', '', 'g')"
ORACLES = {
    "cdc_append_available_now": f"SELECT DISTINCT seq, koid, version, kind FROM journal WHERE {_CODE} IN ('created', 'forgotten')",
    "index_maintain_foreachbatch": "SELECT koid, max(version) AS version, max(seq) AS seq FROM journal WHERE koid IS NOT NULL AND version IS NOT NULL GROUP BY koid",
    "trigger_fire": f"SELECT CASE {_CODE} WHEN 'forgotten' THEN 'sweep' WHEN 'created' THEN 'index' ELSE 'review' END AS program, count(*) AS fired FROM (SELECT DISTINCT seq, koid, kind FROM journal) WHERE {_CODE} IN ('created', 'forgotten', 'claimasserted') GROUP BY 1",
    "index_lag": "SELECT max(seq) - 1000 AS behind FROM journal",
}
