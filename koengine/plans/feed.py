"""Queries over the change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from koengine.operators.changes import apply_changes, current_rows
from koengine.runtime import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects alive after all changes of ``journal``, with their current version."""
    return apply_changes(table(spark, sf_dir, "journal"), key="koid", version="version", kind="kind")


def p5_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rebuilt table: alive objects with version and payload."""
    journal = table(spark, sf_dir, "journal")
    alive = apply_changes(journal, key="koid", version="version", kind="kind")
    return current_rows(journal, alive, key="koid", version="version", kind="kind", payload="payload")


_NEWEST = """
WITH feed AS (
  SELECT koid, version, payload, regexp_replace(lower(kind), '[^a-z]', '', 'g') AS code
  FROM journal WHERE koid IS NOT NULL AND version IS NOT NULL
), kept AS (SELECT * FROM feed WHERE code IS DISTINCT FROM 'audit'),
newest AS (
  SELECT koid, version, max(coalesce(code = 'forgotten', false)) AS gone, max(payload) AS payload
  FROM kept GROUP BY koid, version
  QUALIFY row_number() OVER (PARTITION BY koid ORDER BY version DESC) = 1
)
"""

QUERIES = {"p5_found": p5_found, "p5_state": p5_state}
ORACLES = {
    "p5_found": _NEWEST + "SELECT koid, version FROM newest WHERE NOT gone",
    "p5_state": _NEWEST + "SELECT koid, version, payload FROM newest WHERE NOT gone",
}
