"""Traversal of typed edges (src, rel_type, dst) by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from koengine.runtime import materialize


def outbound(edges: DataFrame, node: str, rel_type: str | None = None) -> DataFrame:
    e = edges.where(F.col("src") == node)
    return e.where(F.col("rel_type") == rel_type) if rel_type else e


def inbound(edges: DataFrame, node: str, rel_type: str | None = None) -> DataFrame:
    e = edges.where(F.col("dst") == node)
    return e.where(F.col("rel_type") == rel_type) if rel_type else e


def traverse(edges: DataFrame, seeds: DataFrame, depth: int, rel_type: str | None = None, direction: str = "out") -> DataFrame:
    """(koid, rel_type, depth) of the nodes within ``depth`` steps of the seeds; seeds are not emitted.

    ``seeds`` has (koid). A node counts once, at its least depth, with its least relation there. The
    frontier is joined with the edges step by step and nodes already seen are dropped by anti-join,
    so each edge is used at most once for each direction. Each step but the last is written to the
    shared folder, so no step is computed twice and the plan stays as long as one step.
    """
    e = edges.where(F.col("rel_type") == rel_type) if rel_type else edges
    e = e.where("src IS NOT NULL AND dst IS NOT NULL")
    fwd = e.select(F.col("src").alias("at"), "rel_type", F.col("dst").alias("koid"))
    back = e.select(F.col("dst").alias("at"), "rel_type", F.col("src").alias("koid"))
    steps = {"out": fwd, "in": back, "both": fwd.unionByName(back)}[direction]
    seeds = materialize(seeds.select("koid").where("koid IS NOT NULL").distinct(), "seeds") if depth > 1 else seeds.select("koid").where("koid IS NOT NULL").distinct()
    seen, frontier, found = seeds, seeds, None
    for i in range(1, depth + 1):
        hop = steps.join(frontier.select(F.col("koid").alias("at")), "at").groupBy("koid").agg(F.min("rel_type").alias("rel_type"))
        hop = hop.join(seen, "koid", "left_anti").select("koid", "rel_type", F.lit(i).alias("depth"))
        if i < depth:
            hop = materialize(hop, "traverse")
        found = hop if found is None else found.unionByName(hop)
        frontier = hop.select("koid")
        seen = seen.unionByName(frontier)
    return found
