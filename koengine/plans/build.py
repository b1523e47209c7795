"""Turns a logical plan into one lazy DataFrame; Catalyst does the rest.

Filters come before any top-k (a limit is never crossed by pushdown), property types are resolved
from the schema while building, and query-side data are literals.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from koengine.lang import logical as lp
from koengine.lang.diagnostics import UnknownType
from koengine.operators import graph, search
from koengine.sources.registry import Registry

Embedder = Callable[[str], list[float]]
_IDENTITY = ("koid", "type_name", "version")


def compare(df: DataFrame, c: lp.Compare, strict: bool = False) -> Column:
    """One comparison. A missing property or another type makes ``!=`` true and everything else false.

    Numbers of all widths compare with each other; with ``strict`` a number literal (always a float)
    equals only floats.
    """
    kind = df.schema[c.prop].dataType if c.prop in df.columns else None
    if kind is None:
        return F.lit(c.op == "!=")
    col, v = F.col(f"`{c.prop}`"), c.value
    if v is None:
        return {"==": col.isNull(), "!=": col.isNotNull()}.get(c.op, F.lit(False))
    if isinstance(v, bool):
        fits = isinstance(kind, T.BooleanType)
    elif isinstance(v, (int, float)):
        fits = isinstance(kind, (T.DoubleType, T.FloatType)) if strict and isinstance(v, float) else isinstance(kind, T.NumericType)
    else:
        fits = isinstance(kind, T.StringType)
    if not fits:
        return F.lit(c.op == "!=")
    # a whole number compares as one, so the filter reaches the scan on integer columns
    lit = F.lit(int(v)) if isinstance(v, float) and v.is_integer() and isinstance(kind, T.IntegralType) else F.lit(v)
    if c.op == "!=":
        return ~col.eqNullSafe(lit)
    return {"==": col == lit, ">": col > lit, "<": col < lit, ">=": col >= lit, "<=": col <= lit}[c.op]


def predicate(df: DataFrame, p: lp.Predicate, strict: bool = False) -> Column:
    if isinstance(p, lp.Both):
        return predicate(df, p.left, strict) & predicate(df, p.right, strict)
    if isinstance(p, lp.Either):
        return predicate(df, p.left, strict) | predicate(df, p.right, strict)
    return compare(df, p, strict)


def searchable_text(df: DataFrame) -> Column:
    """All text properties in name order."""
    cols = sorted(f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in _IDENTITY)
    return F.concat_ws(" ", *[F.col(f"`{c}`") for c in cols]) if cols else F.lit("")


class Builder:
    def __init__(self, registry: Registry, embed: Embedder | None = None, strict: bool = False):
        self.registry, self.embed, self.strict = registry, embed, strict

    def build(self, plan: lp.Plan) -> DataFrame:
        rows: DataFrame | None = None
        lists: dict[str, DataFrame] = {}
        scored = False
        for op in lp.check(plan).operators:
            if isinstance(op, lp.Scan):
                if not self.registry.known(op.type_name):
                    raise UnknownType(f"unknown type {op.type_name!r}")
                rows = self.registry.objects(op.type_name)
            elif isinstance(op, lp.Filter):
                rows = rows.where(predicate(rows, op.predicate, self.strict))
            elif isinstance(op, (lp.VectorSearch, lp.TextSearch)):
                lists["vector" if isinstance(op, lp.VectorSearch) else "text"] = self._search(rows, op)
                scored = True
            elif isinstance(op, lp.Fuse):
                lists = {"fused": self._fuse(lists, op)}
            elif isinstance(op, lp.Traverse):
                rows = self._traverse(rows, op)
            elif isinstance(op, lp.Project):
                if scored:
                    rows = self._attach(rows, next(reversed(lists.values())))
                    scored = False
                rows = self._project(rows, op)
        return rows

    def _search(self, rows: DataFrame, op) -> DataFrame:
        if isinstance(op, lp.TextSearch):
            text = searchable_text(rows)
            hit = search.bm25_search(rows, text, op.text, op.k) if op.scoring == "bm25" else search.text_search(rows, text, op.text, op.k)
            return hit.select("koid", "score")
        vec = list(op.vector) if op.vector is not None else (self.embed(op.text) if self.embed and op.text else None)
        if vec is None or "embedding" not in rows.columns:  # no provider: by words
            return search.text_search(rows, searchable_text(rows), op.text or "", op.k).select("koid", "score")
        if op.model is not None and "embedding_model" in rows.columns:
            rows = rows.where(F.col("embedding_model") == op.model)
        return search.vector_search(rows, F.col("embedding"), vec, op.k).select("koid", "score")

    def _fuse(self, lists: dict[str, DataFrame], op: lp.Fuse) -> DataFrame:
        a, b = lists.get("vector"), lists.get("text")
        if a is None or b is None or op.how in ("vector_only", "text_only"):
            only = a if op.how == "vector_only" or b is None else b
            return only if only is not None else (a if a is not None else b)
        k = 1_000_000_000
        if op.how == "weighted":
            return search.weighted(a, b, k, op.weight_vector, op.weight_text)
        return search.rrf(a, b, k, op.k0, op.rank_base)

    def _traverse(self, rows: DataFrame | None, op: lp.Traverse) -> DataFrame:
        spark = self.registry.spark
        if op.seeds:
            seeds = spark.createDataFrame([(s,) for s in op.seeds], "koid string")
        else:
            seeds = rows.select(F.concat_ws(":", "type_name", "koid").alias("koid"))
        return graph.traverse(self.registry.edges(), seeds, op.depth, op.rel_type, op.direction)

    @staticmethod
    def _attach(rows: DataFrame, scores: DataFrame) -> DataFrame:
        return rows.join(scores.select("koid", "score"), "koid")

    @staticmethod
    def _project(rows: DataFrame, op: lp.Project) -> DataFrame:
        """Named properties that exist; identity columns (and score or depth) always stay."""
        if not op.fields:
            return rows
        keep = [c for c in (*_IDENTITY, "score", "rel_type", "depth") if c in rows.columns]
        return rows.select(*keep, *[f"`{f}`" for f in dict.fromkeys(op.fields) if f in rows.columns and f not in keep])


def union_plans(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
