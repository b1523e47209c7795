"""The session: queries, search, traversal, writes and admin over one data folder."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from koengine.lang import logical as lp
from koengine.lang.json_frontend import parse_json
from koengine.lang.parser import parse
from koengine.operators import graph, search, temporal, writes
from koengine.plans.build import Builder, Embedder
from koengine.sources.registry import Registry


class Session:
    """``Session(spark, folder).query('MATCH orders WHERE o_orderstatus == "F" RETURN *')``."""

    def __init__(self, spark: SparkSession, sf_dir: str, embed: Embedder | None = None, strict: bool = False):
        self.spark = spark
        self.registry = Registry(spark, sf_dir)
        self.builder = Builder(self.registry, embed, strict)
        self.programs: dict[str, str] = {}

    def query(self, source: str, **parameters: Any) -> DataFrame:
        """A text query; ``{{name}}`` stands for a parameter and is bound as a literal, never as text."""
        plan = parse(bind(source, parameters))
        if isinstance(plan, lp.Write):
            return writes.apply_write(self.registry, plan)
        df = self.builder.build(plan)
        if plan.explain:
            text = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            return self.spark.createDataFrame([("logical", repr(plan)), ("physical", text)], "stage string, plan string")
        return df

    def query_json(self, source: str | dict) -> DataFrame:
        return self.builder.build(parse_json(source))

    def deploy(self, name: str, source: str) -> None:
        """A stored query."""
        self.programs[name] = source

    def execute(self, name: str, **parameters: Any) -> DataFrame:
        return self.query(self.programs[name], **parameters)

    def execute_workflow(self, names: list[str], **parameters: Any) -> list[DataFrame]:
        return [self.execute(n, **parameters) for n in names]

    def create_view(self, name: str, source: str) -> None:
        self.query(source).createOrReplaceTempView(name)

    def find_similar(self, type_name: str, text: str | None = None, vector: list[float] | None = None, k: int = 10, how: str = "rrf", where: lp.Predicate | None = None) -> DataFrame:
        ops: list[Any] = [lp.Scan(type_name)]
        if where is not None:
            ops.append(lp.Filter(where))
        if vector is not None:
            ops.append(lp.VectorSearch(tuple(vector), None, None, k))
        if text is not None:
            ops.append(lp.TextSearch(text, k))
        if vector is not None and text is not None:
            ops.append(lp.Fuse(how, rank_base=0))
        return search.top(self.builder.build(lp.Plan((*ops, lp.Project(())))), k)

    def traverse(self, seeds: list[str], depth: int = 1, rel_type: str | None = None, direction: str = "out") -> DataFrame:
        return graph.traverse(self.registry.edges(), self.spark.createDataFrame([(s,) for s in seeds], "koid string"), depth, rel_type, direction)

    def get(self, type_name: str, koid: str) -> DataFrame:
        return self.registry.objects(type_name).where(F.col("koid") == koid)

    def list_types(self) -> list[str]:
        from koengine.sources.registry import KEYS

        return sorted({*KEYS, *self.registry.own})

    def trace(self, ko: DataFrame, journal: DataFrame, koid: str) -> tuple[DataFrame, DataFrame]:
        return temporal.lineage(ko, koid), temporal.events_of(journal, koid)


def bind(source: str, parameters: dict[str, Any]) -> str:
    """Parameters as literals of the query language; a string that would break out of its quotes is refused."""
    for name, value in parameters.items():
        if value is None or isinstance(value, bool):
            lit = {None: "null", True: "true", False: "false"}[value]
        elif isinstance(value, (int, float)):
            if value < 0:
                raise ValueError("the language has no negative literals")
            lit = repr(value)
        else:
            if '"' in str(value) or "\n" in str(value):
                raise ValueError(f"parameter {name!r} holds a quote or a line end")
            lit = f'"{value}"'
        source = source.replace("{{" + name + "}}", lit)
    return source
