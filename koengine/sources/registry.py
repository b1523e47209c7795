"""Types, edges and ontology of a data folder: typed views with native columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from koengine.runtime import table

#: Key column of each table that is a type of its own.
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "documents": "doc_id", "embeddings": "vec_id", "events": "event_id",
}
#: Edges by foreign key: (source table, source key, relation, target table, foreign key).
LINKS = (
    ("nation", "n_nationkey", "in_region", "region", "n_regionkey"),
    ("customer", "c_custkey", "in_nation", "nation", "c_nationkey"),
    ("supplier", "s_suppkey", "in_nation", "nation", "s_nationkey"),
    ("orders", "o_orderkey", "placed_by", "customer", "o_custkey"),
)
#: Ontology: class -> physical types.
CLASSES = {"Party": ("customer", "supplier"), "Place": ("nation", "region")}


def edges(spark: SparkSession, sf_dir: str, links=LINKS) -> DataFrame:
    """(src, rel_type, dst): node ids are ``type:key``."""
    parts = [
        table(spark, sf_dir, t).where(F.col(fk).isNotNull()).select(F.concat(F.lit(f"{t}:"), F.col(k)).alias("src"), F.lit(rel).alias("rel_type"), F.concat(F.lit(f"{to}:"), F.col(fk)).alias("dst"))
        for t, k, rel, to, fk in links
    ]
    return reduce(DataFrame.unionByName, parts)


class Registry:
    """Types by name; each is a lazy DataFrame with koid, type_name, version and its own columns."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.own: dict[str, Callable[[], DataFrame]] = {}
        self.classes = dict(CLASSES)

    def register(self, name: str, df: DataFrame) -> None:
        """A type of its own; ``df`` has at least koid."""
        self.own[name] = lambda: df

    def physical(self, name: str) -> tuple[str, ...]:
        """Physical types of a name: itself, or those of its class."""
        return self.classes.get(name, (name,))

    def known(self, name: str) -> bool:
        return all(p in self.own or p in KEYS for p in self.physical(name))

    def objects(self, name: str) -> DataFrame:
        parts = []
        for p in self.physical(name):
            if p in self.own:
                parts.append(self.own[p]())
            else:
                t = table(self.spark, self.sf_dir, p)
                parts.append(t.select(F.col(KEYS[p]).cast("string").alias("koid"), F.lit(p).alias("type_name"), F.lit(1).cast("long").alias("version"), "*"))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def edges(self) -> DataFrame:
        return edges(self.spark, self.sf_dir)
