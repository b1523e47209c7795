"""Readers: files, folders, tables of other stores. All give plain DataFrames; ids are deterministic."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from koengine.runtime import ship_code

#: Folders and endings that a directory reader skips or takes by default.
SKIPPED_FOLDERS = (".git", "node_modules", "target", "__pycache__", ".venv", "dist", "build")
TEXT_ENDINGS = ("md", "txt", "rs", "py", "js", "ts", "go", "java", "toml", "json", "yaml", "yml", "html", "sql")


def row_id(table: Column | str, *key: Column) -> Column:
    """A 32-digit id of an imported row: its table and key hashed, the same on every import."""
    t = F.lit(table) if isinstance(table, str) else table
    return F.substring(F.sha2(F.concat_ws("/", t, *[k.cast("string") for k in key]), 256), 1, 32)


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv_id(text: Column) -> Column:
    """Hex of the 64-bit FNV-1a of a text, filled up to 32 digits."""

    @F.pandas_udf(T.StringType())
    def digest(batch: pd.Series) -> pd.Series:
        return batch.map(lambda s: None if s is None else f"{fnv1a(s.encode()):016x}" + "0" * 16)

    return digest(text)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_number, text) of every line that is not blank; numbers count blank lines."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    d = d.select("path", F.posexplode(F.split("value", "\r?\n")).alias("i", "text"))
    return d.where(F.col("text").rlike(r"\S")).select("path", (F.col("i") + 1).alias("line_number"), "text")


def read_directory(spark: SparkSession, root: str, endings: tuple[str, ...] = TEXT_ENDINGS, skipped: tuple[str, ...] = SKIPPED_FOLDERS) -> DataFrame:
    """(path, ending, modified, size, digest, text) of the text files under a folder."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    skip = "/(?:" + "|".join(s.replace(".", r"\.") for s in skipped) + ")/"
    d = d.where(ending.isin(*endings) & ~F.col("path").rlike(skip))
    return d.select("path", ending.alias("ending"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"), F.decode("content", "UTF-8").alias("text"))


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, change) between two reads: added, modified or removed, by path and digest."""
    b = before.select("path", F.col("digest").alias("old"))
    j = now.select("path", "digest").join(b, "path", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("digest").isNull(), "removed").when(F.col("old") != F.col("digest"), "modified")
    return j.select("path", change.alias("change")).where("change IS NOT NULL")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, options: dict[str, str] | None = None, parts: int = 1, bounds: tuple[int, int] | None = None) -> DataFrame:
    """A table of a relational store as objects, read in ranges of its key where bounds are given. The driver's jar must be there."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(options or {}))
    if bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return as_objects(r.load(), table, key, url.split(":")[1])


def as_objects(rows: DataFrame, type_name: str, key: str, origin: str) -> DataFrame:
    """Rows with koid, type_name, version and a source tag."""
    return rows.select(row_id(type_name, F.col(key)).alias("koid"), F.lit(type_name).alias("type_name"), F.lit(1).cast("long").alias("version"), F.array(F.lit(f"source:{origin}")).alias("tags"), "*")


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_table").option("path", file).option("table", name)``: ranges of rowid in parallel."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        kinds = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "FLOAT": "double", "NUMERIC": "double", "BLOB": "binary"}
        with sqlite3.connect(self.options["path"]) as c:
            cols = c.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        return ", ".join(f"`{n}` {kinds.get((t or '').upper().split('(')[0], 'string')}" for _, n, t, *_ in cols)

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table, self.parts = options["path"], _name(options["table"]), int(options.get("partitions", "4"))
        self.columns = [f.name for f in schema.fields]
        self.kinds = {f.name: f.dataType.typeName() for f in schema.fields}

    def partitions(self) -> list[_Range]:
        with sqlite3.connect(self.path) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        cols = ", ".join('"' + c.replace('"', '""') + '"' for c in self.columns)
        cast = [{"double": float, "long": int, "string": str, "binary": bytes}.get(self.kinds[c], lambda v: v) for c in self.columns]
        with sqlite3.connect(self.path) as c:
            for row in c.execute(f"SELECT {cols} FROM {self.table} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high)):
                yield tuple(None if v is None else k(v) for k, v in zip(cast, row))


def _name(table: str) -> str:
    return '"' + table.replace('"', '""') + '"'


def read_sqlite(spark: SparkSession, path: str, table: str, key: str, partitions: int = 4) -> DataFrame:
    ship_code(spark)
    spark.dataSource.register(SqliteSource)
    rows = spark.read.format("sqlite_table").option("path", path).option("table", table).option("partitions", partitions).load()
    return as_objects(rows, table, key, "sqlite")


def read_documents_export(spark: SparkSession, path: str, collection: str, key: str = "_id") -> DataFrame:
    """A JSON-lines export of a document store as objects."""
    return as_objects(spark.read.json(path), collection, key, "mongo")


def flat_keys(df: DataFrame) -> list[str]:
    """Dotted names of all nested fields, sorted."""
    def walk(kind, prefix: str) -> list[str]:
        if isinstance(kind, T.ArrayType):
            return walk(kind.elementType, prefix)
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in walk(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
        return [prefix]

    return sorted(set(walk(df.schema, "")))


def read_graph_export(nodes: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, edges) of a property graph's export: nodes (id, label, ...) and relationships (start, type, end)."""
    objects = nodes.select(row_id(F.col("label"), F.col("id")).alias("koid"), F.col("label").alias("type_name"), F.lit(1).cast("long").alias("version"), "*")
    ids = nodes.select("id", row_id(F.col("label"), F.col("id")).alias("koid"))
    e = relationships.join(ids.select(F.col("id").alias("start"), F.col("koid").alias("src")), "start").join(ids.select(F.col("id").alias("end"), F.col("koid").alias("dst")), "end")
    return objects, e.select("src", F.col("type").alias("rel_type"), "dst")


def bridge_schema(fields: DataFrame, references: DataFrame, connector: str, container_kind: str = "Table") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, facts, relations) of a store's schema.

    ``fields`` has (label, container, field, data_type, is_key, is_unique), ``references``
    (container, target, name).
    """
    name = F.concat_ws(".", "label", "container")
    entities = fields.select(name.alias("name"), F.lit(f"{connector}{container_kind}").alias("type_hint")).distinct()
    col = fields.select(F.concat(F.col("container"), F.lit(" has column "), F.col("field"), F.lit(" of type "), F.col("data_type")).alias("statement"))
    key = fields.where("is_key").select(F.concat(F.col("container"), F.lit(" has primary key "), F.col("field")).alias("statement"))
    uni = fields.where("is_unique").select(F.concat(F.col("field"), F.lit(" is unique in "), F.col("container")).alias("statement"))
    relations = references.select(F.col("container").alias("subject"), F.coalesce("name", F.concat(F.lit("references_"), F.col("target"))).alias("predicate"), F.col("target").alias("object"))
    return entities, col.unionByName(key).unionByName(uni).distinct(), relations


def rust_items(source: DataFrame, key: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of Rust files by their outer syntax: types, functions, constants; implements and depends_on."""
    def found(pattern: str, kind: str) -> DataFrame:
        return source.select(F.col(key), F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("name"), F.lit(kind).alias("kind"))

    lead = r"(?m)^\s*(?:pub(?:\([^)]*\))? )?"
    kinds = (("struct", "Struct"), ("enum", "Enum"), ("trait", "Trait"), ("mod", "Module"), ("const", "Constant"), ("type", "TypeAlias"))
    entities = found(lead + r"(?:async |unsafe |const )*fn (\w+)", "Function")
    for word, kind in kinds:
        entities = entities.unionByName(found(lead + word + r" (\w+)", kind))
    impl = source.select(F.col(key), F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?m)^\s*impl(?:<[^>]*>)? (\w+(?:<[^>]*>)? for \w+)"), F.lit(1))).alias("x"))
    impl = impl.select(key, F.regexp_extract("x", r"for (\w+)", 1).alias("subject"), F.lit("implements").alias("predicate"), F.regexp_extract("x", r"^(\w+)", 1).alias("object"))
    use = source.select(F.col(key), F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?m)^\s*(?:pub )?use ([\w:]+)"), F.lit(1))).alias("object"))
    use = use.select(key, F.regexp_extract(F.col(key), r"([^/]+)$", 1).alias("subject"), F.lit("depends_on").alias("predicate"), "object")
    return entities.distinct(), impl.unionByName(use).distinct()


def save_backup(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table as Parquet under a new folder."""
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{folder.rstrip('/')}/{name}")


def verify_backup(spark: SparkSession, folder: str, names: list[str], order: str = "seq") -> dict[str, tuple[int, int | None]]:
    """(rows, highest sequence number) of each table of a backup."""
    out = {}
    for n in names:
        df = spark.read.parquet(f"{folder.rstrip('/')}/{n}")
        r = df.agg(F.count("*").alias("n"), (F.max(order) if order in df.columns else F.lit(None).cast("long")).alias("m")).first()
        out[n] = (r["n"], r["m"])
    return out


def stream_rows(df: DataFrame, chunk: int = 100) -> Iterator[list[dict]]:
    """Rows in chunks, partition by partition; the driver holds one partition at a time."""
    part: list[dict] = []
    for row in df.toLocalIterator():
        part.append(row.asDict(recursive=True))
        if len(part) == chunk:
            yield part
            part = []
    if part:
        yield part


def to_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def json_properties(payload: Column) -> Column:
    """Top-level properties of a JSON object as a map of texts; null if it is none."""
    return F.from_json(payload, "map<string,string>")


