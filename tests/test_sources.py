import sqlite3

from pyspark.sql import functions as F

from koengine.operators import workspace
from koengine.sources import readers


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "a" / "x.md").write_text("one\n\nthree\n")
    (tmp_path / "b.rs").write_text("pub struct Foo;\nimpl Display for Foo {}\nuse std::fmt;\nfn go() {}\n")
    (tmp_path / ".git" / "y.md").write_text("no")
    (tmp_path / "z.bin").write_text("no")
    now = readers.read_directory(spark, str(tmp_path))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in now.collect()) == ["b.rs", "x.md"]
    before = now.withColumn("digest", F.when(F.col("ending") == "md", F.lit("old")).otherwise(F.col("digest"))).where("ending = 'md'")
    assert sorted(r["change"] for r in readers.changed_files(now, before).collect()) == ["added", "modified"]
    lines = readers.read_text_lines(spark, str(tmp_path / "a" / "x.md")).collect()
    assert [(r["line_number"], r["text"]) for r in lines] == [(1, "one"), (3, "three")]
    ents, rels = readers.rust_items(now)
    assert {(r["name"], r["kind"]) for r in ents.collect()} == {("Foo", "Struct"), ("go", "Function")}
    assert {(r["subject"], r["predicate"], r["object"]) for r in rels.collect()} == {("Foo", "implements", "Display"), ("b.rs", "depends_on", "std::fmt")}


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE item (id INTEGER PRIMARY KEY, name TEXT, price REAL)")
        c.executemany("INSERT INTO item VALUES (?, ?, ?)", [(i, f"n{i}", i / 2 if i % 3 else None) for i in range(1, 101)])
    df = readers.read_sqlite(spark, path, "item", "id")
    assert df.count() == 100 and df.where("price IS NULL").count() == 33
    first = df.where("id = 7").first()
    assert first["price"] == 3.5 and first["tags"] == ["source:sqlite"] and len(first["koid"]) == 32
    again = readers.read_sqlite(spark, path, "item", "id", partitions=1).where("id = 7").first()
    assert again["koid"] == first["koid"]


def test_ids_and_graph(spark):
    assert readers.fnv1a(b"") == 0xCBF29CE484222325 and readers.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    nodes = spark.createDataFrame([(1, "P"), (2, "Q")], "id long, label string")
    rel = spark.createDataFrame([(1, "knows", 2)], "start long, type string, end long")
    objects, edges = readers.read_graph_export(nodes, rel)
    ids = {r["id"]: r["koid"] for r in objects.collect()}
    assert [tuple(r) for r in edges.collect()] == [(ids[1], "knows", ids[2])]


def test_bridge_and_backup(spark, tmp_path):
    f = spark.createDataFrame([("shop", "orders", "id", "int", True, True), ("shop", "orders", "total", "double", False, False)], "label string, container string, field string, data_type string, is_key boolean, is_unique boolean")
    r = spark.createDataFrame([("orders", "customer", None)], "container string, target string, name string")
    e, facts, rel = readers.bridge_schema(f, r, "pg")
    assert e.first()["type_hint"] == "pgTable" and facts.count() == 4 and rel.first()["predicate"] == "references_customer"
    readers.save_backup({"j": spark.range(5).withColumnRenamed("id", "seq")}, str(tmp_path / "b"))
    assert readers.verify_backup(spark, str(tmp_path / "b"), ["j"]) == {"j": (5, 4)}
    assert [len(c) for c in readers.stream_rows(spark.range(7), 3)] == [3, 3, 1]


def test_workspace(spark, data):
    mem = spark.createDataFrame([("import lease", None, "x", 0, None), ("other", "lease lease", "y", 0, 5), ("none", None, None, 0, None)], "name string, description string, body string, commit_ts long, ttl long").withColumn("koid", F.col("name"))
    assert [r["name"] for r in workspace.memory_search(mem, "lease", 10).collect()] == ["import lease"]
    assert [r["name"] for r in workspace.memory_search(mem, "lease", 1).collect()] == ["import lease", "other"]
    au = spark.createDataFrame([("code",), ("agent",), ("canonical",)], "a string")
    assert sorted(r["a"] for r in workspace.authority_filter(au, "a", "test").collect()) == ["canonical", "code"]
    ko, j = spark.read.parquet(f"{data}/ko.parquet"), spark.read.parquet(f"{data}/journal.parquet")
    m = workspace.metrics(ko, j).first()
    assert m["live"] <= m["objects"] <= m["versions"]
    assert workspace.prove(j).first()["rows"] > 0
    k = ko.first()["koid"]
    assert workspace.explain(ko, j, k).count() == 1
    facts = spark.createDataFrame([("a holds", ["A"], 0.9), ("b holds", ["A", "B"], 0.5)], "statement string, entities array<string>, confidence double")
    ents = spark.createDataFrame([("A", "T"), ("B", None)], "name string, type_hint string")
    rels = spark.createDataFrame([("A", "uses", "B"), ("A", "tested_by", "t1")], "subject string, predicate string, object string")
    assert {(r["kind"], r["item"]) for r in workspace.explain_component(ents, facts, rels, "A").collect()} == {("fact", "a holds"), ("fact", "b holds"), ("dependency", "B"), ("test", "t1")}
    assert {r["name"]: r["markdown"] for r in workspace.render_markdown(ents, facts).collect()}["A"] == "## A (T)\n\n- a holds\n- b holds"
    assert workspace.validate_change(ents.withColumn("name", F.concat("name", F.lit("lpha"))), facts, "change Alpha now")["risk"] == "LOW"
    assert workspace.trace_requirement(spark.createDataFrame([("R", "decided_by", "D"), ("D", "realised_by", "C")], "subject string, predicate string, object string"), "R").count() == 2
    assert workspace.reason(spark.createDataFrame([("1", "fact", 5)], "koid string, type_name string, n int"), [("big", "n > 3"), ("small", "n < 3")]).count() == 1
