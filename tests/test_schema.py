import pytest

from koengine.operators import schema, search, temporal
from koengine.runtime import shared_dir, spread
from koengine.streaming import cdc
from pyspark.sql import functions as F


class _Fake:
    """A session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master, applicationId = "spark://head:7077", "app-1"


def test_no_machine_local_folder_on_a_cluster():
    for master in ("spark://head:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        _Fake.sparkContext.master = master
        with pytest.raises(RuntimeError):
            shared_dir(_Fake)
    _Fake.conf.get = staticmethod(lambda key, default=None: "hdfs://x/shared/")
    assert shared_dir(_Fake) == "hdfs://x/shared"


def test_kinds_in_any_spelling(spark, tmp_path):
    rows = [(1, "k", "LIFECYCLE_CHANGED"), (2, "k", "LifecycleChanged"), (3, "k", "Created"), (4, "k", None)]
    spark.createDataFrame(rows, "seq long, koid string, kind string").write.parquet(str(tmp_path / "j"))
    for wanted in ("LIFECYCLE_CHANGED", "lifecyclechanged", "Lifecycle-Changed"):
        got = cdc.drain(cdc.journal_stream(spark, str(tmp_path / "j"), (wanted,)))
        assert {r["seq"] for r in got.collect()} == {1, 2}


def _sealed(spark):
    rows = [(i, f"k{i % 3}", i, "Created", 1000 + i, f"p{i}" if i != 2 else None, None, "a|b" if i % 2 else None, "7:x") for i in range(1, 7)]
    return temporal.seal(spark.createDataFrame(rows, "seq long, koid string, version long, kind string, commit_ts long, payload string, signature string, actor string, note string"))


def test_prove_recomputes_every_hash(spark):
    j = _sealed(spark)
    status = lambda d: {r["seq"]: r["status"] for r in temporal.prove(d).collect()}
    assert set(status(j).values()) == {"ok"}
    changed = j.withColumn("payload", F.when(F.col("seq") == 3, "other").otherwise(F.col("payload")))
    assert {k: v for k, v in status(changed).items() if v != "ok"} == {3: "payload"}
    actor = j.withColumn("actor", F.when(F.col("seq") == 4, "someone").otherwise(F.col("actor")))
    assert {k: v for k, v in status(actor).items() if v != "ok"} == {4: "hash"}
    both = changed.withColumn("payload_hash", F.sha2(F.coalesce("payload", F.lit("")).cast("binary"), 256))
    assert {k: v for k, v in status(both).items() if v != "ok"} == {3: "hash"}
    assert status(j.where("seq <> 3")) == {1: "ok", 2: "ok", 4: "gap", 5: "ok", 6: "ok"}


def test_short_names_are_compared(spark):
    from koengine.operators.knowledge import resolve

    kb = spark.createDataFrame([("k1", "abc"), ("k2", "xyz")], "koid string, name string")
    got = {r["name"]: (r["koid"], r["status"]) for r in resolve(spark.createDataFrame([("ab",), ("q",)], "name string"), kb).collect()}
    assert got == {"ab": ("k1", "matched"), "q": (None, "unmatched")}


def test_types_and_closed_world(spark):
    v = spark.createDataFrame([(1, "P", "born", "1990-01-02"), (2, "P", "born", "soon"), (3, "P", "hat", "x"), (4, "Q", "born", "soon"), (5, "P", "born", None)], "id long, type_name string, k string, v string")
    got = lambda closed: {(r["id"], r["reason"]) for r in schema.type_check(v, {"P": {"born": "Date"}}, key="id", closed=closed).collect()}
    assert got(False) == {(2, "type")} and got(True) == {(2, "type"), (3, "undeclared")}


def test_ancestors_end_in_cycles(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), (None, "z")], "class string, parent string")
    got = {(r["class"], r["ancestor"]): r["steps"] for r in schema.ancestors(p).collect()}
    assert got["a", "c"] == 2 and got["c", "b"] == 2 and got["a", "a"] == 0 and got["x", "y"] == 1 and ("y", "x") not in got
    long = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(20)], "class string, parent string")
    assert schema.ancestors(long).where("class = 'c0' AND ancestor = 'c20'").first()["steps"] == 20
    rows = spark.createDataFrame([("a", "c"), ("x", "a"), ("m", "m")], "t string, w string")
    assert {r["t"] for r in schema.is_subclass(rows, "t", "w", schema.ancestors(p)).collect()} == {"a", "m"}


def test_domain_and_range(spark):
    up = schema.ancestors(spark.createDataFrame([("Manager", "Person")], "class string, parent string"))
    nodes = spark.createDataFrame([("m", "Manager"), ("f", "Firm"), ("p", "Person")], "koid string, type_name string")
    e = spark.createDataFrame([("m", "works_at", "f"), ("f", "works_at", "p"), ("p", "likes", "f")], "src string, rel_type string, dst string")
    rules = spark.createDataFrame([("works_at", "Person", "Firm")], "rel_type string, domain string, range string")
    assert {tuple(r) for r in schema.relation_violations(e, nodes, rules, up).collect()} == {("f", "works_at", "p", "domain"), ("f", "works_at", "p", "range")}


def test_inverted_table_gives_the_same_list(spark):
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(["red blue", "red red green", None, "", "blue", "violet"])], "koid string, text string")
    plain = search.text_search(d, F.col("text"), "Red, blue!", 5, include_zero=False)
    assert [tuple(r) for r in search.indexed_search(search.token_index(d, F.col("text")), "Red, blue!", 5).collect()] == [(r["koid"], r["score"]) for r in plain.collect()]
    assert spread(d.limit(0)).count() == 0
