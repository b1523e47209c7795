import pytest

from koengine.operators import knowledge, security
from pyspark.sql import functions as F


def test_fields_are_sealed_by_tenant(spark):
    df = spark.createDataFrame([(1, "a", "secret one"), (2, "b", "secret two"), (3, "a", None)], "id long, tenant string, note string")
    keys = spark.createDataFrame([("a", bytearray(b"k" * 32)), ("b", bytearray(b"m" * 16))], "tenant string, key binary")
    sealed = security.encrypt_fields(df, ["note"], keys)
    shut = {r["id"]: r["note"] for r in sealed.collect()}
    assert shut[3] is None and "secret" not in shut[1] and shut[1] != shut[2]
    back = lambda d, k: {r["id"]: r["note"] for r in security.decrypt_fields(d, ["note"], k).collect()}
    assert back(sealed, keys) == {1: "secret one", 2: "secret two", 3: None}
    moved = sealed.withColumn("tenant", F.when(F.col("id") == 1, "b").otherwise(F.col("tenant")))
    assert back(moved, keys)[1] is None and back(sealed, keys.where("tenant = 'b'")) == {1: None, 2: "secret two", 3: None}
    with pytest.raises(Exception, match="no key for tenant"):
        security.encrypt_fields(df, ["note"], keys.where("tenant = 'b'")).collect()


def test_readable_rows(spark):
    df = spark.createDataFrame([(1, "t1", "ann", "doc"), (2, "t2", "ann", "doc"), (3, "t1", "bob", "doc"), (4, None, "bob", "note")], "id long, tenant string, owner string, type_name string")
    got = security.readable(df, security.Subject("ann", tenant="t1"), owner="owner", policies=[("*", "read", "note", "allow")])
    assert {r["id"] for r in got.collect()} == {1, 4}


def test_types_and_aliases_in_resolution(spark):
    kb = spark.createDataFrame([("k1", "Acme Works", "Organization", ["Acme"]), ("k2", "Acme Works Jr", "Person", None)], "koid string, name string, type_name string, aliases array<string>")
    names = spark.createDataFrame([("Acme", "Company"), ("Acme Works Jr", "Organization"), ("Acme Works Jr", None), (None, None), ("Zed", "Place")], "name string, type_hint string")
    got = {(r["name"], r["type_hint"]): (r["koid"], r["status"]) for r in knowledge.resolve_typed(names, kb).collect()}
    assert got["Acme", "Company"] == ("k1", "matched") and got["Acme Works Jr", "Organization"][0] == "k1" and got["Acme Works Jr", None][0] == "k2" and got["Zed", "Place"] == (None, "unmatched") and len(got) == 4
