"""Queries that must reach all of their input."""

from koengine import catalog


def test_candidates_of_every_entry(spark, data):
    from koengine.runtime import table

    got = catalog.QUERIES["text_inverted_candidates"](spark, data)
    kinds = {r["type_name"] for r in got.join(table(spark, data, "kb_entry").selectExpr("koid AS query_id", "type_name"), "query_id").select("type_name").distinct().collect()}
    assert kinds > {"Person"}
    assert {r["e"] for r in got.selectExpr("substring(query_id, -1, 1) AS e").distinct().collect()} > {"0"}
    assert got.where("shared = 1").count() > 0


def test_traversal_starts_from_every_order(spark, data):
    from koengine.runtime import table

    buyers = {f"customer:{r['o_custkey']}" for r in table(spark, data, "orders").select("o_custkey").where("o_custkey IS NOT NULL").distinct().collect()}
    for depth in (1, 2, 3):
        got = catalog.QUERIES[f"traverse_depth{depth}"](spark, data)
        assert {r["koid"] for r in got.where("depth = 1").collect()} == buyers
