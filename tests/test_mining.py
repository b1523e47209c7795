import datetime

from koengine.operators import constraints as c


def test_every_column_is_mined(spark):
    at = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "a", 2.5, at, True), (2, "a", None, at, None), (3, None, 4.5, None, True)], "id long, word string, size double, at timestamp, flag boolean")
    got = {r["property"]: tuple(r)[1:] for r in c.mine(df).collect()}
    assert got == {"id": (3, 3, 3, 1.0, 3.0), "word": (3, 2, 1, None, None), "size": (3, 2, 2, 2.5, 4.5), "at": (3, 2, 1, None, None), "flag": (3, 2, 1, None, None)}
    assert {r["property"] for r in c.mine_range(c.mine(df)).collect()} == {"id", "size"}
    assert {r["property"] for r in c.mine_not_null(c.mine(df), 0.9).collect()} == {"id"}
