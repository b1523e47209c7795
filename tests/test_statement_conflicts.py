from koengine.operators import knowledge as k


def test_opposed_and_ambiguous_statements(spark):
    rows = [
        ("planner", "the planner must push filters down"), ("planner", "the planner must not push filters down"), ("planner", "the planner must not push filters downwards"),
        ("cache", "the cache is enabled by default"), ("cache", "The cache is disabled by default"), ("cache", "sync writes are slow"), ("other", "the cache is disabled by default"),
        ("log", "one two three four five six seven"), ("log", "one two three four five six eight"), ("log", "must sing"), ("log", "a lease must not expire before noon"), (None, "x"), ("log", None),
    ]
    got = {tuple(r) for r in k.statement_conflicts(spark.createDataFrame(rows, "entity string, statement string")).collect()}
    push = ["the planner must push filters down", "the planner must not push filters down", "the planner must not push filters downwards"]
    two = lambda a, b: (min(a, b), max(a, b))
    assert got == {
        ("planner", *two(push[0], push[1]), "contradiction"), ("planner", *two(push[0], push[2]), "contradiction"), ("planner", *two(push[0], push[1]), "ambiguous"), ("planner", *two(push[1], push[2]), "ambiguous"),
        ("cache", *two(rows[3][1], rows[4][1]), "contradiction"), ("log", *two(rows[7][1], rows[8][1]), "ambiguous"),
    }
