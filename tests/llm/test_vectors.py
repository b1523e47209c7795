import numpy as np
from pyspark.sql import functions as F

from koengine.llm import ann


def brute(x, keys, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        for j in sorted(range(len(x)), key=lambda j: (-round(s[i, j], 9), keys[j]))[:k]:
            if s[i, j] >= least:
                out.add((min(keys[i], keys[j]), max(keys[i], keys[j])))
    return out


def clustered(n, dim, rng):
    base = rng.standard_normal((n // 3, dim))
    return np.concatenate([base, base + 0.15 * rng.standard_normal(base.shape), rng.standard_normal((n - 2 * (n // 3), dim))])


def test_recall_of_close_pairs(spark):
    rng = np.random.default_rng(1)
    x = clustered(2400, 24, rng).astype(np.float32)
    keys = [f"k{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(k, "m", v.tolist(), "clash") for k, v in zip(keys, x)], "key string, model string, vec array<float>, rid string")
    near, members = ann.similar_vectors(df, k=10, min_cosine=0.9, leaf_rows=64)
    got = {tuple(r) for r in ann.expand_copies(near, members, 10).collect()}
    want = brute(x.astype(np.float64), keys, 10, 0.9)
    assert len(got - want) == 0
    assert len(got & want) / len(want) >= 0.97


def test_recall_of_all_neighbours(spark):
    rng = np.random.default_rng(2)
    x = clustered(1500, 16, rng).astype(np.float32)
    df = spark.createDataFrame([(f"k{i:05d}", "m", v.tolist()) for i, v in enumerate(x)], "key string, model string, vec array<float>")
    near, members = ann.similar_vectors(df, k=10, leaf_rows=128, probes=16)
    key = {r["rid"]: r["key"] for r in members.collect()}
    got = {}
    for r in near.collect():
        got.setdefault(key[r["rid"]], set()).add(key[r["other"]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hits = sum(len(got.get(f"k{i:05d}", set()) & {f"k{j:05d}" for j in np.argsort(-s[i])[:10]}) for i in range(len(x)))
    assert hits / (10 * len(x)) >= 0.9


def test_dirty_rows_copies_and_models(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(f"c{i:02d}", "m", v) for i in range(30)] + [("c00", "m", v), ("d1", "m", [1.0, 2.0, 3.1]), ("o1", "other", v), ("o2", "other", [3.0, -1.0, 0.0])]
    rows += [("x1", "m", None), ("x2", "m", []), ("x3", "m", [1.0, 2.0]), ("x4", "m", [0.0, 0.0, 0.0]), ("x5", "m", [float("nan"), 1.0, 1.0]), ("x6", None, v), ("solo", "alone", v)]
    df = spark.createDataFrame(rows, "key string, model string, vec array<float>")
    near, members = ann.similar_vectors(df, k=10, min_cosine=0.9)
    got = {tuple(r) for r in ann.expand_copies(near, members, 10).collect()}
    assert all(a < b for a, b in got) and not any(k.startswith(("x", "o", "solo")) for p in got for k in p)
    # a group of copies gives at most k pairs a member, and each member has its ten
    deg = {k: sum(k in p for p in got) for k in [f"c{i:02d}" for i in range(30)]}
    assert min(deg.values()) >= 10 and len(got) <= 31 * 10
    assert any("d1" in p for p in got)


def test_empty(spark):
    df = spark.createDataFrame([], "key string, model string, vec array<float>")
    near, members = ann.similar_vectors(df)
    assert near.count() == 0 and members.count() == 0


def test_search_order_is_by_margin():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 8)).astype(np.float32)
    forest = [ann.fit_tree(x, 4, rng) for _ in range(3)]
    leaves, own = ann.search_forest(x, forest, 8)
    assert (own.sum(axis=1) == 3).all() and own[:, :3].all()  # own leaves first, one a tree
    assert all(len(set(r)) == 8 for r in leaves.tolist())  # no leaf twice


def test_latest_live(spark):
    df = spark.createDataFrame(
        [("a", 1, "active", ("m", [1.0])), ("a", 2, "deleted", ("m", [1.0])), ("b", 1, None, ("m", [1.0])), ("c", 2, "active", (None, [1.0])), ("d", 1, "active", None)],
        "koid string, version long, state string, semantic struct<embedding_model:string, embedding:array<float>>",
    )
    assert [r["koid"] for r in ann.latest_live(df).collect()] == ["b"]
    assert F is not None


def test_large_leaves_are_parted_again():
    import numpy as np
    import pyarrow as pa

    from koengine.llm import ann

    rng = np.random.default_rng(3)
    # 3,000 near-copies of one vector and 3,000 scattered ones in one leaf
    x = np.concatenate([np.ones((3000, 16)) + 1e-3 * rng.standard_normal((3000, 16)), rng.standard_normal((3000, 16))]).astype(np.float32)
    own = np.ones(len(x), dtype=bool)
    own[::3] = False  # visitors of other leaves
    parts = ann._sub_leaves(x, own, 500)
    members = np.concatenate([m for _, m in parts])
    assert sorted(members) == sorted(np.flatnonzero(own)) and max(len(m) for _, m in parts) <= 500
    assert set(np.concatenate([q for q, _ in parts])) == set(range(len(x)))
    codes = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127).astype(np.int8)
    t = pa.table({"rid": pa.array(np.arange(len(x))), "own": pa.array(own), "norm": pa.array(np.linalg.norm(codes.astype(np.float32), axis=1).astype(np.float32)), "code": [c.tobytes() for c in codes]})
    whole = ann._score_leaf(10, 10, 0.9, most=len(x))(None, t)
    cut = ann._score_leaf(10, 10, 0.9, most=500)(None, t)
    assert whole.num_rows <= 20 * len(x) and cut.num_rows <= 20 * 3 * len(x)


def test_forest_of_many_levels_keeps_its_recall(spark):
    """10 nearest at depth 11, against brute force."""
    import numpy as np

    from koengine.llm import ann

    rng = np.random.default_rng(4)
    centres = rng.standard_normal((400, 24))
    x = (centres[rng.integers(0, 400, 6000)] + 0.25 * rng.standard_normal((6000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, "m", v.tolist()) for i, v in enumerate(x)], "key long, model string, vec array<float>")
    near, members = ann.similar_vectors(df, k=10, leaf_rows=3, trees=6, probes=60)
    key = {r["rid"]: r["key"] for r in members.collect()}
    got = {}
    for r in near.collect():
        got.setdefault(key[r["rid"]], set()).add(key[r["other"]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for i in range(0, 6000, 50):
        sim = u @ u[i]
        sim[i] = -2
        hits += len(set(np.argsort(-sim)[:10].tolist()) & got.get(i, set()))
    assert hits >= 0.9 * 10 * 120
