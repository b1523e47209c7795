"""Most similar vectors for every vector: a forest of random-projection trees.

Shape of the computation
------------------------
1. :func:`fit_forest` draws a bounded sample of each model's vectors to the driver (``SAMPLE_ROWS``)
   and fits ``trees`` projection trees on it: one random direction per level (so a vector needs
   ``trees * depth`` dot products, not one per node), one median threshold per node.
2. :func:`_assign` streams every row through the forest in vectorised blocks. All trees of a row
   share one priority queue, keyed by the worst margin crossed on the way; the best ``probes``
   leaves are popped. Own leaves (margin never crossed) come first, so every row is indexed in
   each tree and searches its nearest foreign leaves too.
3. Rows meet in their leaves, 8-bit codes only (one byte per dimension); the leaf scores queries
   against members in blocks and keeps the best ``k + slack`` per query, of those above
   ``min_cosine`` if that is given. A leaf of more than four times ``LEAF_ROWS`` members is parted
   again before (:func:`_sub_leaves`).
4. Candidate pairs are deduplicated and reranked exactly on the full vectors.

Identical vectors are collapsed to one representative before the forest sees them, so a group of
copies of any size costs one row; their members are given back by :func:`expand_copies`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from koengine.runtime import materialize, ship_code

SAMPLE_ROWS = 20_000
LEAF_ROWS = 1024
MAX_DEPTH = 14
#: Ids of surplus copies up to this many (8 bytes each) are broadcast; more are joined by shuffle.
MAX_BROADCAST_IDS = 500_000


def fit_tree(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Directions (depth, dim) and thresholds (2**depth - 1,) of one tree over the sample ``x``."""
    n, dim = x.shape
    dirs = rng.standard_normal((depth, dim)).astype(np.float32)
    if depth and n >= 2:  # half of the directions follow the data: differences of sampled points
        for level in range(0, depth, 2):
            a, b = rng.integers(0, n, 2)
            d = x[a] - x[b]
            if float(d @ d) > 1e-6:
                dirs[level] = d
    if depth:
        dirs /= np.linalg.norm(dirs, axis=1, keepdims=True)
    cuts = np.zeros(max(0, 2**depth - 1), dtype=np.float32)
    node = np.zeros(n, dtype=np.int64)
    for level in range(depth):
        p = x @ dirs[level]
        order = np.lexsort((p, node))
        starts = np.searchsorted(node[order], np.arange(2**level))
        ends = np.append(starts[1:], n)
        first = 2**level - 1
        for j in range(2**level):
            if ends[j] - starts[j] >= 2:
                cuts[first + j] = np.median(p[order[starts[j] : ends[j]]])
        node = 2 * node + (p > cuts[first + node])
    return dirs, cuts


def search_forest(x: np.ndarray, forest: list[tuple[np.ndarray, np.ndarray]], probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``probes`` best leaves of each row, over all trees, in order of their priority.

    Returns (tree * 2**depth + leaf, own) of shape (rows, probes): ``own`` marks the leaf the row
    itself lies in. Missing leaves are -1. One queue per row is shared by all trees; a popped node
    is followed down its near sides, and every far child passed is queued with the smaller of the
    node's priority and minus the margin, as in a best-bin-first search.
    """
    n, trees = len(x), len(forest)
    depth = forest[0][0].shape[0]
    proj = [x @ d.T for d, _ in forest]
    cap = trees + probes * max(depth, 1)
    prio = np.full((n, cap), -np.inf, dtype=np.float32)
    node = np.zeros((n, cap), dtype=np.int64)
    tree_of = np.zeros((n, cap), dtype=np.int16)
    prio[:, :trees] = np.inf
    tree_of[:, :trees] = np.arange(trees)
    used = trees
    rows = np.arange(n)
    leaves = np.full((n, probes), -1, dtype=np.int64)
    own = np.zeros((n, probes), dtype=bool)
    cuts = np.stack([c for _, c in forest]) if depth else np.zeros((trees, 0), np.float32)
    pr = np.stack(proj) if depth else np.zeros((trees, n, 0), np.float32)
    for k in range(probes):
        at = prio.argmax(axis=1)
        p, t, v = prio[rows, at].copy(), tree_of[rows, at].astype(np.int64), node[rows, at].copy()
        prio[rows, at] = -np.inf
        alive = p > -np.inf
        # nodes are numbered as in a heap: children of v are 2v+1 and 2v+2
        for _ in range(depth):
            level = np.floor(np.log2(v + 1)).astype(np.int64)
            inner = alive & (level < depth)
            lv = np.minimum(level, depth - 1)
            margin = pr[t, rows, lv] - cuts[t, np.minimum(v, cuts.shape[1] - 1)]
            right = margin > 0
            near = 2 * v + 1 + right
            far = 2 * v + 2 - right
            prio[:, used] = np.where(inner, np.minimum(p, -np.abs(margin)), -np.inf)
            node[:, used] = far
            tree_of[:, used] = t
            used += 1
            v = np.where(inner, near, v)
        leaves[:, k] = np.where(alive, t * 2**depth + (v - (2**depth - 1)), -1)
        own[:, k] = alive & np.isinf(p)
    return leaves, own


def usable_vectors(df: DataFrame, key: str, model: str, vector: str) -> DataFrame:
    """Rows (key, model, vec) whose vector is usable, with ``vec`` of unit length.

    Usable: model not null, vector not null, of the commonest length of its model, no null, NaN or
    infinite element, not all zero.
    """
    v = F.col(vector)
    d = df.select(F.col(key).alias("key"), F.col(model).alias("model"), v.alias("vec")).where(
        F.col("model").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
    )
    dims = (
        d.groupBy("model", F.size("vec").alias("dim")).count()
        .groupBy("model").agg(F.max_by("dim", F.struct("count", "dim")).alias("dim"))
    )
    d = d.join(dims, "model").where(F.size("vec") == F.col("dim")).select("key", "model", F.col("vec").cast("array<float>").alias("vec"))
    kinds = dict(d.dtypes)
    return d.mapInArrow(_unit_length, f"key {kinds['key']}, model string, vec array<float>")


def _unit_length(batches):
    """Vectors of unit length; those with a null, NaN or infinite element or without length are dropped."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        vec = b.column("vec")
        n = pc.list_value_length(vec).to_numpy()
        values = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
        if not len(n):
            continue
        ends = np.cumsum(n)
        with np.errstate(all="ignore"):
            square = np.add.reduceat(values * values, ends - n)
            ok = np.isfinite(square) & (square > 0)
            unit = (values / np.sqrt(np.repeat(square, n))).astype(np.float32)
        flat = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(unit, pa.float32()))
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("model"), flat], ["key", "model", "vec"]).filter(pa.array(ok))


def fit_forests(reps: DataFrame, counts: dict[str, int], trees: int, leaf_rows: int, sample_rows: int, seed: int) -> dict[str, list]:
    """One forest per model, fitted on the driver from at most ``sample_rows`` rows of each model."""
    total = sum(counts.values())
    forests: dict[str, list] = {}
    # a row is drawn by a hash of its key; the share follows each model's size
    share = F.lit(0.0)
    for m, n in counts.items():
        share = F.when(F.col("model") == m, F.lit(min(1.0, sample_rows / max(n, 1)))).otherwise(share)
    picked = reps.where(F.pmod(F.xxhash64("rid"), F.lit(1_000_003)) < share * F.lit(1_000_003)).select("model", "vec") if total else reps.select("model", "vec")
    got = picked.toPandas()
    for m, n in counts.items():
        x = np.array([np.asarray(v, dtype=np.float32) for v in got.loc[got["model"] == m, "vec"]], dtype=np.float32)
        depth = int(min(MAX_DEPTH, max(0, np.ceil(np.log2(max(n, 1) / leaf_rows)))))
        if len(x) < 2:
            depth = 0
        rng = np.random.default_rng([seed, len(m), *m.encode()[:16]])
        dim = x.shape[1] if len(x) else 1
        forests[m] = [fit_tree(x if len(x) else np.zeros((1, dim), np.float32), depth, rng) for _ in range(trees)] if depth else [(np.zeros((0, dim), np.float32), np.zeros(0, np.float32))]
    return forests


def _assign(reps: DataFrame, forests: dict[str, list], probes: int) -> DataFrame:
    """(model, leaf, rid, own, code): each row once for each leaf it searches."""
    packed = reps.sparkSession.sparkContext.broadcast(forests)  # bounded: 2**MAX_DEPTH thresholds a tree

    def run(batches):
        for pdf in batches:
            for m, g in pdf.groupby("model", sort=False):
                forest = packed.value[m]
                x = np.stack(g["vec"].to_numpy()).astype(np.float32)
                rid = g["rid"].to_numpy()
                scale = np.abs(x).max(axis=1, keepdims=True)
                codes = np.rint(x / scale * 127).astype(np.int8)
                back = codes.astype(np.float32)
                norm = np.linalg.norm(back, axis=1).astype(np.float32)
                for s in range(0, len(x), 4096):
                    e = min(s + 4096, len(x))
                    leaves, own = search_forest(x[s:e], forest, probes if len(forest[0][1]) else 1)
                    i, j = np.nonzero(leaves >= 0)
                    yield pd.DataFrame(
                        {
                            "model": m, "leaf": leaves[i, j], "rid": rid[s + i], "own": own[i, j],
                            "norm": norm[s + i], "code": [codes[s + a].tobytes() for a in i],
                        }
                    )

    return reps.select("model", "rid", "vec").mapInPandas(run, "model string, leaf long, rid long, own boolean, norm float, code binary")


def _sub_leaves(x: np.ndarray, own: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(queries, members) of a leaf's parts, each of at most ``most`` members: halves along the line through two members.

    A large leaf (a dense region, or more rows than the sampled tree could part) so costs rows times
    ``most`` products, not rows squared. Queries near a cut, a quarter of them, search both sides.
    """
    done, rng = [], np.random.default_rng(len(x))
    todo = [(np.arange(len(x)), np.flatnonzero(own))]
    while todo:
        queries, members = todo.pop()
        if not len(members) or not len(queries):
            continue
        if len(members) <= most:
            done.append((queries, members))
            continue
        a, b = rng.choice(members, 2, replace=False)
        line = x[a] - x[b]
        pm, pq = x[members] @ line, x[queries] @ line
        order = np.argsort(pm, kind="stable")  # halves of equal size, whatever is tied
        half = len(order) // 2
        cut = (pm[order[half - 1]] + pm[order[half]]) / 2
        near = np.abs(pq - cut) <= np.quantile(np.abs(pq - cut), 0.25)
        todo.append((queries[(pq <= cut) | near], members[order[:half]]))
        todo.append((queries[(pq > cut) | near], members[order[half:]]))
    return done


def _score_leaf(k: int, slack: int, min_cosine: float | None, most: int = 4 * LEAF_ROWS):
    keep = k + slack

    def run(key, table):
        import pyarrow as pa

        rid = table.column("rid").to_numpy()
        own = table.column("own").to_numpy(zero_copy_only=False)
        norm = table.column("norm").to_numpy()
        buf = table.column("code").combine_chunks()
        raw = b"".join(buf.to_pylist())
        x = np.frombuffer(raw, dtype=np.int8).reshape(len(rid), -1).astype(np.float32) / norm[:, None]
        out_q, out_m, out_s = [], [], []
        for queries, members in _sub_leaves(x, own, most):
            mid, qid, xq = rid[members], rid[queries], x[queries]
            step = max(1, 4_000_000 // len(members))
            for s in range(0, len(queries), step):
                sim = xq[s : s + step] @ x[members].T
                sim[qid[s : s + step][:, None] == mid[None, :]] = -2
                top = min(keep, sim.shape[1])
                j = np.argpartition(-sim, top - 1, axis=1)[:, :top].ravel()
                i = np.repeat(np.arange(len(sim)), top)
                ok = sim[i, j] > (-2 if min_cosine is None else min_cosine - 0.02)
                i, j = i[ok], j[ok]
                out_q.append(qid[s + i])
                out_m.append(mid[j])
                out_s.append(sim[i, j])
        q = np.concatenate(out_q) if out_q else np.zeros(0, np.int64)
        m = np.concatenate(out_m) if out_m else np.zeros(0, np.int64)
        sc = np.concatenate(out_s) if out_s else np.zeros(0, np.float32)
        return pa.table({"q": pa.array(q, pa.int64()), "m": pa.array(m, pa.int64()), "approx": pa.array(sc.astype(np.float32), pa.float32())})

    return run


def similar_vectors(
    df: DataFrame, key: str = "key", model: str = "model", vector: str = "vec", *, k: int = 10, min_cosine: float | None = None,
    trees: int = 3, probes: int = 8, leaf_rows: int = LEAF_ROWS, slack: int = 10, sample_rows: int = SAMPLE_ROWS, seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """The ``k`` most similar vectors of the same model for every vector of ``df``.

    Returns (neighbours, members). ``neighbours`` has (rid, other, cosine, rank) between
    representatives of distinct vectors, rank 1..k by descending cosine then ``other``; ``members``
    has (rid, key), all keys that hold the representative's vector. With ``min_cosine`` only
    neighbours of at least that cosine are searched and returned.

    Defined cases: unusable vectors (see :func:`usable_vectors`) take no part; an empty input gives
    two empty tables; a model with one vector gives no neighbours; equal keys count once; further
    columns of ``df`` are ignored whatever their names.
    """
    spark = df.sparkSession
    ship_code(spark)
    usable = usable_vectors(df, key, model, vector)
    # copies collapse by 128 bits of hash; rid is fixed by writing the table
    known = materialize(
        usable.select(F.monotonically_increasing_id().alias("rid"), "key", "model", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(7), F.col("vec")).alias("h2"), "vec"),
        "vectors",
    )
    groups = materialize(known.groupBy("model", "h1", "h2").agg(F.min("rid").alias("rep"), F.count("*").alias("copies")), "copy-groups")
    sizes = groups.groupBy("model").agg(F.count("*").alias("n"), F.sum("copies").alias("rows")).collect()  # a row for each model
    counts = {r["model"]: r["n"] for r in sizes}
    extra = sum(r["rows"] - r["n"] for r in sizes)
    members = known.select("model", "h1", "h2", "key").join(groups, ["model", "h1", "h2"]).select(F.col("rep").alias("rid"), "key").distinct()
    reps = known
    if extra:
        ids = known.select("model", "h1", "h2", "rid").join(groups.where("copies > 1"), ["model", "h1", "h2"]).where("rid <> rep").select("rid")
        reps = known.join(F.broadcast(ids) if extra <= MAX_BROADCAST_IDS else ids, "rid", "left_anti")
    reps = reps.select("rid", "model", "vec")
    forests = fit_forests(reps, counts, trees, leaf_rows, sample_rows, seed)
    placed = _assign(reps, forests, probes)
    hits = placed.groupBy("model", "leaf").applyInArrow(_score_leaf(k, slack, min_cosine), "q long, m long, approx float")
    pairs = hits.select(F.least("q", "m").alias("a"), F.greatest("q", "m").alias("b")).distinct()
    return _rerank(pairs, known, k, min_cosine), members


def _rerank(pairs: DataFrame, known: DataFrame, k: int, min_cosine: float | None) -> DataFrame:
    vec = known.select("rid", "vec")  # one exchange by rid serves both joins
    both = (
        pairs.join(vec.select(F.col("rid").alias("a"), F.col("vec").alias("va")), "a")
        .join(vec.select(F.col("rid").alias("b"), F.col("vec").alias("vb")), "b")
    )
    dot = F.aggregate(F.zip_with("va", "vb", lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, e: s + e)
    exact = both.select("a", "b", dot.alias("cosine"))
    if min_cosine is not None:
        exact = exact.where(F.col("cosine") >= min_cosine - 1e-7)
    ways = exact.select(F.explode(F.array(F.struct(F.col("a").alias("rid"), F.col("b").alias("other"), "cosine"), F.struct(F.col("b").alias("rid"), F.col("a").alias("other"), "cosine"))).alias("x")).select("x.*")
    best = W.partitionBy("rid").orderBy(F.desc("cosine"), "other")
    return ways.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def expand_copies(neighbours: DataFrame, members: DataFrame, k: int = 10) -> DataFrame:
    """Pairs (key_a < key_b) of which one is among the other's ``k`` most similar.

    Copies of one vector are each other's most similar (cosine 1, ties by key), then come the
    members of neighbouring vectors in order. Only the ``k + 1`` smallest keys of a group can be
    anyone's neighbours, so a group of g copies gives at most g * k pairs, not g squared.
    """
    rank = members.withColumn("i", F.row_number().over(W.partitionBy("rid").orderBy("key")))
    few = rank.where(F.col("i") <= k + 1).select(F.col("rid").alias("other"), F.col("key").alias("other_key"), "i")
    same = members.join(few, members["rid"] == few["other"]).select("rid", "key", "other_key", F.lit(0).alias("rank"), "i").where("key <> other_key")
    near = neighbours.select("rid", "other", "rank").join(few, "other").join(members, "rid").select("rid", "key", "other_key", "rank", "i")
    best = W.partitionBy("key").orderBy("rank", "i")
    chosen = same.unionByName(near).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    return chosen.select(F.least("key", "other_key").alias("key_a"), F.greatest("key", "other_key").alias("key_b")).distinct()


def latest_live(ko: DataFrame) -> DataFrame:
    """(koid, model, vec) of each object's row of highest version, if it is not deleted."""
    newest = ko.where("koid IS NOT NULL AND version IS NOT NULL").groupBy("koid").agg(F.max("version").alias("version"))
    live = ko.select("koid", "version", "state", F.col("semantic.embedding_model").alias("model"), F.col("semantic.embedding").alias("vec"))
    live = live.where(~F.coalesce(F.col("state"), F.lit("")).eqNullSafe("deleted") & F.col("model").isNotNull() & F.col("vec").isNotNull())
    return live.join(newest, ["koid", "version"], "left_semi").select("koid", "model", "vec")
