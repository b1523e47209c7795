"""Vector expressions and block-wise searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from koengine.runtime import materialize

#: Query vectors up to this many are broadcast; more are searched in blocks of this size.
BLOCK_QUERIES = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, e: s + e)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 if lengths differ, a vector is empty or all zero."""
    na, nb = dot(a, a), dot(b, b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (na == 0) | (nb == 0), 0.0).otherwise(F.coalesce(dot(a, b) / F.sqrt(na * nb), F.lit(0.0)))


def search_block(queries: DataFrame, rows: DataFrame, k: int | None, min_cosine: float | None, digits: int = 6) -> DataFrame:
    """(query_id, id, cosine) of a stated set of queries against all rows, in blocks, exactly.

    ``queries`` and ``rows`` have (id, vec). The queries are written once, then taken to the driver block by block
    (``BLOCK_QUERIES`` each) and broadcast; every partition keeps its best ``k`` for each query, so
    only ``k`` rows a query and partition are shuffled. A row is not its own neighbour. Rows whose
    vector is null, empty or of another length have cosine 0.
    """
    spark = rows.sparkSession
    total = queries.count()
    out = None
    if total > BLOCK_QUERIES:
        queries = materialize(queries.select("id", "vec"), "queries")
    numbered = queries if total <= BLOCK_QUERIES else queries.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(-(-total // (BLOCK_QUERIES // 2)))))
    blocks = [queries] if total <= BLOCK_QUERIES else [numbered.where(F.col("_block") == b).drop("_block") for b in range(-(-total // (BLOCK_QUERIES // 2)))]
    for block in blocks:
        pdf = block.select("id", "vec").toPandas()
        sent = spark.sparkContext.broadcast((pdf["id"].to_numpy(), [None if v is None else np.asarray(v, dtype=np.float64) for v in pdf["vec"]]))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            qid, qv = sent.value
            dims = {len(v) for v in qv if v is not None and len(v)}
            for b in batches:
                ids = b["id"].to_numpy()
                for dim in dims:
                    at = np.array([i for i, v in enumerate(qv) if v is not None and len(v) == dim])
                    q = np.stack([qv[i] for i in at])
                    rv = [i for i, v in enumerate(b["vec"]) if v is not None and len(v) == dim]
                    if not rv:
                        continue
                    x = np.stack([np.asarray(b["vec"].iloc[i], dtype=np.float64) for i in rv])
                    den = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
                    sim = np.divide(q @ x.T, den, out=np.zeros_like(den), where=den > 0)
                    sim = np.round(np.nan_to_num(sim), digits)
                    rid = ids[rv]
                    own = qid[at][:, None] == rid[None, :]
                    sim[own] = -2
                    if min_cosine is not None:
                        i, j = np.nonzero(sim >= min_cosine)
                    else:
                        # ties go to the smaller id, so order by both before cutting
                        order = np.lexsort((np.broadcast_to(rid, sim.shape), -sim), axis=1)[:, :k]
                        i, j = np.repeat(np.arange(len(at)), order.shape[1]), order.ravel()
                        ok = sim[i, j] > -2
                        i, j = i[ok], j[ok]
                    yield pd.DataFrame({"query_id": qid[at][i], "id": rid[j], "cosine": sim[i, j]})

        part = rows.select("id", "vec").mapInPandas(run, "query_id long, id long, cosine double")
        out = part if out is None else out.unionByName(part)
    if k is None:
        return out
    best = W.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
