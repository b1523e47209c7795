"""Scoring, ranking and fusion. Lists are (koid, score, ...) and ties go to the smaller koid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from koengine.functions.text import jaccard, token_list, tokens
from koengine.functions.vectors import cosine
from koengine.runtime import spread

DIGITS = 6


def top(df: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best rows: one TakeOrderedAndProject, no full sort."""
    return df.orderBy(F.desc(score), "koid").limit(k)


def _words(query: str) -> list[str]:
    """The query's distinct tokens, cut as the column expression cuts texts."""
    import regex

    return list(dict.fromkeys(w for w in regex.split(r"[^\p{L}\p{N}]+", query.lower()) if w))


def text_search(df: DataFrame, text: Column, query: str, k: int, include_zero: bool = True) -> DataFrame:
    """Jaccard of token sets; with ``include_zero`` the k best of everything, else only rows that share a token."""
    q = F.array(*[F.lit(w) for w in _words(query)]).cast("array<string>")
    scored = spread(df).withColumn("score", F.round(jaccard(tokens(F.coalesce(text, F.lit(""))), q), DIGITS))
    return top(scored if include_zero else scored.where("score > 0"), k)


def bm25_search(df: DataFrame, text: Column, query: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 over token sets (a term counts once a text) of the given rows; rows without a query term are left out.

    One pass gives the number of texts, the mean length and each query term's document frequency;
    a second scores. Nothing but those few numbers leaves the executors.
    """
    words = _words(query)
    d = spread(df).withColumn("_t", tokens(F.coalesce(text, F.lit(""))))
    stats = d.agg(F.count("*").alias("n"), F.avg(F.size("_t")).alias("len"), *[F.count_if(F.array_contains("_t", w)).alias(f"w{i}") for i, w in enumerate(words)])
    d = d.crossJoin(F.broadcast(stats))  # a single row
    norm = F.lit(k1) * (1 - b + b * F.size("_t") / F.col("len"))
    total: Column = F.lit(0.0)
    for i, w in enumerate(words):
        idf = F.log(1 + (F.col("n") - F.col(f"w{i}") + 0.5) / (F.col(f"w{i}") + 0.5))
        total = total + F.when(F.array_contains("_t", w), idf * (k1 + 1) / (1 + norm)).otherwise(0.0)
    scored = d.withColumn("score", F.round(total, DIGITS)).where("score > 0").drop("_t", "n", "len", *[f"w{i}" for i in range(len(words))])
    return top(scored, k)


def token_index(df: DataFrame, text: Column) -> DataFrame:
    """(token, koid, size): the inverted table of texts, to be kept (written by token, grown by ``streaming.cdc.maintain``)."""
    return spread(df).select("koid", tokens(F.coalesce(text, F.lit(""))).alias("t")).select(F.explode("t").alias("token"), "koid", F.size("t").alias("size"))


def indexed_search(index: DataFrame, query: str, k: int) -> DataFrame:
    """(koid, score): the k best by Jaccard of token sets from the inverted table; only the query's tokens are read."""
    words = _words(query)
    hits = index.where(F.col("token").isin(*words)).groupBy("koid").agg(F.count("*").alias("shared"), F.max("size").alias("size"))
    return top(hits.select("koid", F.round(F.col("shared") / (F.col("size") + len(words) - F.col("shared")), DIGITS).alias("score")), k)


def vector_search(df: DataFrame, vec: Column, query: list[float], k: int) -> DataFrame:
    """Cosine against one vector; rows without a vector are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return top(df.where(vec.isNotNull() & (F.size(vec) > 0)).withColumn("score", F.round(cosine(vec, q), DIGITS)), k)


def ranked(df: DataFrame, base: int) -> DataFrame:
    """(koid, score, rank) of the rows with a positive score; ``df`` is a list already cut to k."""
    return df.where("score > 0").select("koid", "score").withColumn("rank", (F.row_number().over(W.orderBy(F.desc("score"), "koid")) - 1 + base).cast("int"))


def rrf(a: DataFrame, b: DataFrame, k: int, k0: int = 60, rank_base: int = 1) -> DataFrame:
    """Reciprocal rank fusion: the sum over lists of 1 / (k0 + 1 + rank), ranks from ``rank_base``.

    The two published variants are rank_base 1 (lists cut to k) and 0 (all candidates).
    """
    x = ranked(a, rank_base).select("koid", (1 / (F.lit(k0 + 1) + F.col("rank"))).alias("sa"))
    y = ranked(b, rank_base).select("koid", (1 / (F.lit(k0 + 1) + F.col("rank"))).alias("sb"))
    both = x.join(y, "koid", "full_outer").select("koid", F.round(F.coalesce("sa", F.lit(0.0)) + F.coalesce("sb", F.lit(0.0)), 9).alias("score"))
    return top(both, k)


def weighted(a: DataFrame, b: DataFrame, k: int, wa: float = 0.5, wb: float = 0.5) -> DataFrame:
    """Weighted sum of two lists' scores; a row missing from a list scores 0 there."""
    both = a.select("koid", F.col("score").alias("sa")).join(b.select("koid", F.col("score").alias("sb")), "koid", "full_outer")
    return top(both.select("koid", F.round(wa * F.coalesce("sa", F.lit(0.0)) + wb * F.coalesce("sb", F.lit(0.0)), DIGITS + 1).alias("score")), k)


def predict(similar: DataFrame, properties: list[str]) -> DataFrame:
    """(property, value, support): each property's value in the best row that has one, and how many rows have one."""
    s = similar.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "koid")))
    pairs = F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).cast("string").alias("value")) for p in properties])
    return s.select("rank", F.explode(pairs).alias("x")).where("x.value IS NOT NULL").groupBy("x.property").agg(F.min_by("x.value", "rank").alias("value"), F.count("*").alias("support"))


def weighted_tokens(df: DataFrame, fields: dict[str, float], query: str, k: int) -> DataFrame:
    """Share of the query's tokens found in each field, weighted by field; rows above 0."""
    words = _words(query)
    q = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    total: Column = F.lit(0.0)
    for f, w in fields.items():
        total = total + F.lit(w) * F.size(F.array_intersect(q, tokens(F.coalesce(F.col(f), F.lit(""))))) / len(words)
    return top(df.withColumn("score", F.round(total, DIGITS)).where("score > 0"), k)


def token_candidates(df: DataFrame, text: Column, queries: DataFrame) -> DataFrame:
    """(query_id, koid, shared): rows that share at least one token with a query, through an inverted join.

    ``queries`` has (query_id, text). The join is on tokens, the sum of shared tokens is reduced
    map-side; nothing is compared that shares no token.
    """
    q = queries.select("query_id", F.explode(tokens(F.coalesce("text", F.lit("")))).alias("token"))
    d = df.select("koid", F.explode(tokens(F.coalesce(text, F.lit("")))).alias("token"))
    return d.join(q, "token").groupBy("query_id", "koid").agg(F.count("*").alias("shared"))


def token_count(text: Column) -> Column:
    return F.size(token_list(text))
