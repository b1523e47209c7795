"""Splitting oversized texts at natural boundaries, wholly in SQL expressions.

One bounded-quantifier pattern per size limit consumes the text from left to right. Its
alternatives are ordered by boundary strength (rest of the text, blank line, line end, sentence
end, clause end, white space, any character) and each takes at most the limit, so the first that
matches gives the piece; a boundary in the second half of the room comes before one in the first.
Overlap is given by lookback offsets: the pieces' lengths are summed with
array functions and every piece after the first starts ``overlap`` characters early.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Boundary tests, strongest first; each is a look-behind at the piece's end.
_BOUNDARIES = (
    r"(?<=\n\r?\n)",
    r"(?<=\n)",
    r"""(?<=[.!?…]["'”’»)\]]?\s|[。！？])""",
    r"(?<=[;:,]\s|[、，；：])",
    r"(?<=\s)",
)


def _pattern(limit: Column, overlap: Column) -> Column:
    """The pattern of one limit: the first piece may take ``limit``, later ones ``limit - overlap``."""

    def ways(most: Column, start: str) -> list[Column]:
        half = F.greatest(F.lit(1), F.floor(most / 2).cast("int"))
        span = F.format_string("{%d,%d}", half, most)
        out = [F.concat(F.lit(start + r"[\s\S]"), F.format_string("{1,%d}", most), F.lit(r"\z"))]
        out += [F.concat(F.lit(start + r"[\s\S]"), span, F.lit(b)) for b in _BOUNDARIES]
        # none in the second half: the last one of the first half, before words are cut
        out += [F.concat(F.lit(start + r"[\s\S]"), F.format_string("{1,%d}", half), F.lit(b)) for b in _BOUNDARIES]
        # fall back to characters, not between the two of a line end nor before a combining mark
        out += [F.concat(F.lit(start + r"[\s\S]"), span, F.lit(r"(?![\p{M}\x{200D}])(?<!\r(?=\n))"))]
        out += [F.concat(F.lit(start + r"[\s\S]"), F.format_string("{1,%d}", most))]
        return out

    return F.concat_ws("|", *ways(limit, r"\A"), *ways(limit - overlap, ""))


def split_oversized(df: DataFrame, limits: DataFrame, *, key: str, text: str, kind: str, default_kind: str = "Unknown") -> DataFrame:
    """Pieces (key, piece_no, start_at, n_chars, piece) of every text above the limit of its kind.

    ``limits`` has (block_type, max_chars, overlap_chars), a row for each kind; it is small by
    nature and broadcast only if Spark's own size estimate allows. Characters are code points.
    ``start_at`` counts from 0; piece n + 1 starts ``overlap_chars`` before the end of piece n, and
    no piece is longer than ``max_chars``. The pieces without their overlap concatenate to the text.

    Defined cases: null and empty texts and texts within the limit give no rows; a null kind counts
    as ``default_kind``; a kind without a limit is not split; an overlap of the limit or more
    counts as limit - 1; a limit below 1 or null splits nothing; repeated keys count once, by their
    largest text; further columns are ignored.
    """
    lim = limits.select(
        F.col("block_type").alias("k_"), F.col("max_chars").cast("int").alias("max_"), F.least(F.coalesce(F.col("overlap_chars"), F.lit(0)), F.col("max_chars") - 1).cast("int").alias("over_")
    ).where("max_ >= 1").withColumn("over_", F.greatest("over_", F.lit(0))).dropDuplicates(["k_"]).withColumn("pattern_", _pattern(F.col("max_"), F.col("over_")))
    d = df.select(F.col(key).alias("key_"), F.coalesce(F.col(kind), F.lit(default_kind)).alias("k_"), F.col(text).alias("text_"))
    big = d.join(lim, "k_").where(F.length("text_") > F.col("max_"))
    big = big.groupBy("key_").agg(F.max(F.struct("text_", "max_", "over_", "pattern_")).alias("x")).select("key_", "x.*")
    cores = big.withColumn("cores_", F.regexp_extract_all("text_", F.col("pattern_"), F.lit(0)))
    ends = F.aggregate(
        F.transform("cores_", F.length), F.array().cast("array<int>"),
        lambda acc, n: F.concat(acc, F.array(n + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))),
    )
    cut = cores.withColumn("ends_", ends)
    cut = cut.select("key_", "text_", "over_", "ends_", F.posexplode("cores_").alias("i_", "core_"))
    end = F.element_at("ends_", F.col("i_") + 1)
    start = F.greatest(F.lit(0), end - F.length("core_") - F.when(F.col("i_") > 0, F.col("over_")).otherwise(0))
    return cut.select(
        F.col("key_").alias(key), (F.col("i_") + 1).alias("piece_no"), start.cast("long").alias("start_at"), (end - start).cast("int").alias("n_chars"),
        F.col("text_").substr(start + 1, end - start).alias("piece"),
    )
