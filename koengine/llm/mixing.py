"""Mixing sources to target shares of the total size by a low-discrepancy schedule.

The mixture is a sequence of slots of equal size. Slot i asks for the source that the point
frac((i + 1) * golden ratio) hits on the line of cumulative shares, so every stretch of the
sequence holds the shares closely. The r-th slot of a source takes the r-th block of that source:
its records, shuffled by a seeded hash, repeated pass by pass up to the cap, cut into blocks of
equal tokens. Running token counts are summed in hash buckets, so that a source with a third of all
records is never ordered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from koengine.llm.tokens import TOKENIZER_DIR, count_column
from koengine.runtime import materialize

GOLDEN = (math.sqrt(5) - 1) / 2
BUCKETS = 256
#: Records of one source in a bucket, beyond which there are more buckets.
BUCKET_ROWS = 50_000


def with_sizes(df: DataFrame, *, key: str, source: str, text: str, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(key, source, n_tokens) of the records with at least one token, counted once and written."""
    d = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.col("t") != ""))
    sized = d.select("key", "source", count_column(d, F.col("t"), tokenizer_dir).alias("n_tokens"))
    return materialize(sized.groupBy("key").agg(F.max(F.struct("source", "n_tokens")).alias("x")).select("key", "x.*").where("source IS NOT NULL AND n_tokens > 0"), "sizes")


def plan_mixture(available: dict[str, int], targets: dict[str, tuple[float, int]], block_tokens: int | None) -> tuple[int, int, dict[str, int], list[tuple[str, float]]]:
    """(block size, slots, copies needed by source, cumulative shares) of the largest mixture.

    The mixture is as large as the caps allow: min over sources of tokens * max_repeats / share.
    A source with a share but no tokens is left out and the other shares are scaled up.
    """
    use = {s: (w, r) for s, (w, r) in targets.items() if w and w > 0 and r and r > 0 and available.get(s, 0) > 0}
    scale = sum(w for w, _ in use.values())
    if not use or not scale:
        return 1, 0, {}, []
    total = min(available[s] * r / (w / scale) for s, (w, r) in use.items())
    block = block_tokens or max(1, int(total // 20_000))
    # one slot of slack for each source keeps the schedule's rounding inside the caps
    slots = max(0, int(min((available[s] * r / block - 2) / (w / scale) for s, (w, r) in use.items())))
    need = {s: min(r, math.ceil((slots * w / scale + 2) * block / available[s])) for s, (w, r) in use.items()}
    at, line = 0.0, []
    for s in sorted(use):
        at += use[s][0] / scale
        line.append((s, at))
    line[-1] = (line[-1][0], 1.0)
    return block, slots, need, line


def mix_sources(sized: DataFrame, targets: DataFrame, *, block_tokens: int | None = None, seed: int = 11) -> DataFrame:
    """The mixture: (slot, source, key, copy_no, n_tokens), a row for each use of a record.

    ``targets`` has (source, target_share, max_repeats), a row for each source (read to the driver:
    it is as long as the list of sources). A record belongs to the block in which its first token
    lies and is used whole, at most ``max_repeats`` times, so each source's share differs from its
    target by less than a record and a slot. Without ``block_tokens`` the mixture has about 20,000
    slots.

    Defined cases: records without tokens or source, and sources without a target, are not used; a
    null or non-positive share or cap counts as none; a target without records is left out and the
    others are scaled up; ties in the shuffle are ordered by key; repeated keys count once.
    """
    spark = sized.sparkSession
    sums = sized.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).collect()  # a row for each source
    have = {r["source"]: r["n"] for r in sums}
    # a bucket is sorted in one task, so their number follows the largest source
    buckets = max(BUCKETS, -(-max((r["rows"] for r in sums), default=0) // BUCKET_ROWS))
    want = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.where("source IS NOT NULL").collect()}
    block, slots, need, line = plan_mixture(have, want, block_tokens)
    # schedule: point of each slot -> source -> rank of the slot within its source
    point = (F.col("i") + 1) * F.lit(GOLDEN) % 1.0
    pick = F.lit(None).cast("string")
    for s, upto in reversed(line):
        pick = F.when(F.col("point") < upto, F.lit(s)).otherwise(pick)
    schedule = spark.range(slots).select(F.col("id").alias("i")).withColumn("point", point).withColumn("source", pick)
    schedule = _ranked(schedule)
    # records, pass by pass, in seeded order, with the running count of tokens before them
    copies = F.lit(0)
    for s, n in need.items():
        copies = F.when(F.col("source") == s, F.lit(n)).otherwise(copies)
    uses = sized.withColumn("copy_no", F.explode(F.sequence(F.lit(0), copies - 1))) if need else sized.where("false").withColumn("copy_no", F.lit(0))
    uses = uses.where("copy_no >= 0").withColumn("h", F.xxhash64(F.lit(seed), "copy_no", "key")).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    totals = uses.groupBy("source", "copy_no", "bucket").agg(F.sum("n_tokens").alias("sum"))
    before = totals.withColumn("before", F.sum("sum").over(W.partitionBy("source").orderBy("copy_no", "bucket").rowsBetween(W.unboundedPreceding, -1)))
    inside = W.partitionBy("source", "copy_no", "bucket").orderBy("h", "key").rowsBetween(W.unboundedPreceding, -1)
    placed = uses.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(before.select("source", "copy_no", "bucket", "before"), ["source", "copy_no", "bucket"])
    placed = placed.withColumn("rank", F.floor((F.col("inside") + F.coalesce("before", F.lit(0))) / F.lit(block)).cast("long"))
    out = placed.join(schedule, ["source", "rank"])
    return out.select(F.col("i").alias("slot"), "source", "key", (F.col("copy_no") + 1).alias("copy_no"), "n_tokens")


def _ranked(schedule: DataFrame, stripe: int = 65_536) -> DataFrame:
    """Rank of each slot within its source, from 0, summed over stripes of slots."""
    d = schedule.withColumn("stripe", F.floor(F.col("i") / stripe))
    sums = d.groupBy("source", "stripe").agg(F.count("*").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("stripe").rowsBetween(W.unboundedPreceding, -1))).drop("n")
    inside = F.row_number().over(W.partitionBy("source", "stripe").orderBy("i")) - 1
    d = d.withColumn("inside", inside).join(before, ["source", "stripe"])
    return d.select("i", "source", (F.col("inside") + F.coalesce("before", F.lit(0))).cast("long").alias("rank"))


def share_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, uses, records, most_uses, max_repeats) of each target."""
    by_key = mixture.groupBy("source", "key").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("u"))
    got = by_key.groupBy("source").agg(F.sum("t").alias("tokens"), F.sum("u").alias("uses"), F.count("*").alias("records"), F.max("u").alias("most_uses"))
    whole = got.agg(F.sum("tokens").alias("all_tokens"))
    zero = F.lit(0).cast("long")
    return targets.select("source", "target_share", "max_repeats").join(got, "source", "left").crossJoin(F.broadcast(whole)).select(
        "source", "target_share", F.round(F.coalesce("tokens", zero) / F.col("all_tokens"), 6).alias("actual_share"), F.coalesce("tokens", zero).alias("tokens"),
        F.coalesce("uses", zero).alias("uses"), F.coalesce("records", zero).alias("records"), F.coalesce("most_uses", zero).alias("most_uses"), "max_repeats",
    )
