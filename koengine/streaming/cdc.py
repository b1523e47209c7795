"""Change data capture over the journal with Structured Streaming.

Subscriptions are streaming queries: the checkpoint is the acknowledged position, a filter is pushed
into the stream, and a restart replays from the checkpoint. ``availableNow`` drains what is there.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from koengine.operators.changes import kind_code
from koengine.runtime import shared_dir


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def journal_stream(spark: SparkSession, path: str, kinds: tuple[str, ...] | None = None, koid: str | None = None, files_a_batch: int = 8) -> DataFrame:
    """The journal as a stream, filtered by kind (in any spelling) and object. Nothing is read twice after a restart from a checkpoint."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    if not _is_folder(spark, path):  # a stream reads folders: of this one, the file alone
        folder, _, name = path.rpartition("/")
        reader, path = reader.option("pathGlobFilter", name), folder
    s = reader.parquet(path)
    if koid is not None:
        s = s.where(F.col("koid") == koid)
    return s.where(kind_code(F.col("kind")).isin(*[re.sub("[^a-z]", "", k.lower()) for k in kinds])) if kinds else s


def subscribe(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a subscription's events to a Parquet table, exactly once, until the source is drained."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def drain(stream: DataFrame) -> DataFrame:
    """All events of a stream so far, as a table in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/koengine/stream-{uuid.uuid4().hex}"
    subscribe(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def maintain(stream: DataFrame, fold: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A state kept by ``foreachBatch``: each micro-batch is folded and appended as a part, parts are merged on read.

    ``fold`` reduces a batch (map-side), ``merge`` reduces the union of parts; both must be
    idempotent, so a batch replayed after a failure changes nothing (its part is overwritten).
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/koengine/index-{uuid.uuid4().hex}"

    def apply(batch: DataFrame, epoch: int) -> None:
        fold(batch).write.mode("overwrite").parquet(f"{base}/parts/epoch={epoch}")

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return merge(spark.read.parquet(f"{base}/parts"))


def fire_triggers(stream: DataFrame, triggers: DataFrame) -> DataFrame:
    """(seq, koid, program) of every event that a trigger (event_kind, type_filter, program) wants: a stream-static join.

    ``triggers`` is a list of definitions kept by hand. A null type filter fits all.
    """
    e = stream.withColumn("code", kind_code(F.col("kind")))
    t = triggers.withColumn("code", kind_code(F.col("event_kind")))
    hit = e.join(t, "code")
    if "type_name" in stream.columns:
        hit = hit.where(F.col("type_filter").isNull() | F.col("type_filter").eqNullSafe(F.col("type_name")))
    return hit.select("seq", "koid", "program")


def index_lag(journal: DataFrame, processed: int) -> DataFrame:
    """Events committed but not yet processed."""
    return journal.agg((F.max("seq") - F.lit(processed)).alias("behind"))


__all__ = ["drain", "fire_triggers", "index_lag", "journal_stream", "maintain", "subscribe"]
