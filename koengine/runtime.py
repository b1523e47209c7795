"""Session helpers shared by every operator: tables, durable intermediate results, code shipping.

Long pipelines cut their lineage with :func:`materialize`, which writes a Parquet table in the
folder that the cluster names in ``spark.checkpoint.dir``. Unlike ``localCheckpoint`` the files
survive the loss of any executor, and unlike ``DataFrame.checkpoint`` the plan is computed once.
"""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}
_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; on one machine (``local`` masters) a temporary one where the session names none.

    On any other master a missing ``spark.checkpoint.dir`` is an error: executors do not share a temporary folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(?:\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir names no shared folder, and on {master} a temporary one would be each machine's own")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="koengine-")
        atexit.register(_remove, _OWN_DIR[app])
    return "file://" + _OWN_DIR[app]


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def _leave_nothing(spark: SparkSession, path: str) -> None:
    """The folder goes when the session ends, whatever file system it is on."""
    if path.startswith(("file:", "/")):
        atexit.register(_remove, path.removeprefix("file://"))
    else:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def materialize(df: DataFrame, name: str = "step", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: an executor-loss-proof lineage cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/koengine/{name}-{uuid.uuid4().hex}"
    _leave_nothing(spark, path)
    writer = df.write.option("compression", "zstd").mode("error")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # the schema is given, as an empty table has no files


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, so Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="koengine-code-")
    atexit.register(_remove, folder)
    out = os.path.join(folder, "koengine-code.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(out)  # copied to every executor by Spark
    _SHIPPED.add(sc.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores, if its scan has fewer: for few bytes that need much work a row."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df._jdf.queryExecution().toRdd().getNumPartitions() < want else df


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def local_session(app: str = "koengine", cores: str = "8", partitions: str = "8", memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
