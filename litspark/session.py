"""Spark session construction and cluster-safe scratch locations."""

from __future__ import annotations

import math
import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


#: Rows and bytes of one Arrow batch handed to Python, so that a batch of very
#: long texts stays small whatever the partition holds.
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20

_staged: list[str] = []


def get_spark(master: str | None = None, app_name: str = "litspark",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE and Arrow on and the UI off."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session (read when a plan is executed, so the bound stays
    for what the session runs later)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def small_file_tasks(spark: SparkSession) -> int:
    """Tasks for a job over many small files."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def scale_conf(input_bytes: int, total_cores: int, partition_bytes: int = 256 << 20,
               max_shuffle_partitions: int = 200_000) -> dict[str, str]:
    """Settings sized to the input: one scan split / shuffle partition per
    ``partition_bytes`` of input (at least two per core), AQE coalescing back to
    that size, and skew-join splitting for partitions several times larger.

    For 100 TB on 1000 executors × 8 cores this gives ~200k initial shuffle
    partitions that AQE merges to the advisory size; text-heavy stages (the
    explode-based counts) stay near 256 MB per task.
    """
    parts = min(max_shuffle_partitions, max(2 * total_cores, math.ceil(input_bytes / partition_bytes)))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(32 << 20),
    }


def dir_bytes(path: str) -> int:
    """Total size of the files below a local folder (bench and tests)."""
    total = 0
    for root, _, files in os.walk(path):
        total += sum(os.path.getsize(os.path.join(root, f)) for f in files)
    return total


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, registering it with the context.

    On a cluster ``spark.checkpoint.dir`` names a folder every executor can
    reach; it is read from the session and never replaced. Only a local-mode
    session without the setting (tests, the bench) gets a fresh temporary one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="litspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_removing: list = []
_removing_lock = threading.Lock()


@contextmanager
def shuffles_removed(spark: SparkSession):
    """What is executed inside removes its shuffle files when it ends. Otherwise they stay on disk until
    the driver happens to collect its garbage, those of every pass of a fit beside each other."""
    with _removing_lock:  # tables are staged from several threads
        if not _removing:
            _removing.append(spark.conf.get(_REMOVE_SHUFFLES, None))
            spark.conf.set(_REMOVE_SHUFFLES, "true")
        _removing.append(True)
    try:
        yield
    finally:
        with _removing_lock:
            _removing.pop()
            if len(_removing) == 1:
                before = _removing.pop()
                spark.conf.unset(_REMOVE_SHUFFLES) if before is None else spark.conf.set(_REMOVE_SHUFFLES, before)


def stage_table(df, name: str):
    """``df`` written as Parquet below the shared checkpoint folder and read back:
    computed once, lineage cut, readable by every executor. Its shuffle files go at once."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    _staged.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_table(df) -> None:
    """Delete the one table ``df`` reads, written by ``stage_table``; call it when no other plan reads it."""
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def drop_staged(spark: SparkSession) -> None:
    """Delete the tables ``stage_table`` wrote; call it when no result that reads them is left."""
    while _staged:
        _delete(spark, _staged.pop())
