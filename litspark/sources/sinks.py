"""Sinks: CSV with header (skipped when empty), JSON lines and trees of small files."""

from __future__ import annotations

import os
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.session import bound_batches, small_file_tasks


def _flatten_arrays(df: DataFrame) -> DataFrame:
    """CSV has no array type: token arrays are written space-joined."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            cols.append(F.array_join(f.name, " ").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _write_nonempty(spark: SparkSession, write, read, path: str, mode: str) -> bool:
    """``write`` once beside ``path`` and move it there if it holds a row. The frame
    is evaluated a single time: whether it was empty is seen from what was written."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    target, draft = jpath(path), jpath(f"{path.rstrip('/')}.draft-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if mode not in ("overwrite", "error", "errorifexists", "ignore"):
        raise ValueError(f"mode {mode!r}: a folder is written whole")
    if mode != "overwrite" and fs.exists(target):
        if mode == "ignore":
            return False
        raise FileExistsError(path)
    write(draft.toString())
    if read(draft.toString()).isEmpty():
        fs.delete(draft, True)
        return False
    fs.delete(target, True)
    fs.mkdirs(target.getParent())
    if not fs.rename(draft, target):
        raise OSError(f"cannot move the written files to {path}")
    return True


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """Write with a header, UTF-8, no index. Returns False (and writes nothing)
    when the frame is empty."""
    spark = df.sparkSession
    return _write_nonempty(
        spark, lambda p: _flatten_arrays(df).write.option("header", True).option("escape", '"').option("encoding", "UTF-8")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(p),
        lambda p: spark.read.option("header", True).schema("first string").option("enforceSchema", True).csv(p), path, mode)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """JSON lines; returns False (and writes nothing) when the frame is empty."""
    spark = df.sparkSession
    return _write_nonempty(spark, lambda p: df.write.json(p), spark.read.text, path, mode)


#: What Spark escapes in the folder names of a partitioned table, and its name for a missing value.
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _folder_name(keys: list[str], values: tuple) -> str:
    """The folder of a partitioned table for these values, as Spark names it."""
    return "/".join(f"{k}={_ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', v) if v else _NO_VALUE}" for k, v in zip(keys, values))


def _tree_writer(root: str, keys: list[str]):
    """Function of a partition's batches (keys as text, then the text) in the order of the keys: writes
    one file per key below ``root`` and tells how many. A file appears under its name when it is
    whole, so a task that is run again or twice leaves the same tree."""
    def write(batches):
        folder, draft, out, n = None, None, None, 0

        def finish():
            out.close()
            os.replace(draft, f"{folder}/part-00000.txt")

        try:
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                for *values, text in zip(*columns):
                    at = f"{root}/{_folder_name(keys, values)}"
                    if at != folder:
                        if out:
                            finish()
                        folder, draft = at, f"{at}/.{uuid.uuid4().hex}"
                        os.makedirs(folder, exist_ok=True)
                        out, n = open(draft, "wb"), n + 1
                    out.write((text or "").encode() + b"\n")
            if out:
                finish()
        finally:
            if out and os.path.exists(draft):
                out.close()
                os.remove(draft)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return write


def write_tree(df: DataFrame, path: str, keys: list[str], value: str = "value") -> None:
    """``value`` as text files below ``path``, one per folder ``key=../key=..``; rows of one folder are
    lines of its file. Small files cost by their number, so AQE does not merge the tasks by bytes.

    In a folder that the tasks reach as files (one shared by the machines) Python writes them. Hadoop's
    local file system starts a process for every file and folder it makes, and the driver moves
    each once more at the end. Other file systems are written by Spark."""
    spark = df.sparkSession
    # "" and null share a folder
    named = df.select(*[F.nullif(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys], value)
    dealt = named.repartition(small_file_tasks(spark), *keys)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    where = fs.makeQualified(target).toUri()
    if where.getScheme() != "file":
        dealt.write.partitionBy(*keys).format("text").save(path)
        return
    if fs.exists(target):
        raise FileExistsError(path)
    fs.mkdirs(target)
    bound_batches(spark)
    dealt.sortWithinPartitions(*keys, value).mapInArrow(_tree_writer(where.getPath(), keys), "n long").agg(F.sum("n")).collect()
