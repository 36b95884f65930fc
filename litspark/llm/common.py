"""Helpers shared by the operators: shared-folder tables, Arrow batch bounds, word splitting."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.session import bound_batches, checkpoint_dir  # noqa: F401

_written: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def write_scratch(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and return the path."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return path


def materialise(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, lineage cut.
    The path is added to ``paths``, for a caller that removes the table later."""
    path = write_scratch(df, name)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in _written:
        _written.remove(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table this session wrote; call it when no result is read any more."""
    for path in list(_written):
        remove(spark, path)


def language_stratum(lang: Column) -> Column:
    """Two- or three-letter language code, or ``other``: at most 26² + 26³ + 1 values."""
    code = F.lower(lang)
    return F.when(code.rlike("^[a-z]{2,3}$"), code).otherwise(F.lit("other"))


def stratum_of(lang: str | None) -> str:
    """The same rule for one value."""
    code = (lang or "").lower()
    return code if re.fullmatch("[a-z]{2,3}", code) else "other"
