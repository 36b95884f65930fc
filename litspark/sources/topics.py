"""Topic-word and topic-label tables: CSV edge in wide form, long form inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def topic_words_to_wide(long: DataFrame, n: int) -> DataFrame:
    """(topic_id, rank, term) → one row per topic with columns "0".."n-1"."""
    return (long.groupBy("topic_id").pivot("rank", list(range(n))).agg(F.first("term"))
                .select("topic_id", *[F.col(str(i)) for i in range(n)]))


def topic_words_to_long(wide: DataFrame, id_col: str = "topic_id") -> DataFrame:
    """Wide topic rows (one column per rank, named by the rank) → (topic_id, rank, term)."""
    rank_cols = [c for c in wide.columns if c != id_col]
    long = wide.unpivot([id_col], rank_cols, "rank", "term")
    return (long.filter(F.col("term").isNotNull())
                .select(F.col(id_col).cast("int").alias("topic_id"),
                        F.col("rank").cast("int").alias("rank"), "term"))


def _row_position(df: DataFrame) -> DataFrame:
    """0-based position of each row within its source file (read order).

    ``monotonically_increasing_id`` before any shuffle follows the file's row
    order; the ranking is per file, so no global single-partition window.
    """
    from pyspark.sql import Window
    w = Window.partitionBy("_file").orderBy("_o")
    return (df.withColumn("_file", F.col("_metadata.file_path"))
              .withColumn("_o", F.monotonically_increasing_id())
              .withColumn("topic_id", (F.row_number().over(w) - 1).cast("int"))
              .drop("_file", "_o"))


def read_topic_words(spark: SparkSession, path: str) -> DataFrame:
    """Read a topic-word CSV: header row of rank numbers, one row per topic.

    A ``topic_id`` column is used when present; otherwise the topic id is the
    row's position in its file.
    """
    raw = spark.read.option("header", True).csv(path)
    if "topic_id" not in raw.columns:
        raw = _row_position(raw)
    return topic_words_to_long(raw)


def write_topic_words(long: DataFrame, path: str, n: int) -> None:
    topic_words_to_wide(long, n).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_topic_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label CSV: either (topic_id, label) or a single label column in topic order."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if "topic_id" in raw.columns:
        return raw.select(F.col("topic_id").cast("int"), F.col(raw.columns[1]).alias("label"))
    first = raw.columns[0]
    return _row_position(raw).select("topic_id", F.col(first).alias("label"))
