"""A persisted search index: trigrams of the searched columns → row ids.

A posting is one trigram's ids within one block of ``2 ** BLOCK_BITS`` ids, as ascending
offsets, so a list is bounded however common its trigram is; Parquet stores their differences
(delta encoding). The table is sorted by trigram: a search reads the row groups of the
trigrams that it asks for.

A word's trigrams are intersected block by block, the rarest first. What is left are
candidates: they are looked up in the rows and tested for the word itself. A word of
fewer than three characters has no trigram and is searched in the rows, as without an index.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BITS = 16


def _grams(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), 1))


def word_grams(word: str) -> list[str]:
    return sorted({word[i: i + 3] for i in range(len(word) - 2)})


def build(df: DataFrame, path: str, id_col: str, cols: tuple[str, ...], partitions: int | None = None) -> None:
    """Write the postings of ``cols`` to ``path``; ``id_col`` is a whole number, one to a row. Rows with a null id are not found."""
    grams = F.array_distinct(F.flatten(F.array(*[F.coalesce(_grams(F.col(c)), F.array().cast("array<string>")) for c in cols])))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.explode(grams).alias("gram")).where("id is not null")
    blocks = rows.groupBy("gram", F.shiftright("id", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_set("id")).alias("ids"))
    offsets = F.transform("ids", lambda v: (v - F.shiftleft("block", BLOCK_BITS)).cast("int"))
    postings = blocks.select("gram", "block", F.size("ids").alias("n"), offsets.alias("offsets"))
    spread = postings.repartitionByRange(partitions, "gram", "block") if partitions else postings.repartitionByRange("gram", "block")
    spread.sortWithinPartitions("gram", "block").write.option("parquet.writer.version", "PARQUET_2_0").parquet(path)


def postings(spark: SparkSession, path: str, grams: list[str]) -> DataFrame:
    """(gram, block, n, offsets) of the asked trigrams only."""
    table = spark.read.schema("gram string, block long, n int, offsets array<int>").parquet(path)
    return table.where(F.col("gram").isin(grams))


def candidates(spark: SparkSession, path: str, word: str) -> DataFrame:
    """(id) of the rows that have every trigram of a lower-case word of three characters or more."""
    grams = word_grams(word)
    found = postings(spark, path, grams)
    # only blocks in which every trigram occurs; the shortest list first
    blocks = found.groupBy("block").agg(F.count("*").alias("k"), F.sort_array(F.collect_list(F.struct("n", "gram", "offsets"))).alias("lists"))
    blocks = blocks.where(F.col("k") == len(grams)).select("block", F.col("lists.offsets").alias("lists"))
    shared = F.aggregate("lists", F.element_at("lists", 1), lambda acc, ids: F.array_intersect(acc, ids))
    return blocks.select("block", F.explode(shared).alias("offset")).select((F.shiftleft("block", BLOCK_BITS) + F.col("offset")).alias("id"))


def search(df: DataFrame, path: str, query: str, id_col: str, cols: tuple[str, ...]) -> DataFrame:
    """The rows that ``stats.search`` finds, by the index; the empty query's and words' rules are the same."""
    if not query:
        return df
    words = sorted({w.lower() for w in query.split()})
    spark = df.sparkSession
    parts = []
    for word in words:
        hit = reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(word), F.lit(False)) for c in cols])
        rows = df if len(word) < 3 else df.join(candidates(spark, path, word).withColumnRenamed("id", id_col), id_col, "left_semi")
        parts.append(rows.where(hit).select(id_col))
    if not parts:
        return df.where(F.lit(False))
    found = reduce(lambda a, b: a.unionByName(b), parts).distinct()
    return df.join(found, id_col, "left_semi")
