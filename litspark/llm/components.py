"""Connected components of an edge list by alternating large-star and small-star rounds.

Neighbour minima come from ``groupBy().min()`` (combined before the shuffle) and
are joined back, so that adaptive execution can split a hub's rows; no window
or list ever holds all the neighbours of one vertex. Each round is written to
the shared folder and the one before it is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.llm import common


def _star(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge both ways, m the smallest of u's neighbours and u."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    star = _star(edges).where("v > u")
    return star.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    star = down.join(least, "u")
    return (star.select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of ``edges(a, b)`` that is not itself the
    smallest of its component; loops and repeated edges are allowed. An empty edge
    list gives an empty result. Converges in O(log² n) rounds."""
    spark = edges.sparkSession

    def written(df: DataFrame) -> tuple[str, DataFrame, tuple]:
        path = common.write_scratch(df, "components")
        table = spark.read.schema(df.schema).parquet(path)
        # order-free fingerprint of the edge set: rows are distinct after every star
        sign = table.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
        return path, table, tuple(sign)

    path, table, sign = written(edges.select("a", "b").where("a <> b").distinct())
    while sign[0]:
        new_path, new_table, new_sign = written(_small_star(_large_star(table)))
        common.remove(spark, path)
        path, table, (old, sign) = new_path, new_table, (sign, new_sign)
        if old == sign:
            break
    return table.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
