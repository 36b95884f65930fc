"""Order in landed material: pages that name their successor, and rows that belong together by place.

``page_chain`` ranks pages by pointer doubling: after round r every page knows the page 2^r
steps before it and how far that is, so a chain of n pages takes log2(n) joins, each by
equality on a cursor. ``numbered_lines`` numbers the lines of files by counts per split and
their running sums, so nothing is sorted and no file is read by one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litspark.session import stage_table


def page_chain(pages: DataFrame, cursor_col: str = "cursor", next_col: str = "next_cursor") -> DataFrame:
    """(cursor, next_cursor, head, position, n_before, next_is_missing) of every landed cursor.

    ``head`` is the first page of its chain and ``position`` the steps from it; both are null
    in a loop and behind one. Where several pages name one successor (a fork, ``n_before`` > 1)
    the chain goes through the smallest. A cursor that landed twice is one page, with its
    smallest successor. ``next_is_missing``: the successor did not land. A null cursor is no page.
    """
    landed = stage_table(pages.where(F.col(cursor_col).isNotNull()).groupBy(F.col(cursor_col).cast("string").alias("cursor")).agg(
        F.min(F.col(next_col).cast("string")).alias("next_cursor")), "chain-pages")
    before = landed.where(F.col("next_cursor").isNotNull()).groupBy(F.col("next_cursor").alias("cursor")).agg(
        F.min("cursor").alias("back"), F.count("*").alias("n_before"))
    linked = landed.join(before, "cursor", "left").withColumn("n_before", F.coalesce("n_before", F.lit(0)))
    # back: the page ``steps`` steps before, null once a head is passed; head: the page at the end of the steps taken
    state = stage_table(linked.select("cursor", "n_before", "back", F.when(F.col("back").isNotNull(), 1).otherwise(0).cast("long").alias("steps")),
                        "chain-0")
    rounds = math.ceil(math.log2(max(landed.count(), 2))) + 1
    for r in range(rounds):
        if not state.where(F.col("back").isNotNull()).limit(1).count():
            break
        # a page whose way ends at a head keeps that head
        ahead = state.select(F.col("cursor").alias("back"), F.col("back").alias("further"), F.col("steps").alias("more"),
                             *([F.col("head").alias("its_head")] if "head" in state.columns else []))
        joined = state.join(ahead, "back", "left")
        known = F.col("head") if "head" in state.columns else F.lit(None).cast("string")
        its = F.col("its_head") if "head" in state.columns else F.lit(None).cast("string")
        found = F.coalesce(known, F.when(F.col("back").isNotNull() & F.col("further").isNull(), F.coalesce(its, F.col("back"))))
        state = stage_table(joined.select("cursor", "n_before", F.col("further").alias("back"),
                                          (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), found.alias("head")), f"chain-{r + 1}")
    open_end = F.col("back").isNotNull()
    head = F.coalesce(F.col("head"), F.when(~open_end, F.col("cursor"))) if "head" in state.columns else F.col("cursor")
    ranked = state.select("cursor", "n_before", F.when(~open_end, head).alias("head"), F.when(~open_end, F.col("steps")).alias("position"))
    known = landed.select(F.col("cursor").alias("next_cursor"), F.lit(True).alias("landed"))
    return (landed.join(ranked, "cursor").join(known, "next_cursor", "left").select(
        "cursor", "next_cursor", "head", "position", "n_before",
        (F.col("next_cursor").isNotNull() & F.col("landed").isNull()).alias("next_is_missing")))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(row, line): the lines below ``path`` numbered from 0, files in the order of their names."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    rows = stage_table(lines, "numbered-lines")
    # one row per split
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return rows.join(bases, ["file", "block"]).select((F.col("base") + F.col("place") - F.col("first")).alias("row"), "line")


def align_lines(left: DataFrame, right: DataFrame) -> DataFrame:
    """(row, left, right, side) of two numbered tables side by side; side is ``both``, or ``left`` or
    ``right`` for the rows that the longer one has beyond the other."""
    a, b = left.select("row", F.col("line").alias("left")), right.select("row", F.col("line").alias("right"))
    a, b = a.withColumn("_a", F.lit(True)), b.withColumn("_b", F.lit(True))
    side = F.when(F.col("_a").isNull(), "right").when(F.col("_b").isNull(), "left").otherwise("both")
    return a.join(b, "row", "full").select("row", "left", "right", side.alias("side"))
