"""Points in polygons: grid cells find the candidates, ray casting decides.

The plane is cut into square cells. For every feature and row of cells the edges that
reach into the row are collected; each cell of the row between the feature's least and
greatest x there gets those edges that a ray to the right from the cell can meet. A point
is joined to the edges of its own cell only, by equality.

All rings of a feature count alike (even-odd rule), so holes and several polygons need
no case of their own. A point on an edge is inside. Coordinates are plane: a shape
across the antimeridian has to come as two polygons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 4.0


def ring_edges(rings: DataFrame) -> DataFrame:
    """(country, x1, y1, x2, y2) of ``read_geojson_rings``; a ring that is not closed is closed,
    points without two numbers and rings of fewer than three points are left out."""
    points = F.filter("points", lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull())
    rows = rings.select("country", points.alias("p")).where(F.size("p") >= 3)
    after = F.concat(F.slice("p", 2, F.size("p") - 1), F.slice("p", 1, 1))
    pairs = rows.select("country", F.explode(F.arrays_zip(F.col("p").alias("a"), after.alias("b"))).alias("e"))
    return pairs.select("country", *[F.col(f"e.{end}")[i].alias(f"{axis}{k}") for end, k in (("a", 1), ("b", 2))
                                     for i, axis in ((0, "x"), (1, "y"))])


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size))


def cell_cover(edges: DataFrame, size: float = CELL) -> DataFrame:
    """(cx, cy, country, edges): the cells that can hold points of a feature, with the edges to test there.
    One row has the edges of one feature in one row of cells at most."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    banded = edges.withColumn("cy", F.explode(F.sequence(_cell(low, size), _cell(high, size))))
    banded = banded.withColumn("right", F.greatest("x1", "x2"))
    rows = banded.groupBy("country", "cy").agg(
        F.min(F.least("x1", "x2")).alias("x_min"), F.max("right").alias("x_max"),
        F.collect_list(F.struct("x1", "y1", "x2", "y2", "right")).alias("all"))
    cells = rows.withColumn("cx", F.explode(F.sequence(_cell(F.col("x_min"), size), _cell(F.col("x_max"), size))))
    return cells.select("cx", "cy", "country", F.filter("all", lambda e: e["right"] >= F.col("cx") * F.lit(size)).alias("edges"))


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd ray cast to the right over ``edges``; true on an edge."""
    def crosses(e: Column) -> Column:
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < at)

    def touches(e: Column) -> Column:
        return (((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"]))
                & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
                & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))

    return F.exists(edges, touches) | (F.size(F.filter(edges, crosses)) % 2 == 1)


def point_countries(points: DataFrame, rings: DataFrame, x_col: str = "longitude", y_col: str = "latitude",
                    size: float = CELL) -> DataFrame:
    """(x_col, y_col, country) of every distinct point and feature that holds it; null coordinates match nothing."""
    x, y = F.col(x_col), F.col(y_col)
    distinct = points.select(x.cast("double").alias(x_col), y.cast("double").alias(y_col)).where(x.isNotNull() & y.isNotNull()).distinct()
    placed = distinct.withColumns({"cx": _cell(x, size), "cy": _cell(y, size)})
    found = placed.join(cell_cover(ring_edges(rings), size), ["cx", "cy"]).where(inside(x, y, F.col("edges")))
    return found.select(x_col, y_col, "country")


def papers_by_polygon(papers: DataFrame, rings: DataFrame, x_col: str = "longitude", y_col: str = "latitude",
                      size: float = CELL) -> DataFrame:
    """(country, n_papers) of the features that hold a paper. Papers are counted by coordinate
    first, so a place that many of them share is one row of the join."""
    counts = papers.groupBy(F.col(x_col).cast("double").alias(x_col), F.col(y_col).cast("double").alias(y_col)).agg(
        F.count("*").alias("n"))
    held = point_countries(counts, rings, x_col, y_col, size)
    return held.join(counts, [x_col, y_col]).groupBy("country").agg(F.sum("n").alias("n_papers"))
