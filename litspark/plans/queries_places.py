"""Registered queries over many names, polygons and the search index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark import fixtures
from litspark.operators import geo, polygons, search_index
from litspark.plans import sqlparts as S
from litspark.plans import stages
from litspark.plans.queries import register
from litspark.plans.queries_files import _folder
from litspark.sources import files

# --------------------------------------------------------------------------
# Many names in many texts
# --------------------------------------------------------------------------

NAME_WORD = "[A-Za-zÀ-ÿ]{4,}"


@register("titles_with_words",
          f"WITH titles AS (SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents), "
          f"names AS (SELECT DISTINCT unnest(regexp_extract_all(title, '{NAME_WORD}')) AS name FROM titles) "
          f"SELECT name, count(*) AS n_titles FROM titles JOIN names ON contains(lower(title), lower(name)) GROUP BY name")
def q_titles_with_words(spark, sf_dir):
    """Every distinct word of the titles (thousands) against every title, inside words as well."""
    titles = fixtures.documents(spark, sf_dir).select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    names = titles.select(F.explode(F.regexp_extract_all("title", F.lit(NAME_WORD), 0)).alias("name")).distinct()
    found = geo.contains_matches(titles, "title", names)
    return found.groupBy("name").agg(F.count("*").alias("n_titles"))


# --------------------------------------------------------------------------
# Papers per country by polygon
# --------------------------------------------------------------------------

#: Shapes around a nation's place as (longitude, latitude) offsets, by n_nationkey % 4: a diamond with the place in a
#: hole, two far squares, a wide hexagon over the neighbours' places, a square with the place on its edge.
SHAPES = {
    0: [[[(-20, 0), (0, -20), (20, 0), (0, 20)], [(-1, -1), (1, -1), (1, 1), (-1, 1)]]],
    1: [[[(-2, -2), (2, -2), (2, 2), (-2, 2)]], [[(26, 8), (30, 8), (30, 12), (26, 12)]]],
    2: [[[(-30, -3), (-15, -12), (15, -12), (30, 3), (15, 12), (-15, 12)]]],
    3: [[[(0, -2), (4, -2), (4, 2), (0, 2)]]],
}


def nation_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One GeoJSON feature (text) per nation."""
    lon, lat = F.col("n_nationkey") * 14 - 170, F.col("n_nationkey") * 5 - 60

    def coordinates(shape) -> F.Column:
        return F.to_json(F.array(*[F.array(*[F.array(*[F.array(lon + x, lat + y) for x, y in [*ring, ring[0]]])
                                             for ring in polygon]) for polygon in shape]))

    text = reduce(lambda acc, k: acc.when(F.col("n_nationkey") % 4 == k, coordinates(SHAPES[k])), SHAPES, F)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    # a shape of one polygon is written as Polygon: the outer brackets go
    single = ~(F.col("n_nationkey") % 4 == 1)
    body = F.when(single, F.expr("substring(_c, 2, length(_c) - 2)")).otherwise(F.col("_c"))
    kind = F.when(single, F.lit("Polygon")).otherwise(F.lit("MultiPolygon"))
    return nation.withColumn("_c", text).select("n_regionkey", F.concat(
        F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(F.col("n_name").alias("name"))),
        F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), body, F.lit("}}")).alias("feature"))


_EDGE_ROWS = ", ".join(f"({k}, {x1}, {y1}, {x2}, {y2})" for k, shape in SHAPES.items() for polygon in shape for ring in polygon
                       for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]))


@register("papers_by_polygon", S.with_base(
    f", offsets(kind, x1, y1, x2, y2) AS (VALUES {_EDGE_ROWS}), "
    "edges AS (SELECT n_name AS country, CAST(n_nationkey * 14 - 170 + x1 AS DOUBLE) AS x1, CAST(n_nationkey * 5 - 60 + y1 AS DOUBLE) AS y1, "
    "CAST(n_nationkey * 14 - 170 + x2 AS DOUBLE) AS x2, CAST(n_nationkey * 5 - 60 + y2 AS DOUBLE) AS y2 FROM nation JOIN offsets ON kind = n_nationkey % 4), "
    "held AS (SELECT p.longitude, p.latitude, e.country FROM (SELECT DISTINCT longitude, latitude FROM geo) p CROSS JOIN edges e GROUP BY ALL HAVING "
    "count(*) FILTER (WHERE (y1 > latitude) <> (y2 > latitude) AND longitude < (x2 - x1) * (latitude - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 OR "
    "bool_or((x2 - x1) * (latitude - y1) = (y2 - y1) * (longitude - x1) AND longitude BETWEEN least(x1, x2) AND greatest(x1, x2) "
    "AND latitude BETWEEN least(y1, y2) AND greatest(y1, y2))) "
    "SELECT country, count(*) AS n_papers FROM geo JOIN held USING (longitude, latitude) GROUP BY country"))
def q_papers_by_polygon(spark, sf_dir):
    """The nations' shapes as feature collections, one file a region, and the papers inside each."""
    bodies = nation_shapes(spark, sf_dir).groupBy("n_regionkey").agg(F.concat(
        F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("feature"), ","), F.lit("]}")).alias("value"))
    path = _folder(spark, "shapes")
    bodies.write.partitionBy("n_regionkey").text(path)
    return polygons.papers_by_polygon(stages.papers_geo(spark, sf_dir), files.read_geojson_rings(spark, path))


# --------------------------------------------------------------------------
# Search by index
# --------------------------------------------------------------------------

SEARCHES = ["Thermal ble", "ther", "zz no such", "th on", "ÉON", "nation_1 the", "ing and"]


def _search_sql(number: int, query: str) -> str:
    hits = " OR ".join(f"coalesce(contains(lower({c}), '{w.lower()}'), false)" for w in query.split() for c in ("assigned_topic", "title"))
    return f"SELECT {number} AS query_no, paper_id FROM pt WHERE {hits}"


@register("search_by_index", S.with_base(" UNION ALL ".join(_search_sql(i, q) for i, q in enumerate(SEARCHES))))
def q_search_by_index(spark, sf_dir):
    """Several searches over one index of the papers' topics and titles."""
    from litspark.session import stage_table
    papers = stage_table(stages.papers_topic(spark, sf_dir).select("paper_id", "assigned_topic", "title"), "searched")
    path, cols = _folder(spark, "search-index"), ("assigned_topic", "title")
    search_index.build(papers, path, "paper_id", cols)
    found = [search_index.search(papers, path, q, "paper_id", cols).select(F.lit(i).alias("query_no"), "paper_id")
             for i, q in enumerate(SEARCHES)]
    return reduce(DataFrame.unionByName, found)
