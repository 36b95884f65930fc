"""Many names, polygons and the search index against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from litspark.operators import patterns, polygons, search_index, stats
from litspark.sources import files


# ---- many names -----------------------------------------------------------

TEXTS = [(1, "He said ushers, she sells İzmir"), (2, "HERSHEY his"), (3, ""), (4, None), (5, "日本語 text 😀 she"), (5, "she she she")]
NAMES = ["he", "she", "his", "hers", "HE", "", "İzmir", "本語", "😀", "sells İ", "absent", "e said u"]


@pytest.mark.parametrize("block_chars", [1, 9, 1 << 20])
def test_names_are_found_as_by_contains(spark, block_chars):
    texts = spark.createDataFrame(TEXTS, "id long, text string").withColumn("name", F.lit("old")).repartition(3)
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    got = sorted((r["id"], r["text"], r["name"]) for r in patterns.find_all(texts, "text", names, block_chars).collect())
    want = texts.drop("name").join(names, F.lower("text").contains(F.lower("name")))
    assert got == sorted(map(tuple, want.select("id", "text", "name").collect())) and len(got) > 20


def test_no_names_and_no_texts(spark):
    texts, names = spark.createDataFrame(TEXTS, "id long, text string"), spark.createDataFrame([("he",)], "name string")
    assert patterns.find_all(texts, "text", names.limit(0)).columns == ["id", "text", "name"]
    assert patterns.find_all(texts, "text", names.limit(0)).count() == patterns.find_all(texts.limit(0), "text", names).count() == 0


def test_many_names_need_no_substring_rows(spark):
    texts, names = spark.createDataFrame(TEXTS, "id long, text string"), spark.createDataFrame([("he",)], "name string")
    plan = patterns.find_all(texts, "text", names)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Exchange" not in plan


# ---- polygons -------------------------------------------------------------

def plain_inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            odd ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return odd


SHAPES = {
    "square with a hole": [[(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (6, 3), (6, 6), (3, 6)]],
    "concave": [[(-20, -5), (-5, -15), (-12, 0), (-5, 15), (-20, 5)]],
    "two parts": [[(20, 20), (25, 20), (22, 26)], [(-30, 20), (-28, 20), (-28, 30), (-30, 30)]],
    "flat": [[(0, -20), (10, -20), (5, -20)]],
}


def features():
    out = []
    for name, rings in SHAPES.items():
        closed = [[list(p) for p in [*r, r[0]]] for r in rings]
        shape = {"type": "MultiPolygon", "coordinates": [[r] for r in closed]} if name == "two parts" else {"type": "Polygon", "coordinates": closed}
        out.append({"type": "Feature", "properties": {"name": name}, "geometry": shape})
    out += [{"type": "Feature", "properties": {"name": "a point"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
            {"type": "Feature", "properties": {"name": "nothing"}, "geometry": None},
            {"type": "Feature", "properties": {"name": "open ring"}, "geometry": {"type": "Polygon", "coordinates": [[[40, 40], [44, 40], [42, 44]]]}},
            {"type": "Feature", "properties": {"name": "two points"}, "geometry": {"type": "Polygon", "coordinates": [[[40, 40], [44, 40]]]}}]
    return {"type": "FeatureCollection", "features": out}


@pytest.mark.parametrize("size", [0.7, 4.0, 100.0])
def test_points_in_polygons(spark, tmpdir_path, size):
    with open(f"{tmpdir_path}/shapes.json", "w") as fh:
        json.dump(features(), fh)
    rings = files.read_geojson_rings(spark, tmpdir_path)
    rng = random.Random(3)
    points = [(rng.uniform(-35, 45), rng.uniform(-25, 45)) for _ in range(400)]
    points += [(rng.randint(-35, 45) * 1.0, rng.randint(-25, 45) * 1.0) for _ in range(600)]  # corners and edges
    shapes = SHAPES | {"open ring": [[(40, 40), (44, 40), (42, 44)]]}
    want = {(x, y, name) for x, y in points for name, r in shapes.items() if plain_inside(x, y, r)}
    table = spark.createDataFrame(points + [(None, 1.0), (1.0, None)], "longitude double, latitude double")
    got = set(map(tuple, polygons.point_countries(table, rings, size=size).collect()))
    assert got == want and {n for _, _, n in want} == set(shapes)


def test_papers_of_one_place_are_counted_once_each(spark, tmpdir_path):
    with open(f"{tmpdir_path}/shapes.json", "w") as fh:
        json.dump(features(), fh)
    papers = spark.createDataFrame([(1.0, 1.0)] * 7 + [(4.0, 4.0)] + [(None, None)], "longitude double, latitude double")
    out = polygons.papers_by_polygon(papers, files.read_geojson_rings(spark, tmpdir_path))
    assert [tuple(r) for r in out.collect()] == [("square with a hole", 7)]


# ---- search index ---------------------------------------------------------

def test_index_finds_what_the_scan_finds(spark, tmpdir_path):
    rng = random.Random(4)
    words = ["Climate", "mate", "limit", "İstanbul", "naïve", "a", "of", "x😀y", "abcabc", "bca"]
    rows = [(i * 7919, " ".join(rng.choices(words, k=rng.randint(0, 4))) or None, rng.choice(["Topic", None, "lim"])) for i in range(500)]
    rows.append((None, "climate without id", None))
    df = spark.createDataFrame(rows, "id long, title string, topic string")
    cols = ("title", "topic")
    search_index.build(df, f"{tmpdir_path}/index", "id", cols)
    for query in ("climate", "MATE lim", "abcab", "bcab", "of", "a", "x😀y", "naï ve", "İst", "zzz", "  ", "", "top of"):
        want = [r for r in stats.search(df, query, cols).collect() if r["id"] is not None or not query or len(query.split()) == 0]
        got = search_index.search(df, f"{tmpdir_path}/index", query, "id", cols).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)), query


def test_ids_in_many_blocks_and_long_lists(spark, tmpdir_path):
    df = spark.range(0, 300_000, 3).select("id", F.concat(F.lit("common "), F.when(F.col("id") % 30_000 == 0, "rare").otherwise("")).alias("title"))
    search_index.build(df, f"{tmpdir_path}/index", "id", ("title",), partitions=4)
    table = spark.read.parquet(f"{tmpdir_path}/index")
    assert table.agg(F.max("n")).first()[0] <= 1 << search_index.BLOCK_BITS and table.select("block").distinct().count() == 5
    assert search_index.candidates(spark, f"{tmpdir_path}/index", "common").count() == 100_000
    assert search_index.search(df, f"{tmpdir_path}/index", "rare", "id", ("title",)).count() == 10


def test_a_search_reads_the_asked_trigrams_only(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "some title")], "id long, title string")
    search_index.build(df, f"{tmpdir_path}/index", "id", ("title",))
    plan = search_index.candidates(spark, f"{tmpdir_path}/index", "title")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram, [itl,tit,tle])]" in plan
