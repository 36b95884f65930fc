"""Registered queries that write files to the shared folder and read them back, and
the flows that start from such files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark import fixtures
from litspark.operators import stats
from litspark.plans import sqlparts as S
from litspark.plans import stages
from litspark.plans.queries import _TOP_TERMS_SQL, _top_terms, register
from litspark.plans.queries_nested import _works_keep
from litspark.session import checkpoint_dir
from litspark.sources import files, sinks
from litspark.sources import topics as topic_io


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --------------------------------------------------------------------------
# CSV: quoted newlines, doubled quotes, short and long lines
# --------------------------------------------------------------------------

def _quoted_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers whose title has doubled quotes and a comma and whose abstract is a whole text with its line ends."""
    return fixtures.papers(spark, sf_dir).select(
        F.concat(F.lit('"'), F.col("paper_id").cast("string"), F.lit('", a "quoted" title')).alias("title"),
        "affiliation", "year", "abstract")


@register("csv_round_trip", S.with_base(
    "SELECT concat('\"', CAST(paper_id AS VARCHAR), '\", a \"quoted\" title') AS title, affiliation, year, abstract FROM papers"))
def q_csv_round_trip(spark, sf_dir):
    path = _folder(spark, "papers-csv")
    sinks.write_csv(_quoted_papers(spark, sf_dir), path)
    return files.read_papers_csv(spark, path)


@register("csv_bad_lines",
          "SELECT concat('t', CAST(doc_id AS VARCHAR)) AS title, 'a b' AS affiliation, 2020 AS year, "
          "CASE WHEN doc_id % 3 = 0 THEN concat('x', CAST(doc_id AS VARCHAR)) END AS abstract FROM documents "
          "WHERE doc_id % 3 <> 2")
def q_csv_bad_lines(spark, sf_dir):
    """One line per document: whole, one field short (kept), or one field too long (skipped)."""
    key = F.col("doc_id").cast("string")
    line = F.concat(F.lit("t"), key, F.lit(",a b,2020"), F.when(F.col("doc_id") % 3 == 1, "").otherwise(F.concat(F.lit(",x"), key)),
                    F.when(F.col("doc_id") % 3 == 2, ",more").otherwise(""))
    path = _folder(spark, "lines-csv")
    # a separator that no line holds leaves the lines as they are
    (fixtures.documents(spark, sf_dir).select(line.alias("title,affiliation,year,abstract"))
     .write.option("header", True).option("sep", "\u0001").csv(path))
    return files.read_papers_csv(spark, path, bad_lines="skip")


# --------------------------------------------------------------------------
# JSON records, GeoJSON, topic words and JSON sink
# --------------------------------------------------------------------------

@register("record_split",
          "SELECT concat(source, '/', CAST(doc_id AS VARCHAR), '.json') AS filename, doc_id % 7 <> 0 AS parsed FROM documents")
def q_record_split(spark, sf_dir):
    """Good and rejected records; every seventh body is cut off."""
    records = fixtures.records_json(spark, sf_dir)
    number = F.regexp_extract("filename", r"/(\d+)\.json$", 1).cast("long")
    cut = records.withColumn("body", F.when(number % 7 == 0, F.substring("body", 1, 30)).otherwise(F.col("body")))
    good, rejects = files.split_records(cut)
    return good.select("filename", F.lit(True).alias("parsed")).unionByName(
        rejects.select("filename", F.lit(False).alias("parsed")))


@register("geojson_features", "SELECT n_name AS country FROM nation")
def q_geojson_features(spark, sf_dir):
    """A feature collection per region, one file each."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("n_name").alias("name")).alias("properties"))
    bodies = nation.groupBy("n_regionkey").agg(F.to_json(F.struct(
        F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    path = _folder(spark, "geojson")
    bodies.write.partitionBy("n_regionkey").text(path)
    return files.read_geojson_features(spark, path)


@register("topic_words_file", S.with_base(_TOP_TERMS_SQL + "SELECT topic_id, rank, term FROM tt"))
def q_topic_words_file(spark, sf_dir):
    path = _folder(spark, "topic-words")
    topic_io.write_topic_words(_top_terms(spark, sf_dir).select("topic_id", "rank", "term"), path, 10)
    return topic_io.read_topic_words(spark, path)


@register("json_round_trip", S.with_base(
    "SELECT assigned_topic AS topic, count(*) AS n_papers FROM pt WHERE assigned_topic IS NOT NULL GROUP BY 1"))
def q_json_round_trip(spark, sf_dir):
    path = _folder(spark, "distribution-json")
    sinks.write_json(stats.topic_distribution(stages.papers_topic(spark, sf_dir)), path)
    return spark.read.schema("topic string, n_papers long").json(path)


# --------------------------------------------------------------------------
# Flows from the sources
# --------------------------------------------------------------------------

def _flow_sql(source: str) -> str:
    """clean → identify language → tokens → assign → distribution over ``source``
    (title, affiliation, year, abstract), starting from the tables."""
    return f"""
WITH src AS ({source}),
tw AS ({fixtures.topic_words_values_sql()}),
labels_v AS ({fixtures.topic_labels_values_sql()}),
c0 AS (SELECT {S.clean_par(S.clean_html('title'))} AS title, affiliation, year,
       {S.strip_prefix(S.clean_par(S.clean_html('abstract')))} AS abstract FROM src WHERE year > 2019),
c AS (SELECT DISTINCT * FROM c0 WHERE NOT coalesce(lower(affiliation) IN ({S.NON_INST}), false)),
p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY title, affiliation, year, abstract) AS id, * FROM c),
norm AS (SELECT 'p' || id AS id, NULL AS lang, abstract AS t FROM p UNION ALL
         SELECT 'd' || doc_id, lang, text FROM documents WHERE doc_id % 5 <> 0 AND lang IS NOT NULL),
padded AS (SELECT id, lang, concat(' ', regexp_replace(lower(t), '\\s+', ' ', 'g'), ' ') AS t FROM norm),
grams AS (SELECT id, lang, substr(t, i, 3) AS g FROM (SELECT id, lang, t, unnest(generate_series(1, length(t) - 2)) AS i FROM padded)),
model AS (SELECT lang, g, count(*) AS c FROM grams WHERE lang IS NOT NULL GROUP BY 1, 2),
tot AS (SELECT lang, sum(c) AS c FROM model GROUP BY 1),
own AS (SELECT id, g, count(*) AS n FROM grams WHERE lang IS NULL GROUP BY 1, 2),
part AS (SELECT id, m.lang, sum(n * ln(m.c + 1)) AS s FROM own JOIN model m USING (g) GROUP BY 1, 2),
size AS (SELECT id, sum(n) AS n FROM own GROUP BY 1),
score AS (SELECT size.id, tot.lang, coalesce(s, 0) - size.n * ln(tot.c + (SELECT count(DISTINCT g) FROM model)) AS score
          FROM size JOIN tot ON true LEFT JOIN part USING (id, lang)),
found AS (SELECT id, lang FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, lang) AS rn FROM score)
          WHERE rn = 1 AND id IN (SELECT id FROM part)),
tok AS (SELECT p.id, {S.english_tokens('abstract', 'found.lang')} AS tokens FROM p LEFT JOIN found ON found.id = 'p' || p.id),
hits AS (SELECT id, topic_id, count(*) AS n FROM (SELECT DISTINCT id, term FROM (SELECT id, unnest(tokens) AS term FROM tok))
         JOIN tw USING (term) GROUP BY 1, 2),
best AS (SELECT id, arg_max(topic_id, (n, -topic_id)) AS topic_id FROM hits GROUP BY 1),
fallback AS (SELECT topic_id, string_agg(term, ', ' ORDER BY rank) FILTER (WHERE rank < 3) AS fb FROM tw GROUP BY 1),
names AS (SELECT f.topic_id, coalesce(replace(l.label, '"', ''), f.fb) AS label FROM fallback f LEFT JOIN labels_v l USING (topic_id))
SELECT n.label AS topic, count(*) AS n_papers FROM tok LEFT JOIN best USING (id)
JOIN names n ON n.topic_id = coalesce(best.topic_id, (SELECT min(topic_id) FROM tw)) GROUP BY 1
"""


def _distribution(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return stages.source_distribution(rows, stages.language_profile(spark, sf_dir), fixtures.topic_words(spark),
                                      fixtures.topic_labels(spark))


@register("flow_from_works", _flow_sql(
    f"SELECT {S.trim_ws('split_part(text, chr(10), 1)')} AS title, {S.trim_ws("concat(' Institute ', source, ' ')")} AS affiliation, "
    f"CAST(2016 + doc_id % 8 AS INTEGER) AS year, {S.trim_ws('text')} AS abstract FROM documents WHERE {_works_keep}"))
def q_flow_from_works(spark, sf_dir):
    """Works pages (JSON) → rows → key → clean → language → tokens → topics → distribution."""
    from litspark.operators import flatten
    rows = flatten.flatten_works(files.work_items_from_strings(fixtures.works_pages(spark, sf_dir)))
    return _distribution(spark, sf_dir, rows)


@register("flow_from_csv", _flow_sql(
    "SELECT concat('\"', CAST(paper_id AS VARCHAR), '\", a \"quoted\" title') AS title, affiliation, year, abstract "
    f"FROM ({fixtures.PAPERS_SQL})"))
def q_flow_from_csv(spark, sf_dir):
    """Paper CSV → key → clean → language → tokens → topics → distribution."""
    path = _folder(spark, "flow-csv")
    sinks.write_csv(_quoted_papers(spark, sf_dir), path)
    return _distribution(spark, sf_dir, files.read_papers_csv(spark, path))
