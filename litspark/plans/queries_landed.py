"""Registered queries over landed material: page chains, aligned files, VARIANT records, record trees, label files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark import fixtures
from litspark.operators import corpus, flatten, variant
from litspark.plans import sqlparts as S
from litspark.plans import stages
from litspark.plans.queries import register
from litspark.plans.queries_files import _folder
from litspark.plans.queries_nested import _records_sql
from litspark.sources import chain, files, sinks
from litspark.sources import topics as topic_io

# --------------------------------------------------------------------------
# Page chain: in every 50 pages one did not land, the last ends its chain, one
# names an earlier successor (a fork) and five go round in a loop
# --------------------------------------------------------------------------

_NEXT_SQL = ("CASE WHEN page_id % 50 IN (39, 49) THEN NULL WHEN page_id % 50 = 44 THEN concat('c', CAST(page_id - 4 AS VARCHAR)) "
             "WHEN page_id % 50 = 30 THEN concat('c', CAST(page_id - 10 AS VARCHAR)) ELSE concat('c', CAST(page_id + 1 AS VARCHAR)) END")


@register("page_chain",
          f"WITH RECURSIVE landed AS (SELECT concat('c', CAST(page_id AS VARCHAR)) AS cursor, {_NEXT_SQL} AS next_cursor FROM pages WHERE page_id % 50 <> 17), "
          "prev AS (SELECT next_cursor AS cursor, min(cursor) AS back, count(*) AS n_before FROM landed WHERE next_cursor IS NOT NULL GROUP BY 1), "
          "linked AS (SELECT l.*, p.back, coalesce(p.n_before, 0) AS n_before FROM landed l LEFT JOIN prev p USING (cursor)), "
          "walk AS (SELECT cursor, cursor AS head, CAST(0 AS BIGINT) AS position FROM linked WHERE back IS NULL "
          "UNION ALL SELECT l.cursor, w.head, w.position + 1 FROM walk w JOIN linked l ON l.back = w.cursor) "
          "SELECT l.cursor, l.next_cursor, w.head, w.position, l.n_before, "
          "l.next_cursor IS NOT NULL AND l.next_cursor NOT IN (SELECT cursor FROM landed) AS next_is_missing "
          "FROM linked l LEFT JOIN walk w USING (cursor)")
def q_page_chain(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id").where("page_id % 50 <> 17")

    def cursor(shift: int) -> F.Column:
        return F.concat(F.lit("c"), (F.col("page_id") + shift).cast("string"))

    place = F.col("page_id") % 50
    following = F.when(place.isin(39, 49), F.lit(None)).when(place == 44, cursor(-4)).when(place == 30, cursor(-10)).otherwise(cursor(1))
    return chain.page_chain(pages.select(cursor(0).alias("cursor"), following.alias("next_cursor")))


# --------------------------------------------------------------------------
# Rows of two files that belong together by their place
# --------------------------------------------------------------------------

@register("aligned_rows", S.with_base(
    "SELECT row_number() OVER (ORDER BY p.paper_id) - 1 AS row, concat('t ', p.title) AS \"left\", "
    "CASE WHEN p.paper_id < (SELECT max(paper_id) FROM papers) THEN array_to_string(d.tokens, ' ') END AS \"right\", "
    "CASE WHEN p.paper_id < (SELECT max(paper_id) FROM papers) THEN 'both' ELSE 'left' END AS side "
    "FROM papers p JOIN dtok d ON d.paper_id = p.paper_id"))
def q_aligned_rows(spark, sf_dir):
    """Titles and tokens of the papers, written apart in the order of the ids; the tokens lack the last row."""
    titles = fixtures.papers(spark, sf_dir).select("paper_id", F.concat(F.lit("t "), F.col("title")).alias("value"))
    last = titles.agg(F.max("paper_id")).first()[0]
    tokens = corpus.processed_text(stages.document_tokens(spark, sf_dir)).where(F.col("paper_id") < last).select(
        "paper_id", F.col("processed").alias("value"))
    paths = [_folder(spark, name) for name in ("titles", "tokens")]
    for rows, path, parts in zip((titles, tokens), paths, (5, 3)):
        rows.repartitionByRange(parts, "paper_id").sortWithinPartitions("paper_id").select("value").write.option("lineSep", "\n").text(path)
    return chain.align_lines(*[chain.numbered_lines(spark, path) for path in paths])


# --------------------------------------------------------------------------
# VARIANT records and the tree of record files
# --------------------------------------------------------------------------

@register("flatten_variant", _records_sql)
def q_flatten_variant(spark, sf_dir):
    return variant.flatten_records(variant.parse(fixtures.records_json(spark, sf_dir)))


@register("record_schema_profile",
          "SELECT * FROM (SELECT 'author-group' AS path, CASE doc_id % 2 WHEN 0 THEN 'OBJECT' ELSE 'ARRAY' END AS kind, count(*) AS n_records "
          "FROM documents GROUP BY 2 UNION ALL SELECT 'title', CASE WHEN text IS NULL THEN 'missing' ELSE 'STRING' END, count(*) FROM documents GROUP BY 2 "
          "UNION ALL SELECT 'year', 'STRING', count(*) FROM documents)")
def q_record_schema_profile(spark, sf_dir):
    return variant.schema_profile(variant.parse(fixtures.records_json(spark, sf_dir)))


def _record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with every seventh cut off, one per file, with their folder's name."""
    number = F.regexp_extract("filename", r"/(\d+)\.json$", 1).cast("long")
    source = F.regexp_extract("filename", r"^(.*)/", 1)
    return fixtures.records_json(spark, sf_dir).where("filename IS NOT NULL").select(
        source.alias("source"), number.alias("number"), F.when(number % 7 == 0, F.substring("body", 1, 30)).otherwise(F.col("body")).alias("value"))


@register("json_tree",
          "SELECT doc_id % 7 <> 0 AS parsed, CASE WHEN doc_id % 7 <> 0 THEN " + "split_part(text, chr(10), 1) END AS title, "
          "concat('source=', source, '/number=', CAST(doc_id AS VARCHAR)) AS folder FROM documents")
def q_json_tree(spark, sf_dir):
    """One JSON file per record in a tree of folders, read back: records and rejects with their folders."""
    path = _folder(spark, "record-tree")
    sinks.write_tree(_record_files(spark, sf_dir), path, ["source", "number"])
    return _read_tree(spark, path)


def _read_tree(spark: SparkSession, path: str) -> DataFrame:
    good, rejects = files.read_json_tree(spark, path, glob="part-*")
    folder = F.regexp_replace("filename", "/[^/]*$", "").alias("folder")
    titled = flatten.flatten_records(good)
    return titled.select(F.lit(True).alias("parsed"), "title", folder).unionByName(
        rejects.select("parsed", F.lit(None).cast("string").alias("title"), folder))


@register("topic_labels_file",
          "SELECT topic_id, label, n FROM (SELECT CAST(doc_id % 20 AS INTEGER) AS topic_id, count(*) AS n, "
          "concat('Label \"', CAST(doc_id % 20 AS VARCHAR), '\", of ', CAST(count(*) AS VARCHAR)) AS label FROM documents GROUP BY 1, doc_id % 20)")
def q_topic_labels_file(spark, sf_dir):
    """A label per group of documents, written as a label CSV (quotes and commas inside) and read back."""
    groups = fixtures.documents(spark, sf_dir).groupBy((F.col("doc_id") % 20).cast("int").alias("topic_id")).agg(F.count("*").alias("n"))
    label = F.concat(F.lit('Label "'), F.col("topic_id").cast("string"), F.lit('", of '), F.col("n").cast("string"))
    path = _folder(spark, "topic-labels")
    groups.select("topic_id", label.alias("label")).write.option("header", True).option("escape", '"').csv(path)
    return topic_io.read_topic_labels(spark, path).join(groups, "topic_id").select("topic_id", "label", "n")
