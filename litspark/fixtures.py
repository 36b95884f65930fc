"""Logical tables of the paper pipeline bound to the driver-generated testdata.

``papers`` is plain SQL that runs unchanged on Spark and DuckDB; the other
views are written the same way so each oracle starts from the same rows.
Topic words and labels are frozen literal values (our own choice of frequent
English tokens of the testdata), not data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.operators.lookup import local_table

TABLES = ["region", "nation", "documents", "pages", "labels", "benchmark"]

PAPERS_SQL = """
SELECT d.doc_id AS paper_id,
       split_part(d.text, chr(10), 1) AS title,
       CASE WHEN d.doc_id % 50 = 0 THEN 'Independent Researcher'
            ELSE concat('Institute ', d.source, ', ', n.n_name) END AS affiliation,
       CAST(2016 + d.doc_id % 8 AS INT) AS year,
       d.text AS abstract,
       d.lang
FROM documents d JOIN nation n ON n.n_nationkey = d.doc_id % 25
"""

GAZETTEER_SQL = """
SELECT n_name AS place,
       CAST(n_nationkey * 5 - 60 AS DOUBLE) AS latitude,
       CAST(n_nationkey * 14 - 170 AS DOUBLE) AS longitude
FROM nation
WHERE n_nationkey % 7 <> 0
"""

REGIONS_SQL = """
SELECT r.r_name AS region, n.n_name AS country
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
"""

# Frozen topic words: topic id → five terms (rank order).
TOPIC_WORDS = {
    0: ["th", "ing", "ly", "thth", "thha"],
    1: ["er", "ti", "ble", "thon", "thre"],
    2: ["re", "ea", "st", "ther", "thes"],
    3: ["nd", "es", "ed", "tion", "thnt"],
}

# Frozen raw topic labels: one contains '"', topic 3 has none.
TOPIC_LABELS = {
    0: 'Thermal "th" Dynamics',
    1: "Energy Systems and Emissions",
    2: "Climate Change Research",
}


def topic_words_values_sql() -> str:
    rows = ", ".join(
        f"({t}, {r}, '{w}')" for t, words in TOPIC_WORDS.items() for r, w in enumerate(words)
    )
    return f"SELECT * FROM (VALUES {rows}) AS v(topic_id, rank, term)"


def topic_labels_values_sql() -> str:
    rows = ", ".join(f"({t}, '{label}')" for t, label in TOPIC_LABELS.items())
    return f"SELECT * FROM (VALUES {rows}) AS v(topic_id, label)"


def load_tables(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    out = {}
    for name in names or TABLES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        df.createOrReplaceTempView(name)
        out[name] = df
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    load_tables(spark, sf_dir, ["documents", "nation"])
    return spark.sql(PAPERS_SQL)


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    load_tables(spark, sf_dir, ["nation"])
    return spark.sql(GAZETTEER_SQL)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    load_tables(spark, sf_dir, ["nation", "region"])
    return spark.sql(REGIONS_SQL)


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("country"))


def topic_words(spark: SparkSession) -> DataFrame:
    rows = [(t, r, w) for t, words in TOPIC_WORDS.items() for r, w in enumerate(words)]
    return local_table(spark, rows, [("topic_id", "int"), ("rank", "int"), ("term", "string")])


def topic_labels(spark: SparkSession) -> DataFrame:
    return local_table(spark, list(TOPIC_LABELS.items()), [("topic_id", "int"), ("label", "string")])


# ---------------------------------------------------------------------------
# Nested views built from documents (Spark side only; oracles read documents)
# ---------------------------------------------------------------------------

WORKS_PAGE_SIZE = 100  # items per landed page (bounded page size)

# Which generated items lack a field (by source name, so every row is kept
# in the scan and the rule is visible in the oracle):
NO_AUTHOR_SOURCE = "src0"          # author = []
NO_AFFILIATION_SOURCE = "src1"     # first author has affiliation = []
NULL_AFF_NAME_SOURCE = "src2"      # affiliation name null
NO_PUBLISHED_SOURCE = "src3"       # published missing
NULL_DATE_PART_SOURCE = "src4"     # date-parts [[null]]
NO_ABSTRACT_SOURCE = "src5"        # abstract missing
EMPTY_ABSTRACT_SOURCE = "src6"     # abstract ""
NO_ORG_LANG = "de"                 # odd records in this language have no organisation


def works_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_no, body): documents as works-API pages of WORKS_PAGE_SIZE items."""
    d = documents(spark, sf_dir)
    src = F.col("source")
    name = F.when(src == NULL_AFF_NAME_SOURCE, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit(" Institute "), src, F.lit(" ")))
    aff = F.when(src == NO_AFFILIATION_SOURCE, F.array().cast("array<struct<name:string>>")).otherwise(
        F.array(F.struct(name.alias("name"))))
    author = F.when(src == NO_AUTHOR_SOURCE,
                    F.array().cast("array<struct<affiliation:array<struct<name:string>>>>")).otherwise(
        F.array(F.struct(aff.alias("affiliation"))))
    year = (F.lit(2016) + F.col("doc_id") % 8).cast("int")
    parts = F.when(src == NULL_DATE_PART_SOURCE, F.array(F.array(F.lit(None).cast("int")))).otherwise(
        F.array(F.array(year, F.lit(1), F.lit(1))))
    published = F.when(src != NO_PUBLISHED_SOURCE, F.struct(parts.alias("date-parts")))
    abstract = (F.when(src == NO_ABSTRACT_SOURCE, F.lit(None).cast("string"))
                 .when(src == EMPTY_ABSTRACT_SOURCE, F.lit("")).otherwise(F.col("text")))
    item = F.struct(F.array(F.concat(F.lit(" "), F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(" ")))
                    .alias("title"), author.alias("author"), published.alias("published"),
                    abstract.alias("abstract"))
    page_no = F.floor(F.col("doc_id") / WORKS_PAGE_SIZE).cast("int")
    grouped = d.select(page_no.alias("page_no"), item.alias("item")).groupBy("page_no").agg(
        F.collect_list("item").alias("items"))
    message = F.struct(F.col("items").alias("items"), (F.col("page_no") + 1).cast("string").alias("next-cursor"))
    return grouped.select("page_no", F.to_json(F.struct(message.alias("message"))).alias("body"))


def listing_pages(spark: SparkSession, sf_dir: str, pages_per_listing: int) -> DataFrame:
    """(page_id, html): ``pages_per_listing`` landed pages after one another, so each
    listing holds as many cards."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    listing = F.floor(F.col("page_id") / pages_per_listing).cast("long").alias("page_id")
    parts = pages.select(listing, F.struct(F.col("page_id").alias("at"), "html").alias("part"))
    return parts.groupBy("page_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list("part")), lambda p: p["html"]), "").alias("html"))


def records_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(filename, body): one nested abstract record per document.

    Even doc ids hold a single author group (object) whose organisation is a
    list; odd ones hold a list of groups, the first without organisation.
    """
    d = documents(spark, sf_dir)
    org_t = "struct<`$`:string>"
    inst = F.concat(F.lit("Institute "), F.col("source"))
    dept = F.concat(F.lit("Department "), F.col("source"))
    univ = F.when(F.col("lang") != NO_ORG_LANG, F.concat(F.lit("University "), F.col("source")))
    obj_group = F.struct(F.struct(F.array(F.struct(dept.alias("$")), F.struct(inst.alias("$")))
                                  .alias("organization")).alias("affiliation"))
    no_org = F.struct(F.struct(F.lit(None).cast(org_t).alias("organization")).alias("affiliation"))
    univ_org = F.when(univ.isNotNull(), F.struct(univ.alias("$")))
    arr_group = F.array(no_org, F.struct(F.struct(univ_org.alias("organization")).alias("affiliation")))

    def record(group):
        head = F.struct(group.alias("author-group"), F.col("text").alias("abstracts"),
                        F.split_part("text", F.lit("\n"), F.lit(1)).alias("citation-title"))
        year = F.struct(F.struct((F.lit(2016) + F.col("doc_id") % 8).cast("string").alias("@year"))
                        .alias("ait:date-delivered"))
        item = F.struct(year.alias("ait:process-info"), F.struct(head.alias("head")).alias("bibrecord"))
        return F.to_json(F.struct(F.struct(item.alias("item")).alias("abstracts-retrieval-response")))

    body = F.when(F.col("doc_id") % 2 == 0, record(obj_group)).otherwise(record(arr_group))
    filename = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".json"))
    return d.select(filename.alias("filename"), body.alias("body"))
