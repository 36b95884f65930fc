"""Registered queries: one per operator of the inventory.

Each entry pairs a Spark callable ``(spark, sf_dir) -> DataFrame`` with the
DuckDB SQL that restates it on the same parquet tables (None when the result
is not SQL-expressible, e.g. model fits). Output columns carry the same names
on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark import fixtures
from litspark.functions import text as T
from litspark.functions.constants import NON_INSTITUTION_AFFILIATIONS
from litspark.operators import assign, clean, corpus, geo, stats
from litspark.plans import sqlparts as S
from litspark.plans import stages
from litspark.sources import topics as topic_io

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None):
    def wrap(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn
    return wrap


TOPIC_IDS = sorted(fixtures.TOPIC_WORDS)
SEARCH_QUERY = "Thermal ble"
REGION = "EUROPE"
FEATURE_REGION = "ASIA"
LAT_BAND = 10.0


# --------------------------------------------------------------------------
# Minimum slice: clean → tokens → assign → distribution
# --------------------------------------------------------------------------

@register("assign_topic", S.with_base("SELECT paper_id, topic_id FROM dassigned"))
def q_assign_topic(spark, sf_dir):
    toks = stages.document_tokens(spark, sf_dir)
    return assign.assign_topic(toks, fixtures.topic_words(spark)).select("paper_id", "topic_id")


@register("topic_distribution", S.with_base(
    "SELECT assigned_topic AS topic, count(*) AS n_papers FROM pt "
    "WHERE assigned_topic IS NOT NULL GROUP BY 1"))
def q_topic_distribution(spark, sf_dir):
    return stats.topic_distribution(stages.papers_topic(spark, sf_dir))


@register("clean_papers", S.with_base(
    "SELECT paper_id, title, affiliation, year, abstract, lang FROM cleaned"))
def q_clean_papers(spark, sf_dir):
    return stages.clean_stage(fixtures.papers(spark, sf_dir)).select(
        "paper_id", "title", "affiliation", "year", "abstract", "lang")


@register("processed_abstracts", S.with_base(
    "SELECT paper_id, array_to_string(tokens, ' ') AS processed FROM dtok"))
def q_processed_abstracts(spark, sf_dir):
    return corpus.processed_text(stages.document_tokens(spark, sf_dir)).select("paper_id", "processed")


@register("tokenize_v1", f"SELECT doc_id AS paper_id, array_to_string({S.tokenize_v1('text')}, ' ') AS processed "
                         f"FROM documents")
def q_tokenize_v1(spark, sf_dir):
    docs = fixtures.documents(spark, sf_dir).withColumnRenamed("doc_id", "paper_id")
    return corpus.processed_text(corpus.tokenize_v1(docs, "text")).select("paper_id", "processed")


# --------------------------------------------------------------------------
# String functions
# --------------------------------------------------------------------------

@register("clean_html", f"SELECT page_id, {S.clean_html('html')} AS text FROM pages")
def q_clean_html(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", T.clean_html("html").alias("text"))


@register("clean_paragraphs", f"SELECT page_id, {S.clean_par(S.clean_html('html'))} AS text FROM pages")
def q_clean_paragraphs(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", T.clean_paragraphs(T.clean_html("html")).alias("text"))


_PREFIXED_SQL = ("concat(CASE doc_id % 3 WHEN 0 THEN 'Abstract: ' WHEN 1 THEN 'ABSTRACTS of ' "
                 "ELSE '' END, text)")


@register("strip_abstract_prefix",
          f"SELECT doc_id, {S.strip_prefix(_PREFIXED_SQL)} AS abstract FROM documents")
def q_strip_abstract_prefix(spark, sf_dir):
    docs = fixtures.documents(spark, sf_dir)
    prefixed = F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("Abstract: "))
                         .when(F.col("doc_id") % 3 == 1, F.lit("ABSTRACTS of ")).otherwise(F.lit("")),
                        F.col("text"))
    return docs.select("doc_id", T.strip_abstract_prefix(prefixed).alias("abstract"))


# --------------------------------------------------------------------------
# Projections / filters
# --------------------------------------------------------------------------

@register("year_cut", S.with_base("SELECT paper_id, year FROM papers WHERE year > 2019"))
def q_year_cut(spark, sf_dir):
    return clean.after_year(fixtures.papers(spark, sf_dir)).select("paper_id", "year")


@register("year_cut_report", S.with_base(
    "SELECT CAST(count(*) FILTER (WHERE year <= 2019) AS BIGINT) AS rows_removed, "
    "CAST(count(*) FILTER (WHERE year > 2019) AS BIGINT) AS rows_remaining FROM papers"))
def q_year_cut_report(spark, sf_dir):
    return clean.year_cut_report(fixtures.papers(spark, sf_dir))


@register("drop_independent", S.with_base(
    f"SELECT paper_id, affiliation FROM papers "
    f"WHERE NOT coalesce(lower(affiliation) IN ({S.NON_INST}), false)"))
def q_drop_independent(spark, sf_dir):
    return clean.drop_affiliations(fixtures.papers(spark, sf_dir), NON_INSTITUTION_AFFILIATIONS).select(
        "paper_id", "affiliation")


@register("dedup_rows",
          "SELECT min(doc_id) AS doc_id, text, lang FROM documents GROUP BY text, lang")
def q_dedup_rows(spark, sf_dir):
    docs = fixtures.documents(spark, sf_dir).select("doc_id", "text", "lang")
    return clean.dedup_rows(docs, ["text", "lang"], "doc_id")


@register("research_details", S.with_base("SELECT paper_id, title, affiliation, year FROM pt"))
def q_research_details(spark, sf_dir):
    return stages.papers_topic(spark, sf_dir).select("paper_id", "title", "affiliation", "year")


@register("papers_with_coords", S.with_base(
    f"SELECT p.paper_id, g.latitude, g.longitude FROM papers p "
    f"LEFT JOIN gaz g ON lower({S.last_segment('p.affiliation')}) = lower(g.place) "
    f"WHERE g.latitude IS NOT NULL AND g.longitude IS NOT NULL"))
def q_papers_with_coords(spark, sf_dir):
    papers = fixtures.papers(spark, sf_dir).withColumn("_place", F.lower(T.last_segment("affiliation")))
    gaz = fixtures.gazetteer(spark, sf_dir).select(F.lower("place").alias("_place"), "latitude", "longitude")
    joined = papers.join(gaz, "_place", "left")
    return clean.drop_missing(joined, ["latitude", "longitude"]).select("paper_id", "latitude", "longitude")


@register("search_any_word", S.with_base(
    "SELECT paper_id FROM pt WHERE "
    + " OR ".join(f"coalesce(contains(lower({c}), '{w.lower()}'), false)"
                  for w in SEARCH_QUERY.split() for c in ("assigned_topic", "title"))))
def q_search_any_word(spark, sf_dir):
    return stats.search(stages.papers_topic(spark, sf_dir), SEARCH_QUERY).select("paper_id")


@register("region_filter", S.with_base(
    f"SELECT paper_id, affiliation FROM pt WHERE coalesce(regexp_matches(affiliation, "
    f"(SELECT string_agg(country, '|') FROM regions_v WHERE region = '{REGION}'), 'i'), false)"))
def q_region_filter(spark, sf_dir):
    names = fixtures.regions(spark, sf_dir).filter(F.col("region") == REGION).select("country")
    return stats.in_region(stages.papers_topic(spark, sf_dir), names).select("paper_id", "affiliation")


@register("region_countries", S.with_base(
    f"SELECT n_name AS country FROM nation WHERE n_name IN "
    f"(SELECT country FROM regions_v WHERE region = '{FEATURE_REGION}')"))
def q_region_countries(spark, sf_dir):
    features = fixtures.countries(spark, sf_dir)
    region_list = fixtures.regions(spark, sf_dir).filter(F.col("region") == FEATURE_REGION).select("country")
    return geo.region_countries(features, region_list)


@register("profile_nulls",
          "SELECT count(*) AS n_rows, count(d.doc_id) AS nonnull_doc_id, count(d.lang) AS nonnull_lang, "
          "count(l.quality) AS nonnull_quality, count(l.toxic) AS nonnull_toxic "
          "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_profile_nulls(spark, sf_dir):
    docs = fixtures.documents(spark, sf_dir).select("doc_id", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return clean.profile_nulls(docs.join(labels, "doc_id", "left"))


# --------------------------------------------------------------------------
# Joins
# --------------------------------------------------------------------------

@register("papers_geo", S.with_base("SELECT paper_id, affiliation, latitude, longitude FROM geo"))
def q_papers_geo(spark, sf_dir):
    return stages.papers_geo(spark, sf_dir).select("paper_id", "affiliation", "latitude", "longitude")


@register("geocode_affiliations", S.with_base(
    f"SELECT DISTINCT c.affiliation, g.latitude, g.longitude FROM cleaned c "
    f"JOIN gaz g ON lower({S.last_segment('c.affiliation')}) = lower(g.place)"))
def q_geocode_affiliations(spark, sf_dir):
    cleaned = stages.clean_stage(fixtures.papers(spark, sf_dir))
    return geo.geocode_affiliations(cleaned, fixtures.gazetteer(spark, sf_dir))


@register("distinct_affiliations", S.with_base("SELECT DISTINCT affiliation FROM cleaned"))
def q_distinct_affiliations(spark, sf_dir):
    return stages.clean_stage(fixtures.papers(spark, sf_dir)).select("affiliation").distinct()


@register("topic_label_lookup", S.with_base("SELECT paper_id, topic_id, assigned_topic FROM pt"))
def q_topic_label_lookup(spark, sf_dir):
    return stages.papers_topic(spark, sf_dir).select("paper_id", "topic_id", "assigned_topic")


@register("clean_labels", S.with_base(
    "SELECT a.paper_id, l.label AS raw_label, replace(l.label, '\"', '') AS label "
    "FROM assigned a LEFT JOIN labels_v l USING (topic_id)"))
def q_clean_labels(spark, sf_dir):
    assigned = stages.papers_topic(spark, sf_dir).select("paper_id", "topic_id")
    raw = fixtures.topic_labels(spark).withColumnRenamed("label", "raw_label")
    return (assigned.join(raw, "topic_id", "left")
                    .select("paper_id", "raw_label", T.remove_quotes("raw_label").alias("label")))


_COUNTRY_SQL = (
    "per_aff AS (SELECT affiliation, count(title) AS n FROM pt WHERE affiliation IS NOT NULL GROUP BY 1), "
    "cc AS (SELECT n.n_name AS country, CAST(coalesce(sum(a.n), 0) AS BIGINT) AS paper_count "
    "FROM nation n LEFT JOIN per_aff a ON contains(lower(a.affiliation), lower(n.n_name)) GROUP BY n.n_name) ")


@register("country_paper_count", S.with_base(", " + _COUNTRY_SQL + "SELECT country, paper_count FROM cc"))
def q_country_paper_count(spark, sf_dir):
    return geo.country_paper_count(stages.papers_topic(spark, sf_dir), fixtures.countries(spark, sf_dir))


@register("density_class", S.with_base(
    ", " + _COUNTRY_SQL + ", mx AS (SELECT coalesce(max(n), 1) AS m FROM per_aff) "
    "SELECT country, paper_count, CASE WHEN paper_count = 0 THEN 'No Papers' "
    "WHEN paper_count / (SELECT m FROM mx) < 0.33 THEN 'Low' "
    "WHEN paper_count / (SELECT m FROM mx) < 0.66 THEN 'Medium' ELSE 'High' END AS density_class FROM cc"))
def q_density_class(spark, sf_dir):
    return geo.country_density(stages.papers_topic(spark, sf_dir), fixtures.countries(spark, sf_dir))


@register("topic_overlap_scores", S.with_base(
    "SELECT d.paper_id, t.topic_id, CAST(coalesce(h.n, 0) AS BIGINT) AS score FROM dtok d "
    "JOIN (SELECT DISTINCT topic_id FROM tw) t ON true "
    "LEFT JOIN dhits h ON h.paper_id = d.paper_id AND h.topic_id = t.topic_id"))
def q_topic_overlap_scores(spark, sf_dir):
    return assign.topic_overlap_scores(stages.document_tokens(spark, sf_dir), fixtures.topic_words(spark))


# --------------------------------------------------------------------------
# Aggregations
# --------------------------------------------------------------------------

@register("kpis", S.with_base(
    "SELECT count(*) AS total_papers, "
    "CAST(count(DISTINCT affiliation) + max(CAST(affiliation IS NULL AS INTEGER)) AS BIGINT) AS n_affiliations, "
    "concat_ws(' - ', CAST(min(year) AS VARCHAR), CAST(max(year) AS VARCHAR)) AS year_range FROM pt"))
def q_kpis(spark, sf_dir):
    return stats.kpis(stages.papers_topic(spark, sf_dir))


@register("papers_per_affiliation", S.with_base(
    "SELECT affiliation, count(title) AS n_papers FROM pt WHERE affiliation IS NOT NULL GROUP BY 1"))
def q_papers_per_affiliation(spark, sf_dir):
    return stats.papers_per_affiliation(stages.papers_topic(spark, sf_dir))


@register("affiliation_sizes", S.with_base(
    "SELECT affiliation, count(*) AS n_rows FROM pt WHERE affiliation IS NOT NULL GROUP BY 1"))
def q_affiliation_sizes(spark, sf_dir):
    return stats.affiliation_sizes(stages.papers_topic(spark, sf_dir))


@register("top5_topics", S.with_base(
    "SELECT assigned_topic AS topic, count(*) AS n_papers FROM pt WHERE assigned_topic IS NOT NULL "
    "GROUP BY 1 ORDER BY n_papers DESC, topic ASC LIMIT 5"))
def q_top5_topics(spark, sf_dir):
    return stats.top_topics(stages.papers_topic(spark, sf_dir), 5)


@register("papers_by_year", S.with_base(
    "SELECT year, count(title) AS n_papers FROM pt WHERE year IS NOT NULL GROUP BY 1"))
def q_papers_by_year(spark, sf_dir):
    return stats.papers_by_year(stages.papers_topic(spark, sf_dir))


@register("top_institutions", S.with_base(
    "SELECT affiliation, count(title) AS n_papers, count(DISTINCT assigned_topic) AS unique_topics FROM pt "
    "WHERE affiliation IS NOT NULL GROUP BY 1 ORDER BY n_papers DESC, affiliation ASC LIMIT 5"))
def q_top_institutions(spark, sf_dir):
    return stats.top_institutions(stages.papers_topic(spark, sf_dir), 5)


@register("topic_pivot", S.with_base(
    "SELECT affiliation, " + ", ".join(
        f"count(*) FILTER (WHERE topic_id = {t}) AS topic_{t}" for t in TOPIC_IDS)
    + " FROM pt WHERE affiliation IS NOT NULL GROUP BY 1"))
def q_topic_pivot(spark, sf_dir):
    return stats.topic_pivot(stages.papers_topic(spark, sf_dir), TOPIC_IDS)


@register("topic_onehot", S.with_base(
    "SELECT paper_id, " + ", ".join(
        f"CASE WHEN topic_id = {t} THEN 1 ELSE 0 END AS topic_{t}" for t in TOPIC_IDS) + " FROM pt"))
def q_topic_onehot(spark, sf_dir):
    return assign.one_hot(stages.papers_topic(spark, sf_dir), TOPIC_IDS)


@register("topic_by_latitude", S.with_base(
    f"SELECT CAST(floor(latitude / {LAT_BAND}) * {LAT_BAND} AS DOUBLE) AS lat_band, topic_id, "
    f"count(*) AS n_papers FROM pt WHERE latitude IS NOT NULL GROUP BY 1, 2"))
def q_topic_by_latitude(spark, sf_dir):
    return stats.topic_by_latitude(stages.papers_topic(spark, sf_dir), LAT_BAND)


@register("dominant_topic_by_latitude", S.with_base(
    f", bands AS (SELECT CAST(floor(latitude / {LAT_BAND}) * {LAT_BAND} AS DOUBLE) AS lat_band, topic_id, "
    f"count(*) AS n_papers FROM pt WHERE latitude IS NOT NULL GROUP BY 1, 2) "
    f"SELECT lat_band, topic_id, n_papers FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY lat_band ORDER BY n_papers DESC, topic_id ASC) AS rn FROM bands) WHERE rn = 1"))
def q_dominant_topic_by_latitude(spark, sf_dir):
    return stats.dominant_topic_by_latitude(stages.papers_topic(spark, sf_dir), LAT_BAND)


@register("top_words", S.with_base(
    f", w AS (SELECT unnest(list_filter(regexp_split_to_array(lower(concat_ws(' ', title, abstract)), '\\s+'), "
    f"lambda t: length(t) > 0)) AS word FROM pt) "
    f"SELECT word, count(*) AS freq FROM w WHERE word NOT IN ({S.COMMON}) "
    f"GROUP BY 1 ORDER BY freq DESC, word ASC LIMIT 10"))
def q_top_words(spark, sf_dir):
    return corpus.top_words(stages.papers_topic(spark, sf_dir), 10)


@register("bag_of_words", S.with_base(
    "SELECT paper_id, term, count(*) AS tf FROM (SELECT paper_id, unnest(tokens) AS term FROM dtok) GROUP BY 1, 2"))
def q_bag_of_words(spark, sf_dir):
    return corpus.bag_of_words(stages.document_tokens(spark, sf_dir))


@register("vocab_df_bounds",
          f", v1 AS (SELECT doc_id, array_to_string({S.tokenize_v1('text')}, ' ') AS processed FROM documents), "
          f"terms AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(list_filter("
          f"regexp_extract_all(lower(processed), '[\\pL\\pN_]{{2,}}'), "
          f"lambda t: NOT list_contains({S.sql_list(S.STOPWORDS_V2)}, t))) AS term FROM v1)), "
          f"dfreq AS (SELECT term, count(*) AS doc_freq FROM terms GROUP BY 1) "
          f"SELECT term, doc_freq FROM dfreq WHERE doc_freq >= 2 AND doc_freq <= 0.95 * "
          f"(SELECT count(*) FROM documents)".replace(", v1 AS", "WITH v1 AS", 1))
def q_vocab_df_bounds(spark, sf_dir):
    docs = fixtures.documents(spark, sf_dir).withColumnRenamed("doc_id", "paper_id")
    v1 = corpus.processed_text(corpus.tokenize_v1(docs, "text"))
    return corpus.vocab_df_bounds(v1, "processed", "paper_id")


_TOP_TERMS_SQL = (
    ", tc AS (SELECT topic_id, term, count(*) AS n FROM (SELECT topic_id, unnest(tokens) AS term FROM pt) "
    "GROUP BY 1, 2), tt AS (SELECT topic_id, CAST(rn - 1 AS INTEGER) AS rank, term, n FROM "
    "(SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, term ASC) AS rn FROM tc) "
    "WHERE rn <= 10) ")


def _top_terms(spark, sf_dir) -> DataFrame:
    pt = stages.papers_topic(spark, sf_dir)
    counts = (pt.select("topic_id", F.explode("tokens").alias("term"))
                .groupBy("topic_id", "term").agg(F.count(F.lit(1)).alias("n")))
    ranked = stats.top_terms_per_group(counts, "topic_id", "term", "n", 10)
    return ranked.select("topic_id", F.col("rank").cast("int").alias("rank"), "term", "n")


@register("top_terms_per_topic", S.with_base(_TOP_TERMS_SQL + "SELECT topic_id, rank, term, n FROM tt"))
def q_top_terms_per_topic(spark, sf_dir):
    return _top_terms(spark, sf_dir)


@register("topic_prompts", S.with_base(
    _TOP_TERMS_SQL + "SELECT topic_id, concat('" + S.q(assign.LABEL_PROMPT_PREFIX)[1:-1]
    + "', string_agg(term, ', ' ORDER BY rank), '.') AS prompt FROM tt GROUP BY 1"))
def q_topic_prompts(spark, sf_dir):
    return assign.label_prompts(_top_terms(spark, sf_dir).select("topic_id", "rank", "term"))


@register("topic_words_long", S.with_base(_TOP_TERMS_SQL + "SELECT topic_id, rank, term FROM tt"))
def q_topic_words_long(spark, sf_dir):
    wide = topic_io.topic_words_to_wide(_top_terms(spark, sf_dir).select("topic_id", "rank", "term"), 10)
    return topic_io.topic_words_to_long(wide)
