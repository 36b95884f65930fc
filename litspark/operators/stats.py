"""Dashboard analytics over the labelled paper table.

Every panel is a Column predicate or a hash aggregate (partial aggregation on
the map side); ties in every ranking are broken by the name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litspark.functions.constants import ALL_REGIONS, REGION_COUNTRIES
from litspark.operators.lookup import DEFAULT_INLINE_ROWS


def search(df: DataFrame, query: str, cols=("assigned_topic", "title")) -> DataFrame:
    """Rows where any whitespace word of ``query`` is a case-insensitive substring
    of any of ``cols``. Empty query → all rows; whitespace-only → no rows; null
    never matches."""
    if not query:
        return df
    words = query.split()
    if not words:
        return df.filter(F.lit(False))
    hits = [F.coalesce(F.lower(F.col(c)).contains(w.lower()), F.lit(False)) for w in words for c in cols]
    return df.filter(reduce(lambda a, b: a | b, hits))


def country_pattern(names: list[str], word_boundary: bool = False) -> str:
    alternation = "|".join(names)
    return f"(?iu)\\b(?:{alternation})\\b" if word_boundary else "(?iu)" + alternation


def in_region(df: DataFrame, countries, col: str = "affiliation",
              max_inline: int = DEFAULT_INLINE_ROWS, word_boundary: bool = False) -> DataFrame:
    """Keep rows whose ``col`` matches the alternation of the country names
    (case-insensitive, names as written); null → dropped. By default a name
    matches inside a longer word ("UK" in "Ukraine"); ``word_boundary=True``
    requires whole words.

    ``countries`` is a region name of the built-in dictionary, ``"All"``, a list
    of names, or a one-column DataFrame of names of any size (literal text,
    matched in lower case against the distinct values of ``col``).
    """
    if isinstance(countries, str):
        if countries == ALL_REGIONS:
            return df
        countries = REGION_COUNTRIES[countries]
    if isinstance(countries, DataFrame):
        return _in_named_region(df, countries, col, max_inline, word_boundary)
    if not countries:
        return df.filter(F.lit(False))
    return df.filter(F.coalesce(F.col(col).rlike(country_pattern(countries, word_boundary)), F.lit(False)))


def _in_named_region(df: DataFrame, names: DataFrame, col: str, max_inline: int, word_boundary: bool) -> DataFrame:
    from litspark.operators.geo import contains_matches
    matched = contains_matches(df.select(col).filter(F.col(col).isNotNull()).distinct(), col, names, max_inline)
    if word_boundary:
        matched = matched.filter(F.regexp_like(F.col(col), F.concat(F.lit("(?iu)\\b\\Q"), F.col("name"), F.lit("\\E\\b"))))
    return df.join(matched.select(col).distinct(), col, "left_semi").select(*df.columns)


def kpis(df: DataFrame) -> DataFrame:
    """Total papers, distinct affiliations (null counts as one value), year range."""
    return df.agg(
        F.count(F.lit(1)).alias("total_papers"),
        (F.count_distinct("affiliation") + F.coalesce(F.max(F.col("affiliation").isNull().cast("int")), F.lit(0))).cast("long")
        .alias("n_affiliations"),
        F.concat_ws(" - ", F.min("year").cast("string"), F.max("year").cast("string")).alias("year_range"),
    )


def papers_per_affiliation(df: DataFrame) -> DataFrame:
    return (df.filter(F.col("affiliation").isNotNull())
              .groupBy("affiliation").agg(F.count("title").alias("n_papers")))


def affiliation_sizes(df: DataFrame) -> DataFrame:
    return (df.filter(F.col("affiliation").isNotNull())
              .groupBy("affiliation").agg(F.count(F.lit(1)).alias("n_rows")))


def topic_distribution(df: DataFrame, topic_col: str = "assigned_topic") -> DataFrame:
    return (df.filter(F.col(topic_col).isNotNull())
              .groupBy(F.col(topic_col).alias("topic")).agg(F.count(F.lit(1)).alias("n_papers"))
              .orderBy(F.desc("n_papers"), F.asc("topic")))


def top_topics(df: DataFrame, n: int = 5, topic_col: str = "assigned_topic") -> DataFrame:
    return topic_distribution(df, topic_col).limit(n)


def papers_by_year(df: DataFrame) -> DataFrame:
    return (df.filter(F.col("year").isNotNull())
              .groupBy("year").agg(F.count("title").alias("n_papers")).orderBy("year"))


def top_institutions(df: DataFrame, n: int = 5, topic_col: str = "assigned_topic") -> DataFrame:
    return (df.filter(F.col("affiliation").isNotNull())
              .groupBy("affiliation")
              .agg(F.count("title").alias("n_papers"), F.count_distinct(topic_col).alias("unique_topics"))
              .orderBy(F.desc("n_papers"), F.asc("affiliation")).limit(n))


def topic_pivot(df: DataFrame, topic_ids: list[int], row_col: str = "affiliation",
                topic_col: str = "topic_id") -> DataFrame:
    """row × topic counts, 0 when absent; explicit pivot values (no extra job)."""
    out = (df.filter(F.col(row_col).isNotNull())
             .groupBy(row_col).pivot(topic_col, topic_ids).agg(F.count(F.lit(1))))
    renamed = out.select(row_col, *[F.col(str(t)).alias(f"topic_{t}") for t in topic_ids])
    return renamed.na.fill(0)


def latitude_band(col: str = "latitude", width: float = 10.0):
    return (F.floor(F.col(col) / width) * width).cast("double")


def topic_by_latitude(df: DataFrame, width: float = 10.0, topic_col: str = "topic_id") -> DataFrame:
    return (df.filter(F.col("latitude").isNotNull())
              .groupBy(latitude_band("latitude", width).alias("lat_band"), F.col(topic_col).alias("topic_id"))
              .agg(F.count(F.lit(1)).alias("n_papers")))


def dominant_topic_by_latitude(df: DataFrame, width: float = 10.0, topic_col: str = "topic_id") -> DataFrame:
    """Most frequent topic per band; ties → lowest topic id."""
    counts = topic_by_latitude(df, width, topic_col)
    best = F.max(F.struct("n_papers", (-F.col("topic_id")).alias("neg")))
    return (counts.groupBy("lat_band").agg(best.alias("b"))
                  .select("lat_band", (-F.col("b.neg")).cast("int").alias("topic_id"),
                          F.col("b.n_papers").alias("n_papers")))


def top_terms_per_group(df: DataFrame, group_col: str, term_col: str, weight_col: str, n: int) -> DataFrame:
    """Top-n terms per group by weight desc, term asc.

    ``row_number() ≤ n`` lets Spark insert a partial group limit before the
    shuffle, so a group holding most rows still ships only n rows per task.
    """
    w = Window.partitionBy(group_col).orderBy(F.desc(weight_col), F.asc(term_col))
    return (df.withColumn("_rn", F.row_number().over(w))
              .filter(F.col("_rn") <= n)
              .withColumn("rank", F.col("_rn") - 1).drop("_rn"))
