"""Places: gazetteer lookup, substring country matching and density classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.functions import text as T
from litspark.functions.constants import (DENSITY_HIGH, DENSITY_LOW, DENSITY_LOW_BELOW, DENSITY_MEDIUM,
                                          DENSITY_MEDIUM_BELOW, DENSITY_NONE)
from litspark.operators.lookup import DEFAULT_INLINE_ROWS, bounded_rows, scalar
from litspark.operators.patterns import find_all
from litspark.operators.stats import papers_per_affiliation
from litspark.session import stage_table


def _gazetteer_keyed(gazetteer: DataFrame) -> DataFrame:
    """One coordinate pair per lower-cased place (smallest pair when repeated)."""
    return (gazetteer.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
                     .groupBy(F.lower("place").alias("_place"))
                     .agg(F.min(F.struct("latitude", "longitude")).alias("_c"))
                     .select("_place", F.col("_c.latitude").alias("latitude"),
                             F.col("_c.longitude").alias("longitude")))


def geocode_affiliations(df: DataFrame, gazetteer: DataFrame, col: str = "affiliation") -> DataFrame:
    """Distinct affiliations → coordinates of the place after the last comma.

    Equality on the lower-cased place, not a substring match; misses are dropped.
    """
    distinct = df.select(col).filter(F.col(col).isNotNull()).distinct()
    keyed = distinct.withColumn("_place", F.lower(T.last_segment(col)))
    return keyed.join(_gazetteer_keyed(gazetteer), "_place").drop("_place")


def with_coordinates(df: DataFrame, gazetteer: DataFrame, col: str = "affiliation") -> DataFrame:
    """Papers with coordinates (inner join; rows without a place are dropped).

    Joins the papers straight to the gazetteer on the derived place key: the
    same rows as joining the distinct-affiliation lookup back, with one join
    fewer. AQE broadcasts a small gazetteer and splits a hot place otherwise.
    """
    keyed = df.withColumn("_place", F.lower(T.last_segment(col)))
    return keyed.join(_gazetteer_keyed(gazetteer), "_place").drop("_place")


def contains_matches(df: DataFrame, text_col: str, names: DataFrame,
                     max_inline: int = DEFAULT_INLINE_ROWS) -> DataFrame:
    """Rows of ``df`` paired with every name whose lower-case form is a substring of
    the lower-cased ``text_col`` (one output row per match, column ``name``). An
    empty name matches every non-null text; null names and texts match nothing.

    Up to ``max_inline`` names are a literal array and matching is a narrow
    projection. More names are found by an automaton in one pass over each text
    (``patterns.find_all``); the rows are the same, whichever way.
    """
    distinct_names = names.select(F.col(names.columns[0]).alias("name")).filter(
        F.col("name").isNotNull()).distinct()
    rows = bounded_rows(distinct_names, max_inline)
    if rows is None:
        return find_all(df, text_col, distinct_names)
    if not rows:
        return df.withColumn("name", F.lit("")).limit(0)
    low = F.lower(F.col(text_col))
    pairs = F.array(*[F.struct(F.lit(r[0]).alias("name"), F.lower(F.lit(r[0])).alias("low")) for r in rows])
    return df.withColumn("_hit", F.explode(F.filter(pairs, lambda n: low.contains(n["low"])))).withColumn(
        "name", F.col("_hit.name")).drop("_hit")


def country_paper_count(df: DataFrame, countries: DataFrame, country_col: str = "country",
                        max_inline: int = DEFAULT_INLINE_ROWS) -> DataFrame:
    """Papers per country: the sum of per-affiliation title counts over every
    affiliation containing the country name; 0 when none. One affiliation can
    count for several countries (substring semantics)."""
    return _country_counts(papers_per_affiliation(df), countries, country_col, max_inline)


def _country_counts(per_aff: DataFrame, countries: DataFrame, country_col: str, max_inline: int) -> DataFrame:
    matched = contains_matches(per_aff, "affiliation", countries.select(country_col), max_inline)
    per_name = matched.groupBy(F.col("name").alias(country_col)).agg(F.sum("n_papers").alias("_n"))
    return (countries.join(per_name, country_col, "left")
                     .select(F.col(country_col).alias("country"),
                             F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("paper_count")))


def density_class(value: Column, max_value: Column) -> Column:
    ratio = value / max_value
    return (F.when(value.isNull() | (value == 0), F.lit(DENSITY_NONE))
             .when(ratio < DENSITY_LOW_BELOW, F.lit(DENSITY_LOW))
             .when(ratio < DENSITY_MEDIUM_BELOW, F.lit(DENSITY_MEDIUM))
             .otherwise(F.lit(DENSITY_HIGH)))


def country_density(df: DataFrame, countries: DataFrame, country_col: str = "country",
                    max_inline: int = DEFAULT_INLINE_ROWS) -> DataFrame:
    """Country counts with their density class. The reference maximum is the
    largest per-affiliation count (1 when there is none), so a country sum can
    exceed it; the class saturates at High."""
    per_aff = stage_table(papers_per_affiliation(df), "per-affiliation")  # one row per affiliation; read twice
    max_count = scalar(per_aff.agg(F.max("n_papers"))) or 1
    counts = _country_counts(per_aff, countries, country_col, max_inline)
    return counts.withColumn("density_class", density_class(F.col("paper_count"), F.lit(max_count)))


def region_countries(features: DataFrame, region_list: DataFrame, name_col: str = "country") -> DataFrame:
    """Features whose name is in the region's country list (left semi join)."""
    return features.join(region_list.select(F.col(region_list.columns[0]).alias(name_col)), name_col, "left_semi")
