"""Paper cleaning: markup, whitespace, recency cut, prefix, duplicates, affiliations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.functions import text as T
from litspark.functions.constants import CUTOFF_YEAR, NON_INSTITUTION_AFFILIATIONS

SOURCE_COLUMNS = ["title", "affiliation", "year", "abstract"]


def clean_text_columns(df: DataFrame, cols=("title", "abstract")) -> DataFrame:
    """Markup removal followed by whitespace normalisation on each column."""
    return df.withColumns({c: T.clean_paragraphs(T.clean_html(c)) for c in cols if c in df.columns})


def after_year(df: DataFrame, cutoff: int = CUTOFF_YEAR, col: str = "year") -> DataFrame:
    """Keep ``year > cutoff``; a null year is dropped."""
    return df.filter(F.col(col) > F.lit(cutoff))


def year_cut_report(df: DataFrame, cutoff: int = CUTOFF_YEAR, col: str = "year") -> DataFrame:
    """Rows removed / remaining by the recency cut, in one pass (null in neither)."""
    return df.agg(
        F.count_if(F.col(col) <= cutoff).cast("long").alias("rows_removed"),
        F.count_if(F.col(col) > cutoff).cast("long").alias("rows_remaining"),
    )


def strip_prefix(df: DataFrame, col: str = "abstract") -> DataFrame:
    return df.withColumn(col, T.strip_abstract_prefix(col))


def row_digest(cols) -> Column:
    """32-byte digest of several columns; null, empty and shifted values differ."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")),
                        F.lit("-")) for c in cols]
    return F.unhex(F.sha2(F.concat_ws(",", *parts), 256))


def dedup_rows(df: DataFrame, keys=SOURCE_COLUMNS, id_col: str = "paper_id") -> DataFrame:
    """Distinct rows over ``keys``; the survivor is the one with the smallest id.

    Rows are ranked by a 32-byte digest of the keys, so sorting never compares
    texts. Spark keeps the first row of each digest in every task before the
    shuffle, so a group of copies that holds a large share of the rows reaches
    the final task as one row per input task.
    """
    rest = [c for c in df.columns if c not in keys and c != id_col]
    order = Window.partitionBy("_digest").orderBy(id_col, *rest)
    ranked = df.withColumn("_digest", row_digest(keys)).withColumn("_rn", F.row_number().over(order))
    return ranked.filter(F.col("_rn") == 1).select(id_col, *keys, *rest)


def drop_affiliations(df: DataFrame, names=NON_INSTITUTION_AFFILIATIONS, col: str = "affiliation") -> DataFrame:
    """Drop rows whose lower-cased affiliation is in ``names``; null is kept."""
    hit: Column = F.lower(F.col(col)).isin(*[n.lower() for n in names])
    return df.filter(~F.coalesce(hit, F.lit(False)))


def drop_missing(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.dropna(subset=subset)


def clean_papers(df: DataFrame, cutoff: int = CUTOFF_YEAR,
                 drop_names=NON_INSTITUTION_AFFILIATIONS, id_col: str = "paper_id") -> DataFrame:
    """Whole cleaning stage.

    The recency cut runs first: it does not depend on the cleaned text, and
    it keeps the rows it removes away from the entity decoder.
    """
    out = after_year(df, cutoff)
    out = clean_text_columns(out)
    out = strip_prefix(out)
    out = dedup_rows(out, SOURCE_COLUMNS, id_col)
    return drop_affiliations(out, drop_names)


def profile_nulls(df: DataFrame) -> DataFrame:
    """Row count and non-null count per column in one aggregate."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  *[F.count(F.col(c)).alias(f"nonnull_{c}") for c in df.columns])
