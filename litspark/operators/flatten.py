"""Flattening of nested sources into the flat paper table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.functions import text as T
from litspark.functions.constants import RELEVANCE_KEYWORDS


def flatten_works(items: DataFrame) -> DataFrame:
    """Works items → (title, affiliation, year, abstract).

    Kept only with: at least one author, a first author with at least one
    affiliation whose first name is set, a published date whose first part is
    set, and a non-empty abstract. Text fields are trimmed; first title wins.
    """
    first_author = F.get(F.col("author"), 0)
    first_aff = F.get(first_author["affiliation"], 0)
    first_part = F.get(F.get(F.col("published")["date-parts"], 0), 0)
    keep = (F.coalesce(F.size("author") > 0, F.lit(False))
            & F.coalesce(F.size(first_author["affiliation"]) > 0, F.lit(False))
            & F.col("published").isNotNull()
            & F.coalesce(F.col("abstract") != "", F.lit(False))
            & first_part.isNotNull()
            & first_aff["name"].isNotNull())
    return items.filter(keep).select(
        T.unicode_trim(F.get(F.col("title"), 0)).alias("title"),
        T.unicode_trim(first_aff["name"]).alias("affiliation"),
        first_part.alias("year"),
        T.unicode_trim("abstract").alias("abstract"),
    )


def _as_json_array(raw: Column) -> Column:
    """Raw JSON text that is an object or an array → text of an array."""
    t = F.ltrim(raw)
    return F.when(t.startswith("["), t).when(t.startswith("{"), F.concat(F.lit("["), t, F.lit("]")))


def _group_organization(org_raw: Column) -> Column:
    """Organisation of one author group: the last entry of a list, or the single
    object's ``$``; anything else is null."""
    entries = F.from_json(_as_json_array(org_raw), "array<struct<`$`: string>>")
    return F.try_element_at(entries, F.lit(-1))["$"]


def organizations(author_group_raw: Column) -> Column:
    """All non-empty organisations over the author groups, in group order."""
    groups = F.from_json(_as_json_array(author_group_raw), "array<struct<affiliation: struct<organization: string>>>")
    orgs = F.transform(groups, lambda g: _group_organization(g["affiliation"]["organization"]))
    return F.filter(orgs, lambda o: o.isNotNull() & (o != ""))


def flatten_records(records: DataFrame) -> DataFrame:
    """Nested abstract records → (filename, title, organization, year, abstracts).

    ``organization`` is the first non-empty organisation (null when none);
    ``year`` is the delivery year.
    """
    item = F.col("abstracts-retrieval-response")["item"]
    head = item["bibrecord"]["head"]
    year = item["ait:process-info"]["ait:date-delivered"]["@year"]
    return records.select(
        "filename",
        head["citation-title"].alias("title"),
        F.get(organizations(head["author-group"]), 0).alias("organization"),
        year.cast("int").alias("year"),
        head["abstracts"].alias("abstracts"),
    )


def relevant(df: DataFrame, col: str, keywords: list[str] | None = None) -> DataFrame:
    """Rows whose ``col`` contains any keyword, case-insensitive; null/empty → no."""
    kws = RELEVANCE_KEYWORDS if keywords is None else keywords
    if not kws:
        return df.filter(F.lit(False))
    low = F.lower(F.col(col))
    hit = reduce(lambda a, b: a | b, [low.contains(k.lower()) for k in kws])
    return df.filter(F.coalesce(hit & (F.length(F.col(col)) > 0), F.lit(False)))
