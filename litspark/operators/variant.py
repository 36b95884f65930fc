"""Nested records as VARIANT: each body is parsed once, and leaves are taken by path.

A leaf that is an object in one record and a list in another needs no second parse and no
fixed schema; ``try_variant_get`` gives null where a path does not lead to the asked type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = "$['abstracts-retrieval-response'].item.bibrecord.head"
YEAR = "$['abstracts-retrieval-response'].item['ait:process-info']['ait:date-delivered']['@year']"


def parse(df: DataFrame, body_col: str = "body", out_col: str = "record") -> DataFrame:
    """``df`` with its bodies as VARIANT; a body that is no JSON is null."""
    return df.withColumn(out_col, F.try_parse_json(body_col)).drop(body_col)


def entries(value: Column) -> Column:
    """A list's entries, or a single value as a list of one; null and missing are empty."""
    kind = F.schema_of_variant(value)
    listed = F.try_variant_get(value, "$", "array<variant>")
    return F.when(value.isNull() | F.is_variant_null(value), F.array().cast("array<variant>")).when(
        kind.startswith("ARRAY"), listed).otherwise(F.array(value))


def organizations(groups: Column) -> Column:
    """Non-empty organisations of an author group or a list of them: of each group the last entry's."""
    def last(group: Column) -> Column:
        found = F.try_element_at(entries(F.try_variant_get(group, "$.affiliation.organization", "variant")), F.lit(-1))
        return F.try_variant_get(found, "$['$']", "string")

    return F.filter(F.transform(entries(groups), last), lambda o: o.isNotNull() & (o != ""))


def flatten_records(records: DataFrame, record_col: str = "record") -> DataFrame:
    """Records (filename, VARIANT) → (filename, title, organization, year, abstracts), as
    ``flatten.flatten_records`` makes them of parsed structs."""
    def at(path: str, kind: str) -> Column:
        return F.try_variant_get(F.col(record_col), path, kind)

    return records.select(
        "filename", at(f"{HEAD}['citation-title']", "string").alias("title"),
        F.get(organizations(at(f"{HEAD}['author-group']", "variant")), 0).alias("organization"),
        at(YEAR, "int").alias("year"), at(f"{HEAD}.abstracts", "string").alias("abstracts"))


def schema_profile(records: DataFrame, record_col: str = "record", paths: dict[str, str] | None = None) -> DataFrame:
    """(path, kind, n_records): how often each kind of value stands at each path (``missing`` if none does)."""
    asked = paths or {"author-group": f"{HEAD}['author-group']", "title": f"{HEAD}['citation-title']", "year": YEAR}
    kinds = []
    for name, path in asked.items():
        value = F.try_variant_get(F.col(record_col), path, "variant")
        kind = F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit("missing"))
        kinds.append(F.struct(F.lit(name).alias("path"), kind.alias("kind")))
    rows = records.select(F.explode(F.array(*kinds)).alias("p"))
    return rows.groupBy("p.path", "p.kind").agg(F.count("*").alias("n_records"))
