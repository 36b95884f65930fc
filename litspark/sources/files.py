"""File sources: paper CSVs, nested JSON record trees, landed works-API pages, GeoJSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.session import small_file_tasks
from litspark.sources.csv_records import csv_records

PAPERS_CSV_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("affiliation", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("abstract", T.StringType()),
])

CORRUPT = "_corrupt_record"
_NO_NULL_TOKEN = "\u0000"
_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_papers_csv(spark: SparkSession, path: str, schema: T.StructType = PAPERS_CSV_SCHEMA,
                    bad_lines: str = "error") -> DataFrame:
    """CSV with a header; quoted fields may hold newlines and doubled quotes. A file is read
    in as many tasks as its size asks for (``csv_records``).

    A line with fewer fields than the schema is kept (missing fields null), as a
    pandas reader does. A line with more fields fails the read (``bad_lines="error"``,
    the default) or is left out (``bad_lines="skip"``).
    """
    wide = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    options = {"escape": '"', "quote": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    raw = csv_records(spark, path).select(F.from_csv("record", wide.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("r.*")
    # Re-parse a malformed line with one more column than the schema: if that
    # column is filled, the line had too many fields.
    probe = ", ".join(f"_c{i} string" for i in range(len(schema.fields) + 1))
    extra = F.from_csv(F.col(CORRUPT), probe, {"escape": '"', "nullValue": _NO_NULL_TOKEN})[
        f"_c{len(schema.fields)}"]
    too_long = F.col(CORRUPT).isNotNull() & extra.isNotNull()
    if bad_lines == "error":
        message = F.concat(F.lit("a line has too many fields: "), F.substring(F.col(CORRUPT), 1, 200))
        keep = F.when(too_long, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
        return raw.filter(keep).drop(CORRUPT)
    return raw.filter(~too_long).drop(CORRUPT)


def paper_key(df: DataFrame, cols=("title", "affiliation", "year", "abstract"), out_col: str = "paper_id") -> DataFrame:
    """``df`` with a stable key: the hex digest of the source columns (null-safe). Equal
    rows share a key, so it is unique once duplicates are removed."""
    from litspark.operators.clean import row_digest
    return df.withColumn(out_col, F.lower(F.hex(row_digest(cols))))


# ---------------------------------------------------------------------------
# Nested abstract records (one JSON object per file, tree of folders)
# ---------------------------------------------------------------------------

RECORD_SCHEMA = T.StructType([
    T.StructField("abstracts-retrieval-response", T.StructType([
        T.StructField("item", T.StructType([
            T.StructField("ait:process-info", T.StructType([
                T.StructField("ait:date-delivered", T.StructType([
                    T.StructField("@year", T.StringType())]))])),
            T.StructField("bibrecord", T.StructType([
                T.StructField("head", T.StructType([
                    # object or array in the source: captured as raw JSON text
                    T.StructField("author-group", T.StringType()),
                    T.StructField("abstracts", T.StringType()),
                    T.StructField("citation-title", T.StringType()),
                ]))])),
        ]))])),
])


def relative_name(spark: SparkSession, uri: Column, base: str) -> Column:
    """The decoded part of a file's URI below ``base``, whatever scheme the two are written with."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    qualified = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    prefix = re.sub("^([A-Za-z][A-Za-z0-9+.-]*):/+", r"\1:/", qualified.getScheme() + ":" + (
        f"//{qualified.getAuthority()}" if qualified.getAuthority() else "") + qualified.getPath()).rstrip("/") + "/"
    # only %-escapes are decoded: a plus sign in a name stays one
    plain = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    plain = F.regexp_replace(plain, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")
    return F.when(plain.startswith(prefix), F.substring(plain, len(prefix) + 1, 1 << 30)).otherwise(plain)


def read_json_tree(spark: SparkSession, base: str, schema: T.StructType = RECORD_SCHEMA,
                   glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """All files named like ``glob`` below ``base`` (any depth), one object per file.

    Returns (records, rejects): records carry ``filename`` relative to
    ``base``; rejects are the files that did not parse.
    """
    with_corrupt = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    # Spark lists up to 10,000 folders in a task each: here a task lists many
    most = spark.conf.get(_LISTING_TASKS)
    spark.conf.set(_LISTING_TASKS, str(min(int(most), 4 * spark.sparkContext.defaultParallelism)))
    try:
        raw = (spark.read.schema(with_corrupt).option("multiLine", True)
               .option("recursiveFileLookup", True).option("pathGlobFilter", glob)
               .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(base))
    finally:
        spark.conf.set(_LISTING_TASKS, most)
    raw = raw.withColumn("filename", relative_name(spark, F.col("_metadata.file_path"), base))
    # a scan's partition ends after some 32 files: a task takes many
    raw = raw.coalesce(small_file_tasks(spark))
    bad = F.col(CORRUPT).isNotNull()
    # Spark refuses scans that need only the corrupt-record column, so the
    # rejects also carry a (null) flag read from the first data field.
    parsed_flag = F.col(schema.fields[0].name).isNotNull().alias("parsed")
    rejects = raw.filter(bad).select("filename", F.col(CORRUPT).alias("raw_text"), parsed_flag)
    return raw.filter(~bad).drop(CORRUPT), rejects


def records_from_strings(df: DataFrame, body_col: str = "body", schema: T.StructType = RECORD_SCHEMA
                         ) -> DataFrame:
    """Parse record bodies held in a string column (same shape as the files)."""
    parsed = F.from_json(F.col(body_col), schema)
    return df.select(*[c for c in df.columns if c != body_col], parsed.alias("_r")).select(
        *[c for c in df.columns if c != body_col], "_r.*")


def split_records(df: DataFrame, body_col: str = "body", schema: T.StructType = RECORD_SCHEMA
                  ) -> tuple[DataFrame, DataFrame]:
    """Record bodies in a string column → (records, rejects), as ``read_json_tree`` splits
    files: rejects are the bodies that are no JSON object."""
    with_corrupt = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    keys = [c for c in df.columns if c != body_col]
    parsed = df.select(*keys, F.from_json(F.col(body_col), with_corrupt, {"columnNameOfCorruptRecord": CORRUPT}).alias("_r"),
                       F.col(body_col).alias("_raw"))
    bad = F.col("_r").isNull() | F.col(f"_r.{CORRUPT}").isNotNull()
    good = parsed.filter(~bad).select(*keys, *[F.col("_r")[f.name].alias(f.name) for f in schema.fields])
    return good, parsed.filter(bad).select(*keys, F.col("_raw").alias("raw_text"))


# ---------------------------------------------------------------------------
# Works-API pages (landed JSON, one page per file or per row)
# ---------------------------------------------------------------------------

WORKS_ITEM = T.StructType([
    T.StructField("title", T.ArrayType(T.StringType())),
    T.StructField("author", T.ArrayType(T.StructType([
        T.StructField("affiliation", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType())])))]))),
    T.StructField("published", T.StructType([
        T.StructField("date-parts", T.ArrayType(T.ArrayType(T.IntegerType())))])),
    T.StructField("abstract", T.StringType()),
])

WORKS_PAGE_SCHEMA = T.StructType([
    T.StructField("message", T.StructType([
        T.StructField("items", T.ArrayType(WORKS_ITEM)),
        T.StructField("next-cursor", T.StringType()),
    ])),
])


def read_work_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed works-API pages (one JSON document per file) → one row per item."""
    pages = spark.read.schema(WORKS_PAGE_SCHEMA).option("multiLine", True).json(path)
    return pages.select(F.inline(F.col("message.items")))


def work_items_from_strings(df: DataFrame, body_col: str = "body") -> DataFrame:
    """Page bodies held in a string column → one row per item (pages concatenated)."""
    parsed = F.from_json(F.col(body_col), WORKS_PAGE_SCHEMA)
    return df.select(F.inline(parsed["message"]["items"]))


# ---------------------------------------------------------------------------
# GeoJSON feature collections
# ---------------------------------------------------------------------------

GEOJSON_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", T.StructType([T.StructField("name", T.StringType())])),
    ]))),
])


def read_geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature collection file(s) → one row per feature with its ``country`` name."""
    fc = spark.read.schema(GEOJSON_SCHEMA).option("multiLine", True).json(path)
    return fc.select(F.explode("features").alias("f")).select(F.col("f.properties.name").alias("country"))


GEOJSON_SHAPES = T.StructType([
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", T.StructType([T.StructField("name", T.StringType())])),
        # the nesting of the coordinates depends on the type: captured as JSON text
        T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
    ]))),
])


def read_geojson_rings(spark: SparkSession, path: str) -> DataFrame:
    """Feature collection file(s) → one row per ring: (country, polygon, ring, points). Ring 0 of a
    polygon is its outline, others are holes; points are (longitude, latitude) pairs. Features without
    a Polygon or MultiPolygon have no rows."""
    fc = spark.read.schema(GEOJSON_SHAPES).option("multiLine", True).json(path)
    shape = fc.select(F.explode("features").alias("f")).select(
        F.col("f.properties.name").alias("country"), F.col("f.geometry.type").alias("type"),
        F.col("f.geometry.coordinates").alias("coordinates"))
    one, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    polygons = (F.when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", one)))
                .when(F.col("type") == "MultiPolygon", F.from_json("coordinates", many)))
    rings = shape.select("country", F.posexplode(polygons).alias("polygon", "_rings"))
    return rings.select("country", "polygon", F.posexplode("_rings").alias("ring", "points"))
