"""Incremental ingest of landed works-API pages with Structured Streaming.

The acquisition loop lands one JSON page per file. This query picks up new
files as they arrive, flattens and cleans them with the same stateless
column functions as the batch path, and appends to a parquet table. Progress
lives in a checkpoint folder under the shared ``spark.checkpoint.dir``, so a
restarted or failed run resumes exactly where it stopped.

Duplicate removal is left to the batch stage: without an event-time column a
streaming dedup would have to keep every key in state forever.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from litspark.functions.constants import CUTOFF_YEAR
from litspark.operators import clean, flatten
from litspark.session import checkpoint_dir
from litspark.sources.files import WORKS_PAGE_SCHEMA


def cleaned_work_stream(spark: SparkSession, landing_dir: str, cutoff: int = CUTOFF_YEAR,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(WORKS_PAGE_SCHEMA).option("multiLine", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    from pyspark.sql import functions as F
    items = reader.json(landing_dir).select(F.inline(F.col("message.items")))
    flat = flatten.flatten_works(items)
    out = clean.after_year(flat, cutoff)
    out = clean.clean_text_columns(out)
    out = clean.strip_prefix(out)
    return clean.drop_affiliations(out)


def start_ingest(spark: SparkSession, landing_dir: str, table_dir: str, name: str = "works_ingest",
                 checkpoint_location: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Append cleaned items of newly landed pages to ``table_dir`` (parquet)."""
    location = checkpoint_location or os.path.join(checkpoint_dir(spark), "streams", name)
    writer = (cleaned_work_stream(spark, landing_dir).writeStream.format("parquet")
              .option("path", table_dir).option("checkpointLocation", location).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
