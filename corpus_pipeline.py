"""The corpus pipeline: quality rules, near-duplicates, decontamination, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All but the last return rows with the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from litspark.llm import common, decontaminate, packing, pii, quality_rules, simhash
from litspark.llm.queries import PSEUDONYM_KEY


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, PSEUDONYM_KEY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", drop_low_quality),
    ("simhash_near_duplicates", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("pii_pseudonyms", hide_personal_data),
    ("best_fit_packing", pack),
]

#: Exact binomial bounds, XXH64 fingerprints, alignments, SHA-512 networks and a
#: tokenizer have no DuckDB form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written as Parquet to the
    shared folder and read again as the next one's documents. A stage's table is
    removed once the next one is written; the last, which the result reads, stays."""
    docs, path = common.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        written = common.write_scratch(kept, f"pipeline-{name}")
        docs = spark.read.schema(kept.schema).parquet(written)
        if path:
            common.remove(spark, path)
        path = written
    return STAGES[-1][1](spark, docs, sf_dir)
