"""Registered queries of this subpackage: name → (callable, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.llm import (decontaminate, kneser_ney, langid, lexical_search, licenses, line_dedup, packing, pii, preference,
                          prefix_trie, quality_rules, sharding, simhash)
from litspark.llm.common import documents

#: Key of the registered pseudonym queries; a deployment passes its own secret.
PSEUDONYM_KEY = "example-key-not-for-production"


def op1_benchmark_decontamination(spark, sf_dir):
    return decontaminate.find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_language_id(spark, sf_dir):
    return langid.identify(documents(spark, sf_dir))


def op3_pii_pseudonyms(spark, sf_dir):
    out = pii.pseudonymise(documents(spark, sf_dir), PSEUDONYM_KEY, found_col="found")
    return out.select("doc_id", "text", F.size("found").alias("n_found"))


def op4_preference_formatting(spark, sf_dir):
    return preference.format_pairs(preference.stale_reply_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op5_license_scan(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


def op6_hash_tree_sharding(spark, sf_dir):
    tree = sharding.regular(regions=2, racks=2, shards=4)
    out = sharding.assign(documents(spark, sf_dir), tree, sharding.grow(tree))
    return out.withColumn("law", F.lit("key"))


def op7_kneser_ney_quality(spark, sf_dir):
    return kneser_ney.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_quality_rules(spark, sf_dir):
    out = quality_rules.quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "stratum")


def op9_simhash_near_duplicates(spark, sf_dir):
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op10_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_reversed_search(spark, sf_dir):
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    "op1_benchmark_decontamination": (op1_benchmark_decontamination, None),
    "op2_language_id": (op2_language_id, None),
    "op3_pii_pseudonyms": (op3_pii_pseudonyms, None),
    "op4_preference_formatting": (op4_preference_formatting, preference.ORACLE_SQL),
    "op5_license_scan": (op5_license_scan, licenses.oracle_sql()),
    "op6_hash_tree_sharding": (op6_hash_tree_sharding, None),
    "op7_kneser_ney_quality": (op7_kneser_ney_quality, None),
    "op8_quality_rules": (op8_quality_rules, None),
    "op9_simhash_near_duplicates": (op9_simhash_near_duplicates, None),
    "op10_best_fit_packing": (op10_best_fit_packing, None),
    "op11_prefix_trie": (op11_prefix_trie, prefix_trie.ORACLE_SQL),
    "op12_reversed_search": (op12_reversed_search, lexical_search.ORACLE_SQL),
    "op13_line_dedup": (op13_line_dedup, line_dedup.ORACLE_SQL),
}
