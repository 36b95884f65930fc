from pyspark.sql import functions as F

import corpus_pipeline
from litspark.llm import common, decontaminate, packing, pii, quality_rules, simhash

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_near_duplicates", "benchmark_decontamination", "pii_pseudonyms", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert docs.count() <= before
        before = docs.count()


def test_run_equals_the_operators_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    verdict = {r["doc_id"] for r in quality_rules.quality_rules(docs, labels).where("kept").collect()}
    good = docs.where(F.col("doc_id").isin(sorted(verdict)))
    one = {r["component_id"] for r in simhash.near_duplicates(good).collect()}
    leaks = {r["doc_id"] for r in decontaminate.find_contamination(good, bench).collect()}
    want = docs.where(F.col("doc_id").isin(sorted(one - leaks)))
    hidden = pii.pseudonymise(want, corpus_pipeline.PSEUDONYM_KEY)
    digest = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert digest(corpus_pipeline.run(spark, SF)) == digest(packing.pack_documents(hidden))


def test_stages_accept_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
