"""Every registered query of the subpackage: columns, and its SQL where it has one."""

import pytest

from litspark.llm.queries import QUERIES
from litspark.plans.oracle_check import compare, duckdb_connection, rows_of

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op6_hash_tree_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op8_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op9_simhash_near_duplicates": ["doc_id", "fingerprint", "component_id"],
    "op10_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    query, sql = QUERIES[name]
    out = query(spark, SF)
    assert set(COLUMNS.get(name, out.columns)) <= set(out.columns)
    rows = rows_of(out)
    assert len(rows)
    if sql:
        ok, message = compare(rows, duckdb_connection(SF).execute(sql).df())
        assert ok, message
