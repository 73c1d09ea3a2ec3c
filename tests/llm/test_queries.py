"""Registered queries on the smallest tables: against their SQL, or their columns and rows."""

import pytest
from oracle_check import compare, duck

from knotwork.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op2_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op3_decontamination": "doc_id item_id",
    "op4_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op6_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op8_toxicity": "doc_id held_out score predicted",
    "op9_near_dedup": "doc_id n_shingles component_id kept",
    "op10_html_text": "page_id url text n_chars",
    "op11_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op12_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op13_multi_index": "query_id rank vec_id score",
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_rows(spark, name):
    got = QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(got.columns)
    if name not in ("op3_decontamination", "op13_multi_index"):
        table = "pages" if name in ("op1_warc", "op10_html_text") else "documents"
        assert got.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, name):
    ok, _, _, note = compare(spark, duck(SF), SF, name, QUERIES[name], ORACLES[name])
    assert ok, note
