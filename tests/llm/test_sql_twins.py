"""Queries with an SQL twin, over whole tables, and what all queries promise about their columns."""

import math

import duckdb
import pytest

from pavilion.llm import queries

SF = "/root/testdata/sf0.01"
TABLES = ("documents", "embeddings", "pages", "benchmark", "conversations")
COLUMNS = {
    "op1_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op2_language_id": "doc_id held_out lang_pred score",
    "op3_mixing": "doc_id size source_size target taken", "op4_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op5_minhash_dedup": "doc_id n_shingles component_id kept", "op6_exact_topk": "query_id rank vec_id score",
    "op7_embedding_dedup": "vec_id n_links component_id kept", "op8_url_filter": "page_id host path rule verdict",
    "op9_warc": "page_id payload_bytes payload_digest record_type refers_to", "op10_repeated_phrases": "doc_id n_words n_removed kept_sha256",
    "op11_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op12_token_records": "doc_id start n_tokens ids_crc32",
    "op13_conversation_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
}


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return "~" if v is None else str(v)


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.ENTRIES.items() if sql])
def test_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    run, sql = queries.ENTRIES[name]
    df = run(spark, SF)
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    got = sorted(tuple(value(r[c]) for c in order) for r in df.collect())
    assert got == sorted(tuple(value(r[names.index(c)]) for c in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = queries.ENTRIES[name][0](spark, "/root/testdata/sf0.001")
    wanted = COLUMNS[name].split()
    assert df.columns[:len(wanted)] == wanted


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.ENTRIES) == list(range(1, 14))
