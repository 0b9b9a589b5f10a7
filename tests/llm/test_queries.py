"""The registered queries: DuckDB's rows where there is SQL, and stable columns for the rest."""

import duckdb
import pytest

from sluice.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
#: Columns that a result begins with.
CONTRACT = {
    "op1_minhash": "doc_id n_shingles component_id kept",
    "op3_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op5_license_diagonals": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op6_suffix_repeats": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op7_additive_model": "doc_id held_out score predicted",
    "op8_site_style_tree": "page_id url text n_chars",
    "op9_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
}


def plain(frame):
    return sorted(tuple("" if v is None or v != v else str(v).removesuffix(".0") for v in r) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and plain(ours[columns]) == plain(theirs[columns])


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns(spark, name):
    out = QUERIES[name](spark, DATA)
    assert out.columns[: len(CONTRACT[name].split())] == CONTRACT[name].split()
    assert out.count() >= spark.read.parquet(f"{DATA}/{'pages' if name.startswith('op8') else 'documents'}.parquet").count()


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
