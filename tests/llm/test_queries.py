"""Every registered query of this subpackage over the smallest tables, and those with SQL against it."""

import os
from collections import Counter

import pytest

from ledgerloom.llm import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")

#: Columns that a query must have, and whether it gives a row a row of its table.
QUERIES = {
    "op1_embeddings": (["vec_id", "n_links", "component_id", "kept"], "embeddings"),
    "op2_minhash": (["doc_id", "n_shingles", "component_id", "kept"], "documents"),
    "op3_mixing": (["doc_id", "size", "source_size", "target", "taken"], "documents"),
    "op4_pii": (["doc_id", "text"], "documents"),
    "op5_quality": (["doc_id", "held_out", "score", "predicted"], "documents"),
    "op6_sharding": (["doc_id", "shard", "shard_rows", "shard_bytes", "text_sha256"], "documents"),
    "op7_substrings": (["doc_id", "text", "n_sentences", "n_removed"], "documents"),
    "op8_sentencepiece": (["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"], "documents"),
    "op9_token_counts": (["source", "lang", "version", "n_docs", "n_tokens", "n_bytes"], None),
    "op10_exact_dedup": (["doc_id", "keep_id", "group_size", "kept", "text_sha256"], "documents"),
    "pipeline": (["doc_id", "n_tokens"], None),
}


def test_all_are_named():
    assert sorted(registry.queries()) == sorted(QUERIES) and set(registry.oracle_sql()) <= set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    import duckdb

    columns, source = QUERIES[name]
    got = registry.queries()[name](spark, SF).collect()
    assert got and set(columns) <= set(got[0].asDict())
    if source:
        assert len(got) == spark.read.parquet(f"{SF}/{source}.parquet").count()
    if sql := registry.oracle_sql().get(name):
        con = duckdb.connect()
        for table in ("documents", "embeddings", "labels"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        result = con.sql(sql)
        names = result.columns
        assert Counter(tuple(r[c] for c in names) for r in got) == Counter(result.fetchall())
