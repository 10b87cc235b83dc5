"""Registered queries against their SQL, and edges of the catalog."""

import os
from decimal import Decimal

import duckdb
import pytest

from cardflow.llm import oracles, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.all_queries())
    assert numbers == list(range(1, 14)) and set(oracles.all_oracles()) < set(queries.all_queries())


@pytest.mark.parametrize("name", sorted(oracles.all_oracles()))
def test_query_equals_sql(spark, duck, name):
    df = queries.all_queries()[name](spark, DATA)
    result = duck.execute(oracles.all_oracles()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)

    def ordered(rows, columns):
        places = [columns.index(n) for n in sorted(columns)]
        return sorted((tuple(float(r[i]) if isinstance(r[i], Decimal) else r[i] for i in places) for r in rows), key=repr)

    assert ordered(df.collect(), df.columns) == ordered(result.fetchall(), names)


CONTRACT = {
    "op3_url_filters": ["page_id", "host", "path", "rule", "verdict"],
    "op4_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op5_token_ids": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op6_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op9_ngram_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op10_mixing": ["doc_id", "size", "source_size", "target", "taken"],
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract_columns(spark, tmp_path, name):
    for table in ("documents", "pages", "labels"):
        os.symlink(f"{DATA}/{table}.parquet", f"{tmp_path}/{table}.parquet")
    df = queries.all_queries()[name](spark, str(tmp_path))
    assert df.columns[: len(CONTRACT[name])] == CONTRACT[name]
