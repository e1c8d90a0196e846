"""The registered corpus queries on the smallest tables: against SQL where there is some, else their shape."""

import os

import pytest

from loomgrid.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


COLUMNS = {
    "op1_hnsw_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op7_quality_scores": ["doc_id", "held_out", "score", "predicted"],
    "op8_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op9_url_verdicts": ["page_id", "host", "path", "rule", "verdict"],
    "op10_language_id": ["doc_id", "held_out", "lang_pred", "score"],
}


def test_token_counts_against_the_encoder(spark):
    from loomgrid.llm import token_files

    encode = token_files._encoding(token_files.VOCABULARY).encode_ordinary
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op2_token_counts(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, len(encode(r.text or ""))) for r in texts)


def test_decoding_gives_the_texts_back(spark):
    from pyspark.sql import functions as F

    got = queries.op5_sentencepiece_samples(spark, SF)
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.xxhash64("text").alias("want"))
    odd = got.join(texts, "doc_id").where("decoded_hash <> want").count()
    assert got.count() > texts.count() and odd == 0


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == COLUMNS[name]
    tables = {"op1_hnsw_neighbours": 0, "op9_url_verdicts": "pages"}
    rows = got.count()
    table = tables.get(name, "documents")
    assert rows == spark.read.parquet(f"{SF}/{table}.parquet").count() if table else rows > 0
