"""Queries that ask for every row a search is meant for, and texts as a whole."""

import base64
import hashlib

import pytest
from tessera.plans import catalog

EVERY50 = ["dense_topk_every50", "dense_filter_eq_every50", "dense_filter_in_every50", "dense_filter_and_every50", "dense_filter_missing_key_every50", "cosine_scalar_every50", "rerank_reverse_every50"]


def asked(spark, data, name):
    return {r.query_id for r in catalog.queries()[name](spark, data).select("query_id").distinct().collect()}


@pytest.mark.parametrize("name", EVERY50)
def test_every_fiftieth_vector_is_asked(spark, data, name):
    want = {r.vec_id for r in spark.read.parquet(f"{data}/embeddings.parquet").where("vec_id % 50 = 0").collect()}
    assert len(want) > 5 and asked(spark, data, name) == want


def test_every_benchmark_text_is_asked(spark, data):
    items = {r.item_id for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    with_vector = items & {r.vec_id for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    assert len(with_vector) > 8 and asked(spark, data, "hybrid_topk_all") == with_vector
    assert asked(spark, data, "bm25_filter_after_score_all") == items


def test_data_urls_hold_whole_texts(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: r for r in catalog.queries()["data_urls_whole"](spark, data).collect()}
    assert max(map(len, texts.values())) > 10_000 and got.keys() == texts.keys()
    for i, t in texts.items():
        url = "data:image/png;base64," + base64.b64encode(t.encode()).decode()
        assert got[i].url_sha256 == hashlib.sha256(url.encode()).hexdigest() and got[i].back_sha256 == hashlib.sha256(t.encode()).hexdigest()
