"""Registered queries against their SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from atalaia.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(SF)


@pytest.mark.parametrize(
    "name",
    ["chunk_identity", "document_totals", "bm25_topk", "semantic_topk_filtered", "semantic_many", "hybrid_rrf_topk", "criterion_classification", "org_indicators", "keyword_counts_page", "snippets", "snippets_near_dedup", "segment_scores", "imga_document", "link_dedup", "bfs_hubs", "title_dates", "rolling_avg_last10", "bm25_phrases", "cited_answer", "negative_labels", "document_links_pdf", "indicator_means", "index_build", "anchors_paragraphs", "search_hits", "portal_links", "collection_flow", "matrix_selected", "words_shown", "keywords_ranked", "keyword_counts_phrases", "control_states", "csv_typed", "new_keys_written"],
)
def test_query_equals_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    rows = sorted(map(str, ([r[c] for c in sorted(got.columns)] for r in got.collect())))
    out = db.execute(registry.ORACLES[name])
    columns = [c[0] for c in out.description]
    want = sorted(str([r[columns.index(c)] for c in sorted(columns)]) for r in out.fetchall())
    assert sorted(columns) == sorted(got.columns) and rows == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
