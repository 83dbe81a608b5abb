"""Every registered lattice query against its SQL on the smallest tables."""

import pytest

from honeyframe.plans.catalog import ORACLE_SQL, QUERIES
from tests.conftest import listed, rows_of

#: Queries whose order is part of the result; their SQL orders alike, or by what is added here.
ORDERED = {
    "query_lexical_top20": "", "query_lexical_folded": "", "query_sort_confidence": "", "query_sort_recency": "", "query_sort_coord": "", "query_sort_recency_radius": "", "query_combined": "",
    "distinct_tags": "strlen(tag), tag", "cells_by_source": "key", "cells_by_tag": "key", "list_cells": "", "walk_ring": "spiral", "spiral_range": None, "vector_topk_cosine": "", "vector_topk_dot": "", "vector_topk_l2": "", "vector_min_score": "",
    "scan_context": "", "load_context_ring": "", "load_context_asof": "", "load_context_multi_seed": "", "changefeed_since": "", "changefeed_filtered": "", "store_outbox": "", "tag_counts": "n DESC, tag", "tag_cooccurrence": "n DESC, tag_a, tag_b", "store_tags": "label",
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(x for x, by in ORDERED.items() if by is not None and x in ORACLE_SQL))
def test_order(spark, sf, duck, name):
    by, sql = ORDERED[name], ORACLE_SQL[name]
    want = duck.execute(f"SELECT * FROM ({sql}) ORDER BY {by}" if by else sql).df()
    assert listed(QUERIES[name](spark, sf).toPandas()) == listed(want)


def test_index_recall(spark, sf):
    from honeyframe.operators import vector
    from honeyframe.sources import fixtures

    vectors = fixtures.vectors(spark, sf)
    index = vector.build_index(vectors, 1)
    asked = vectors.filter("vec_id % 100 = 0").collect()
    hits = total = 0
    for row in asked:
        exact = {x.key for x in vector.search(vectors, row.embedding, 10).collect()}
        found = {x.key for x in vector.search_with_stats(vectors, row.embedding, 10, index=index)[0].collect()}
        hits, total = hits + len(exact & found), total + len(exact)
    assert hits / total >= 0.9


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_registered_index_recall(spark, sf, size):
    """The registered search, at its own effort, against exact search for every id divisible by 100."""
    d = sf.replace("sf0.001", size)
    exact = {(x.query_id, x.key) for x in QUERIES["vector_topk_many"](spark, d).collect()}
    found = [(x.query_id, x.key) for x in QUERIES["vector_index_topk"](spark, d).collect()]
    assert len(found) == len(exact) == len(set(found))
    assert len(exact & set(found)) / len(exact) >= 0.9
