"""The pipeline over the awkward table: nulls, empty and very long texts, repeated rows, clashing columns, and no rows at all."""

from collections import Counter

import corpus_pipeline
from tests.llm import edge


def test_stages_over_the_edge_table(spark):
    docs = edge.table(spark)
    columns, before = docs.columns, Counter(r.doc_id for r in docs.collect())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, None)
        assert docs.columns == columns
        assert set(r.doc_id for r in docs.collect()) <= set(before)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, None)
    kept = Counter(r.doc_id for r in docs.collect())
    assert set(r.doc_id for r in pieces.collect()) == set(kept)


def test_later_stages_over_everything(spark):
    """Rows that the quality rules would have taken out reach the other stages too."""
    docs = edge.table(spark)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, None)
    ids = {r.doc_id for r in docs.collect()}
    assert {5, 6, 7, 11, 12, 13, 15, 18} <= ids and docs.count() >= 15
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, None).collect()} == ids


def test_no_rows(spark):
    docs = edge.table(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, None).count() == 0
