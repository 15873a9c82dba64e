"""Every registered query bears nulls, empty texts, ties, repeated rows, clashing columns and empty tables."""

import pytest

from barloom.llm import registry

ROWS = {"op1": 13, "op2": 13, "op3": 13, "op4": 13, "op5": 13, "op6": 13, "op7": 13, "op8": 10, "op9": 6, "op10": 6, "op11": 13, "op12": 0, "op13": 20}


@pytest.mark.parametrize("name", list(registry.queries()))
def test_one_row_for_each_row(spark, tables, name):
    rows = registry.queries()[name](spark, tables[0]).collect()
    assert len(rows) == ROWS[name.split("_")[0]]


@pytest.mark.parametrize("name", list(registry.queries()))
def test_empty_tables(spark, tables, name):
    assert registry.queries()[name](spark, tables[1]).collect() == []


def test_pipeline_stages(spark, docs, no_docs, tables):
    import corpus_pipeline

    for start, folder in ((docs, tables[0]), (no_docs, tables[1])):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, folder)
            if name != "packing":
                assert out.columns == start.columns
            now = out
        assert (now.count() > 0) == (start is docs)


def test_near_duplicate_stage_keeps_one_of_each_class(spark, docs):
    from barloom.llm import ngram_join

    kept = sorted((r["doc_id"] or -1) for r in ngram_join.ngram_join_stage(spark, docs, "").collect())
    assert kept == [-1, 1, 5, 6, 7, 8, 10, 11]
