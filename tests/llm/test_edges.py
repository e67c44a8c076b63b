"""Every query and stage on nulls, blanks, repeats, clashing names and empty tables."""

import pytest

import corpus_pipeline
from loomspan.llm.queries import QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_edge_rows(spark, folders, name):
    edge, empty = folders
    found = QUERIES[name](spark, edge)
    none = QUERIES[name](spark, empty)
    assert found.columns == none.columns
    assert none.count() == 0
    n = found.count()
    if not name.startswith(("op8", "op9", "op12")):
        assert n == spark.read.parquet(f"{edge}/documents.parquet").count()
        assert len(set(found.columns)) == len(found.columns)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_edges(spark, folders, name, stage):
    for folder in folders:
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        out = stage(spark, docs, folder)
        kept = out.count()
        if name != "bpe":
            assert out.columns == docs.columns
        assert kept <= docs.count()
        if name in ("pii", "bpe"):
            assert kept == docs.count()


def test_pipeline(spark, folders):
    edge, empty = folders
    out = corpus_pipeline.run(spark, edge)
    assert "token_ids" in out.columns and out.count() > 0
    assert corpus_pipeline.run(spark, empty).count() == 0
