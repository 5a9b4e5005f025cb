"""Tables whose columns have the operators' own names."""

import pytest

import corpus_pipeline
from tapewire.llm import decontaminate, passages
from tests.llm.frames import odd_docs

OWN = {"key": "__found", "digest": "__cut", "n": "__units", "words": "__row_hash", "block": "__kept", "task": "__FOUND_"}


def own_names(spark):
    return odd_docs(spark).withColumnsRenamed(OWN)


def test_stages_keep_all_columns(spark):
    docs = own_names(spark)
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    cut = corpus_pipeline.substring_dedup(spark, docs, "")
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert {r["__cut"] for r in cut.collect()} == {"d"}


def test_a_name_that_is_taken_is_an_error(spark):
    docs = own_names(spark)
    with pytest.raises(ValueError):
        passages.dedupe(docs)
    with pytest.raises(ValueError):
        decontaminate.scan(docs, docs.selectExpr("doc_id AS item_id", "text"))
