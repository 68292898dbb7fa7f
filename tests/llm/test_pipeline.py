"""The pipeline's stages, and the queries with SQL on the smallest tables."""

import corpus_pipeline
import pytest

import oracle
from casegrid.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    assert oracle.difference(queries.queries()[name](spark, SF), oracle.connect(SF), queries.oracle_sql()[name]) == ""


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] <= counts[1] and counts[3] == counts[2] and counts[4] >= counts[3]


def test_clean_labelled_documents_stay(spark):
    kept = {r[0] for r in corpus_pipeline.quality_rules(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "").select("doc_id").collect()}
    long_enough = spark.sql("select d.doc_id, l.quality from parquet.`/root/testdata/sf0.01/documents.parquet` d join parquet.`/root/testdata/sf0.01/labels.parquet` l using (doc_id) where size(split(trim(d.text), '[ \\n]+')) >= 50").collect()
    good, bad = [r[0] for r in long_enough if r[1] == 1], [r[0] for r in long_enough if r[1] == 0]
    assert sum(i in kept for i in good) >= 0.99 * len(good)
    assert sum(i in kept for i in bad) <= 0.1 * len(bad)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "ids", "begins", "ends"} <= set(out.columns) and out.count() > 100


def test_stages_take_odd_rows_and_empty_tables(spark, docs, no_docs):
    for table in (docs, no_docs):
        rows = table
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
            assert name == "encode" or rows.columns == table.columns, name
            rows = rows.cache()
            assert rows.count() >= 0
    first = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert first.count() < docs.count()
