"""The pipeline: its stages, one after another, against what each does by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import decontaminate, exact, near, queries

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    kept = {r.doc_id for r in queries.op6_quality_classifier(spark, SMALL).collect() if r.predicted == 1}
    for (_, stage), decide in zip(corpus_pipeline.STAGES[:4], (None, _unique, _near, _clean), strict=True):
        if decide:
            kept = decide(spark, docs)
        docs = stage(spark, docs, SMALL)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns
        rows = [r.doc_id for r in docs.collect()]
        assert set(rows) == kept and len(rows) == len(kept)
    final = {tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()}
    every = {r.doc_id: tuple(r) for r in queries.op8_byte_bpe(spark, SMALL).collect()}
    assert final == {every[k] for k in kept}


def _unique(spark, docs):
    return {r.doc_id for r in exact.exact_dedup(docs).collect() if r.kept}


def _near(spark, docs):
    return {r.doc_id for r in near.near_classes(docs).collect() if r.kept}


def _clean(spark, docs):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    return {r.doc_id for r in docs.collect()} - {r.doc_id for r in decontaminate.contaminated(docs, items).collect()}


def test_rows_without_an_id_or_text_stay(spark):
    rows = spark.createDataFrame([(None, "a b", "en", "s", 3), (1, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, rows, SMALL).count() == 2


def test_columns_named_like_those_of_the_stages(spark):
    """What the stages make on their way must not replace columns of the documents."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name in ("score", "kept", "keep_id", "class_id", "item_id"):
        docs = docs.withColumn(name, F.lit("mine"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        made = stage(spark, docs, SMALL)
        assert made.columns == docs.columns
        assert made.filter(" OR ".join(f"{c} <> 'mine'" for c in docs.columns[-5:])).count() == 0


def test_empty_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
