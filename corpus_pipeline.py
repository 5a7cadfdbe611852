"""Documents to training tokens in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, exact, near
from corpusloom.llm.queries import CUT, quality, table, tokens
from corpusloom.session import scratch_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    score = "score"
    while score in docs.columns:
        score = f"_{score}"
    return quality(docs, sf_dir, score).filter(F.col(score) >= CUT).select(*docs.columns)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents the one with the largest id."""
    kept = exact.exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi").select(*docs.columns)


def distinct_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates; rows without an id stay."""
    dropped = near.near_classes(docs).filter("NOT kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; rows without an id stay."""
    held = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(held.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes decoded from them."""
    return tokens(docs)


STAGES = [
    ("quality_classifier", good),
    ("exact_dedup", unique),
    ("near_dedup", distinct_enough),
    ("decontamination", clean),
    ("byte_bpe", encoded),
]

#: The classifier, the near-duplicates and the tokens are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
