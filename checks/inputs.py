"""Inputs of the registered queries: the given tables, and streams Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import TokenizerSettings
from corpusloom.functions.text import normalize_whitespace, words_whitespace
from corpusloom.operators.order import sum_before
from corpusloom.operators.records import END_MARK
from corpusloom.session import scratch_path
from corpusloom.sources.corpus import read_corpus, widen
from corpusloom.tokenizer import Tokenizer, get_or_train

WORD_LEVEL = TokenizerSettings("word-level", "whitespace", vocab_size=512)
SUBWORD = TokenizerSettings(vocab_size=512)
# The default tokenizer's size in the queries whose SQL learns the merges anew: a second for ten or so.
CHECKED_VOCAB = 256
CHECKED_SUBWORD = TokenizerSettings(vocab_size=CHECKED_VOCAB)

# Room for 2^24 lines per document in the line number.
LINE_BITS = 24

_trained: dict[tuple, Tokenizer] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_corpus(spark, f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return widen(table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text"))))


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: source, features list, words list, summary and text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels")
    joined = widen(docs).join(labels, "doc_id", "left")
    first_line = F.get(F.split("text", "\n"), 0)
    flags = F.filter(
        F.array(
            F.when(F.col("quality") == 1, "quality"),
            F.when(F.col("toxic") == 1, "toxic"),
        ),
        lambda x: x.isNotNull(),
    )
    return joined.select(
        "doc_id",
        "source",
        F.concat(F.array("lang", "source"), flags).alias("features"),
        words_whitespace(normalize_whitespace(first_line)).alias("words"),
        first_line.alias("summary"),
        "text",
    )


def instruct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as one ordered line stream per source, each record closed by an end mark."""
    lines = F.concat(
        F.array(
            F.concat(F.lit("Features: "), F.array_join("features", ", ")),
            F.concat(F.lit("Words: "), F.array_join("words", ", ")),
            F.concat(F.lit("Summary: "), F.col("summary")),
            F.lit("Story:"),
        ),
        F.split("text", "\n"),
        F.array(F.lit(END_MARK)),
    )
    return described(spark, sf_dir).select(
        F.col("source").alias("src"), "doc_id", F.posexplode_outer(lines).alias("k", "text")
    ).select("src", (F.shiftleft("doc_id", LINE_BITS) + F.col("k")).alias("line_no"), "text")


def dense_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line streams with the lines of each source numbered 0, 1, 2, .."""
    lines = instruct_lines(spark, sf_dir).withColumn("one", F.lit(1))
    numbered = sum_before(lines, "line_no", "one", "place", part=["src"])
    return numbered.select("src", F.col("place").alias("line_no"), "text")


def _tokenizer(spark: SparkSession, sf_dir: str, settings: TokenizerSettings) -> Tokenizer:
    """Trained on the whole documents table, saved, and loaded by every query of the session."""
    at = (spark.sparkContext.applicationId, sf_dir, settings)
    if at not in _trained:
        _trained[at] = get_or_train(
            documents(spark, sf_dir), scratch_path(spark, "tokenizer"), settings
        )
    return _trained[at]


def word_tokenizer(spark: SparkSession, sf_dir: str) -> Tokenizer:
    return _tokenizer(spark, sf_dir, WORD_LEVEL)


def bpe_tokenizer(spark: SparkSession, sf_dir: str) -> Tokenizer:
    return _tokenizer(spark, sf_dir, SUBWORD)


def checked_bpe_tokenizer(spark: SparkSession, sf_dir: str) -> Tokenizer:
    return _tokenizer(spark, sf_dir, CHECKED_SUBWORD)
