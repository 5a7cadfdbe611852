"""Word counts and the word-level vocabulary (id, token, kind)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.config import SPECIAL_TOKENS, TokenizerSettings
from corpusloom.functions.text import pre_tokenize, show_bytes

VOCAB_SCHEMA = "id int, token string, kind string"


def word_counts(
    df: DataFrame, text: str = "text", how: str = "whitespace", normalize: bool = True
) -> DataFrame:
    """``word, n`` over all texts; counts are combined before the shuffle, so hot words are cheap."""
    words = pre_tokenize(F.col(text), how, normalize, spelled=False)
    # the outer form keeps Catalyst from adding a filter that would tokenize every text again
    exploded = df.select(F.explode_outer(words).alias("word")).filter(F.col("word").isNotNull())
    counts = exploded.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # spelling bytes keeps words apart, so it can wait for the distinct words
    return counts.withColumn("word", show_bytes(F.col("word"))) if how == "byte-level" else counts


def special_vocab(spark: SparkSession, specials=SPECIAL_TOKENS) -> DataFrame:
    rows = [(i, token, "special") for i, token in enumerate(specials)]
    return spark.createDataFrame(rows, VOCAB_SCHEMA)


def train_word_level(df: DataFrame, settings: TokenizerSettings, text: str = "text") -> DataFrame:
    """Specials, then the most frequent words (ties by byte order) up to the vocabulary size."""
    if settings.strategy != "word-level":
        raise ValueError(f"not a word-level strategy: {settings.strategy}")
    return word_level_of(word_counts(df, text, settings.pre_tokenizer, settings.normalize_whitespace), settings)


def word_level_of(counts: DataFrame, settings: TokenizerSettings) -> DataFrame:
    """The same from ``word, n``."""
    specials = special_vocab(counts.sparkSession)
    room = max(settings.vocab_size - len(SPECIAL_TOKENS), 0)
    frequent = (
        counts.filter((F.col("n") >= settings.min_frequency) & ~F.col("word").isin(*SPECIAL_TOKENS))
        .orderBy(F.desc("n"), F.asc("word"))
        .limit(room)
    )
    # the limit above bounds this one partition by the vocabulary size
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("n"), F.asc("word")))
    words = frequent.select(
        (place + len(SPECIAL_TOKENS) - 1).cast("int").alias("id"),
        F.col("word").alias("token"),
        F.lit("word").alias("kind"),
    )
    return specials.unionByName(words)


def token_to_id(tokens: DataFrame, vocab: DataFrame, token: str = "token") -> DataFrame:
    """Exact lookup of ``token``; ``id`` is null where the vocabulary lacks it.

    No side is forced: Spark broadcasts the vocabulary if its measured bytes allow it, and splits
    the rows of a hot token otherwise.
    """
    return tokens.join(vocab.select(F.col("token").alias(token), "id"), token, "left")
