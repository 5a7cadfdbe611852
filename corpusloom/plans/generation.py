"""The table steps on both sides of a language model: prompts in, next-token choice, texts out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import BOS
from corpusloom.functions import scores as sc
from corpusloom.functions import sequences as seq
from corpusloom.functions.text import clean_generated, join_fields
from corpusloom.tokenizer import Tokenizer


def story_prompts(df: DataFrame, tokenizer: Tokenizer, key: str = "prompt_id") -> DataFrame:
    """Prompts from ``features`` and ``words`` (string arrays) and ``summary`` (text)."""
    texts = df.select(
        key,
        join_fields(F.col("features")).alias("features"),
        join_fields(F.col("words")).alias("words"),
        F.coalesce("summary", F.lit("")).alias("summary"),
    )
    fields = ["features", "words", "summary"]
    encoded = tokenizer.encode(texts, [key], {f"{f}_ids": f for f in fields}, keep=fields)
    prompt = seq.build_prompt(*[F.col(f"{f}_ids") for f in fields])
    return encoded.select(key, *fields, prompt.alias("prompt"), F.size(prompt).alias("prompt_len"))


def continuation_prompts(df: DataFrame, tokenizer: Tokenizer, key: str = "prompt_id",
                         text: str = "text") -> DataFrame:
    encoded = tokenizer.encode(df, [key], {"ids": text})
    return encoded.select(key, F.concat(seq.ids(BOS), "ids").alias("prompt"))


def candidates(df: DataFrame, scores: str = "scores", temperature: float = 1.0, k: int = 0,
               p: float = 0.0) -> DataFrame:
    """Add ``candidates``: what temperature, top-k and nucleus filtering leave, best first."""
    return (
        df.withColumn("__scaled", sc.scale(F.col(scores), temperature))
        .withColumn("__ranked", sc.top_k(sc.ranked(F.col("__scaled")), k))
        .withColumn("candidates", sc.top_p(F.col("__ranked"), p))
        .drop("__scaled", "__ranked")
    )


def probabilities(df: DataFrame, out: str = "prob") -> DataFrame:
    """One row per remaining candidate with its renormalised probability."""
    zipped = F.arrays_zip(
        F.col("candidates.cand").alias("cand"), sc.softmax(F.col("candidates.score")).alias(out)
    )
    return df.withColumn("__rows", zipped).select(
        *[c for c in df.columns if c != "candidates"], F.inline("__rows")
    )


def next_tokens(df: DataFrame, context: str, seed: int = 42) -> DataFrame:
    """Add ``token_id``, one reproducible draw per context."""
    return df.withColumn("token_id", sc.draw(F.col("candidates"), F.col(context), seed))


def continuation_texts(df: DataFrame, tokenizer: Tokenizer, ids: str = "ids", out: str = "text") -> DataFrame:
    cut = df.withColumn("__cut", seq.cut_continuation(F.col(ids)))
    return tokenizer.decode(cut, "__cut", out).withColumn(out, clean_generated(F.col(out))).drop("__cut")


def story_texts(df: DataFrame, tokenizer: Tokenizer, ids: str = "ids", prompt_len: str = "prompt_len",
                out: str = "story") -> DataFrame:
    cut = df.withColumn("__cut", seq.cut_story(F.col(ids), F.col(prompt_len)))
    return tokenizer.decode(cut, "__cut", out).withColumn(out, clean_generated(F.col(out))).drop("__cut")
