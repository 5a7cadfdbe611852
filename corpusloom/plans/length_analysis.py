"""Length reports over a corpus and over instruction records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import default_text
from corpusloom.operators.records import FIELDS
from corpusloom.operators.reports import length_stats, sft_length, truncation_coverage
from corpusloom.operators.selection import drop_empty
from corpusloom.tokenizer import Tokenizer


def corpus_lengths(df: DataFrame, tokenizer: Tokenizer, key: str = "doc_id", text: str = "text",
                   framed: bool = False) -> DataFrame:
    """``key, n_tokens`` without begin and end marks (with them, if ``framed``); empties skipped."""
    counted = tokenizer.lengths(drop_empty(df, text).select(key, text), text)
    extra = 2 if framed else 0
    return counted.select(key, (F.col("n_tokens") + extra).alias("n_tokens"))


def sft_lengths(records: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``src, rec_id, n_tokens`` of the whole untruncated sequence."""
    for f in FIELDS:
        records = tokenizer.lengths(
            records.withColumn(f, default_text(F.col(f))), f, f"__{f}"
        )
    return records.select(
        "src", "rec_id", sft_length(*[f"__{f}" for f in FIELDS]).alias("n_tokens")
    )


def analyze(lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    return length_stats(lengths), truncation_coverage(lengths)
