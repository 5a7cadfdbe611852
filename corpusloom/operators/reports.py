"""Length statistics and truncation coverage, from a histogram of lengths.

Lengths are counted first (partial counts before the shuffle), so what reaches the final aggregate
is one row per distinct length, not one per document, and the percentiles stay exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import COVERAGE_CUTOFFS

# The reported percentiles.
PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    return lengths.groupBy(F.col(length).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def length_stats(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """n, min, max, mean, population std, median and percentiles by linear interpolation."""
    exact = F.col("length").cast("decimal(38,0)")
    one = length_histogram(lengths, length).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.min("length").alias("min"),
        F.max("length").alias("max"),
        F.sum(exact * F.col("n")).alias("__s1"),
        F.sum((exact * exact).cast("decimal(38,0)") * F.col("n")).alias("__s2"),
        F.percentile("length", list(PERCENTILES), F.col("n")).alias("__p"),
    )
    n, s1, s2 = F.col("n"), F.col("__s1"), F.col("__s2")
    # n * s2 - s1^2 is exact before the one division
    spread = (s2.cast("decimal(38,0)") * n - s1.cast("decimal(38,0)") * s1).cast("double")
    return one.select(
        "n", "min", "max",
        F.try_divide(s1.cast("double"), n).alias("mean"),
        F.try_divide(F.sqrt(spread), n).alias("std"),
        F.get("__p", 1).alias("median"),
        *[
            F.get("__p", i).alias(f"p{round(p * 100)}")
            for i, p in enumerate(PERCENTILES)
            if p != 0.5
        ],
    )


def truncation_coverage(
    lengths: DataFrame, length: str = "n_tokens", cutoffs: Sequence[int] = COVERAGE_CUTOFFS
) -> DataFrame:
    """Per cut-off the percentage of sequences it does not shorten, from one pass."""
    within = [
        F.struct(
            F.lit(c).alias("max_seq"),
            (100.0 * F.sum(F.when(F.col("length") <= c, F.col("n")).otherwise(0)) / F.sum("n")).alias(
                "coverage"
            ),
        )
        for c in cutoffs
    ]
    return length_histogram(lengths, length).agg(F.array(*within).alias("r")).select(F.inline("r"))


def sft_length(features: str, words: str, summary: str, story: str):
    """Whole sequence length from the four encoded lengths: ten special tokens are added."""
    return 10 + F.col(features) + F.col(words) + F.col(summary) + F.col(story)


def sample_counts(lines: DataFrame, records: DataFrame) -> DataFrame:
    """Raw rows against assembled records."""
    raw = lines.agg(F.count(F.lit(1)).alias("n")).select(F.lit("raw").alias("kind"), "n")
    made = records.agg(F.count(F.lit(1)).alias("n")).select(F.lit("structured").alias("kind"), "n")
    return raw.unionByName(made)
