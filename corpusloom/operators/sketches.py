"""Length reports from stored sketches, which merge over corpora without reading these again.

One row per part of a corpus (a file, a source, a day) holds a quantile sketch of its lengths and the exact sums.
Sketches of a few kilobytes stand for any number of rows and merge in any order, so a report over many corpora, or
over one that has grown, reads only their sketches. Count, extremes, mean and deviation are exact; a quantile's
rank is off by at most :func:`rank_error` with a probability of 99 %. Parts of fewer than ``k`` rows are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import COVERAGE_CUTOFFS
from corpusloom.operators.reports import PERCENTILES

#: Size of a sketch.
K = 2048


def rank_error(k: int = K) -> float:
    """The error of a rank, as a share of all rows, that 99 of 100 sketches of this size keep to."""
    return 2.296 / k**0.9723


def length_sketches(lengths: DataFrame, part: str, length: str = "n_tokens", k: int = K) -> DataFrame:
    """``part, sketch, n, min, max, s1, s2``: one row per part, combined in each task before the shuffle."""
    exact = F.col(length).cast("decimal(38,0)")
    return lengths.groupBy(F.col(part).alias("part")).agg(
        F.kll_sketch_agg_bigint(F.col(length).cast("long"), F.lit(k)).alias("sketch"),
        F.count(length).alias("n"),
        F.min(length).alias("min"),
        F.max(length).alias("max"),
        F.sum(exact).alias("s1"),
        F.sum((exact * exact).cast("decimal(38,0)")).alias("s2"),
    )


def _merged(sketches: DataFrame, k: int) -> DataFrame:
    filled = sketches.filter(F.col("n") > 0)
    return filled.agg(
        F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.sum("s1").cast("decimal(38,0)").alias("s1"), F.sum("s2").cast("decimal(38,0)").alias("s2"),
    )


def sketched_stats(sketches: DataFrame, k: int = K) -> DataFrame:
    """One row like that of ``length_stats`` over all parts, and ``rank_error``; quantiles are lengths that occur."""
    n, s1, s2 = F.col("n"), F.col("s1"), F.col("s2")
    spread = (s2 * n - s1 * s1).cast("double")

    def quantile(p: float, name: str):
        return F.when(n > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(p))).alias(name)

    return _merged(sketches, k).select(
        "n", "min", "max",
        F.try_divide(s1.cast("double"), n).alias("mean"),
        F.try_divide(F.sqrt(spread), n).alias("std"),
        quantile(0.5, "median"),
        *[quantile(p, f"p{round(p * 100)}") for p in PERCENTILES if p != 0.5],
        F.lit(rank_error(k)).alias("rank_error"),
    )


def sketched_coverage(
    sketches: DataFrame, cutoffs: Sequence[int] = COVERAGE_CUTOFFS, k: int = K
) -> DataFrame:
    """Per cut-off the percentage of sequences it does not shorten, to within the rank error."""
    rows = [
        F.struct(
            F.lit(c).alias("max_seq"),
            F.when(F.col("n") > 0, 100.0 * F.kll_sketch_get_rank_bigint("sketch", F.lit(c).cast("long"))).alias("coverage"),
        )
        for c in cutoffs
    ]
    return _merged(sketches, k).select(F.inline(F.array(*rows)))
