"""Reports from stored sketches: error bounds on skewed lengths, exact sums, merging without a new read."""

import random

import pytest

from corpusloom.operators import reports, sketches


def skewed(n, seed=5):
    r = random.Random(seed)
    # half of all lengths are one value; the rest has a long tail
    return [(f"part{r.choice([0, 0, 0, 1, 2, 3])}", 7 if r.random() < 0.5 else int(r.lognormvariate(5, 1.5))) for _ in range(n)]


def off(values, value, p):
    """By how much a value misses being the p-quantile, as a share of all rows."""
    low = sum(v < value for v in values) / len(values)
    high = sum(v <= value for v in values) / len(values)
    return max(low - p, p - high, 0)


@pytest.mark.parametrize("k", [100, 400])
def test_rank_error_on_skewed_lengths(spark, tmp_path, k):
    rows = skewed(60_000)
    df = spark.createDataFrame(rows, "part string, n_tokens int").repartition(9)
    sketches.length_sketches(df, "part", k=k).write.parquet(f"{tmp_path}/s")
    stored = spark.read.parquet(f"{tmp_path}/s")
    got = sketches.sketched_stats(stored, k).first()
    want = reports.length_stats(df).first()
    for name in ("n", "min", "max", "mean", "std"):
        assert got[name] == pytest.approx(want[name], rel=1e-12)
    values = [v for _, v in rows]
    for p in reports.PERCENTILES:
        # one run in a hundred may exceed the error itself
        assert off(values, got["median" if p == 0.5 else f"p{round(p * 100)}"], p) <= 1.5 * got.rank_error
    exact = {r.max_seq: r.coverage for r in reports.truncation_coverage(df).collect()}
    for r in sketches.sketched_coverage(stored, k=k).collect():
        assert abs(r.coverage - exact[r.max_seq]) <= 150 * got.rank_error


def test_later_parts_are_merged_without_reading_earlier_ones(spark, tmp_path):
    corpus = tmp_path / "corpus"
    rows = skewed(300)
    spark.createDataFrame(rows, "part string, n_tokens int").write.parquet(str(corpus))
    sketches.length_sketches(spark.read.parquet(str(corpus)), "part").write.parquet(f"{tmp_path}/s")
    corpus.rename(tmp_path / "gone")
    later = spark.createDataFrame([("new", 99_999), ("new", None)], "part string, n_tokens int")
    sketches.length_sketches(later, "part").write.mode("append").parquet(f"{tmp_path}/s")
    got = sketches.sketched_stats(spark.read.parquet(f"{tmp_path}/s")).first()
    assert (got.n, got.max) == (301, 99_999)
    # fewer rows than a sketch holds: the quantiles are exact
    values = [v for _, v in rows] + [99_999]
    assert all(off(values, got["median" if p == 0.5 else f"p{round(p * 100)}"], p) == 0 for p in reports.PERCENTILES)


def test_nothing(spark):
    empty = spark.createDataFrame([], "part string, n_tokens int")
    assert tuple(sketches.sketched_stats(sketches.length_sketches(empty, "part")).first())[:6] == (0, None, None, None, None, None)
