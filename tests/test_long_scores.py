"""Long score tables against the array functions, hot contexts, ties and odd scores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scores as sc
from corpusloom.operators import long_scores as ls
from corpusloom.operators import metrics

LONG = "ctx string, cand long, score double"


def contexts(seed=3):
    r = random.Random(seed)
    made = {f"c{i}": [r.gauss(0, 3) for _ in range(r.choice([1, 2, 30]))] for i in range(20)}
    made["hot"] = [round(r.gauss(0, 2), 1) for _ in range(3000)]  # many ties
    made["far"] = [r.uniform(-2000, 2000) for _ in range(50)]  # exponentials beyond a double
    made["equal"] = [1.0] * 500
    return made


@pytest.fixture(scope="module")
def both(spark):
    made = contexts()
    rows = [(c, i, s) for c, x in made.items() for i, s in enumerate(x)]
    random.Random(4).shuffle(rows)
    long = spark.createDataFrame(rows, LONG).repartition(7)
    wide = spark.createDataFrame(list(made.items()), "ctx string, scores array<double>")
    return long, wide


def test_log_sum_exp_like_arrays(both):
    long, wide = both
    want = {r.ctx: r.v for r in wide.select("ctx", sc.log_sum_exp(F.col("scores")).alias("v")).collect()}
    got = {r.ctx: r.log_sum_exp for r in ls.context_sums(long).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_softmax_like_arrays(both):
    long, wide = both
    probs = wide.select("ctx", F.posexplode(sc.softmax(F.col("scores"))).alias("cand", "prob"))
    want = {(r.ctx, r.cand): r.prob for r in probs.collect()}
    got = {(r.ctx, r.cand): r.prob for r in ls.softmax(long).collect()}
    assert got == pytest.approx(want, rel=1e-9, abs=1e-300)


@pytest.mark.parametrize("k", [0, 1, 7, 600])
def test_top_k_like_arrays(both, k):
    long, wide = both
    best = wide.select("ctx", F.posexplode(sc.top_k(sc.ranked(F.col("scores")), k)["cand"]).alias("rank", "cand"))
    want = {(r.ctx, r.cand, r["rank"] + 1) for r in best.collect()}
    assert {(r.ctx, r.cand, r["rank"]) for r in ls.top_k(long, k).collect()} == want


@pytest.mark.parametrize("p", [0.3, 0.9, 0])
def test_nucleus_like_arrays(both, p):
    long, wide = both
    kept = wide.select("ctx", F.explode(sc.top_p(sc.ranked(F.col("scores")), p)["cand"]).alias("cand"))
    # a sum of equals meets p up to its rounding, so that context may end one earlier or later
    got = {(r.ctx, r.cand) for r in ls.top_p(long, p).collect()}
    want = {(r.ctx, r.cand) for r in kept.collect()}
    assert all(c == "equal" for c, _ in got ^ want) and len(got ^ want) <= 1


def test_running_sums(both):
    long, _ = both
    got = {}
    for r in ls.ranked(long).collect():
        got.setdefault(r.ctx, []).append((r["rank"], r.cand, r.before, r.prob))
    for ctx, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        total = 0.0
        for _, _, before, prob in rows:
            assert before == pytest.approx(total, abs=1e-9)
            total += prob
        assert total == pytest.approx(1.0, abs=1e-9)


def test_draw_like_arrays(both):
    long, wide = both
    drawn = wide.withColumn("all", sc.ranked(F.col("scores"))).select("ctx", sc.draw(F.col("all"), F.col("ctx"), 5).alias("cand"))
    want = {tuple(r) for r in drawn.collect()}
    assert {tuple(r) for r in ls.draw(long, 5).collect()} == want


def test_cross_entropy_like_arrays(spark, both):
    long, wide = both
    labels = [(c, 0 if c != "hot" else -100) for c in contexts()]
    short = spark.createDataFrame(labels, "ctx string, label int")
    want = metrics.cross_entropy(wide.join(short, "ctx"), smoothing=0.1, aux=0.5).first()
    got = ls.cross_entropy(long, short, smoothing=0.1, aux=0.5).first()
    assert got.n == want.n
    assert (got.loss, got.total_loss) == pytest.approx((want.loss, want.total_loss), rel=1e-9)
    with pytest.raises(Exception, match="a label is no candidate"):
        ls.cross_entropy(long, spark.createDataFrame([("c1", 77)], "ctx string, label int")).collect()


def test_null_contexts_and_scores(spark):
    rows = [(None, 1, 0.0), (None, 2, None), ("a", 1, None), ("a", 2, float("-inf")), ("b", 5, 2.0), ("b", -5, 2.0)]
    raw = spark.createDataFrame(rows, LONG)
    long = ls.long_scores(raw, "ctx", "cand", F.col("score"))
    got = {(r.ctx, r.cand): r.prob for r in ls.softmax(long).collect()}
    want = {(None, 1): 1.0, (None, 2): 0.0, ("a", 1): 0.0, ("a", 2): 0.0, ("b", 5): 0.5, ("b", -5): 0.5}
    assert got == pytest.approx(want)
    places = {(r.ctx, r.cand): r["rank"] for r in ls.ranked(long).collect()}
    assert places == {(None, 1): 1, (None, 2): 2, ("a", 1): 1, ("a", 2): 2, ("b", -5): 1, ("b", 5): 2}
    assert {r.ctx: r.log_sum_exp for r in ls.context_sums(long).collect()} == {
        None: 0.0, "a": -math.inf, "b": pytest.approx(2 + math.log(2))
    }


def test_empty(spark):
    empty = spark.createDataFrame([], LONG)
    assert ls.ranked(empty).count() == ls.softmax(empty).count() == ls.top_k(empty, 3).count() == ls.draw(empty).count() == 0


def test_one_row_per_context_and_scale_is_shuffled(both):
    plan = ls.context_sums(both[0])._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Window" not in plan and "Join" not in plan
