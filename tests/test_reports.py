import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom.config import TokenizerSettings
from corpusloom.functions import scores as S
from corpusloom.operators import metrics as M
from corpusloom.operators import reports as R
from corpusloom.plans import generation, length_analysis
from corpusloom.tokenizer import Tokenizer


def test_length_stats_like_numpy(spark):
    rng = np.random.default_rng(1)
    # a third of all rows share one length
    values = np.concatenate([rng.integers(0, 3000, 2000), np.full(1000, 512)])
    df = spark.createDataFrame([(int(v),) for v in values], "n_tokens int")
    row = R.length_stats(df).first()
    assert (row.n, row.min, row.max) == (3000, values.min(), values.max())
    assert math.isclose(row["mean"], values.mean()) and math.isclose(row["std"], values.std())
    for name, p in (("p25", 25), ("median", 50), ("p75", 75), ("p90", 90), ("p95", 95), ("p99", 99)):
        assert math.isclose(row[name], np.percentile(values, p))
    for r in R.truncation_coverage(df).collect():
        assert math.isclose(r.coverage, (values <= r.max_seq).mean() * 100)


def test_lengths(spark):
    df = spark.createDataFrame([(1, "a b!"), (2, ""), (3, "  "), (4, None)], "doc_id long, text string")
    tok = Tokenizer(TokenizerSettings("word-level", "whitespace"), None)
    plain = length_analysis.corpus_lengths(df, tok).orderBy("doc_id").collect()
    assert [tuple(r) for r in plain] == [(1, 3), (3, 0)]
    framed = length_analysis.corpus_lengths(df, tok, framed=True).orderBy("doc_id").collect()
    assert [tuple(r) for r in framed] == [(1, 5), (3, 2)]
    records = spark.createDataFrame([("s", 0, "a", "b c", None, "d.")], "src string, rec_id long, features string, words string, summary string, story string")
    assert length_analysis.sft_lengths(records, tok).first().n_tokens == 15


def test_history_drops_the_short_window(spark):
    rows = [("a", i, float(i % 7)) for i in range(250)] + [("b", 1000 + i, 1.0) for i in range(99)]
    df = spark.createDataFrame(rows, "epoch string, step long, loss double")
    got = M.windowed_history(df, 100).orderBy("window").collect()
    want = [np.mean([r[2] for r in rows[w * 100 : w * 100 + 100]]) for w in (0, 1)]
    assert [(r.epoch, r.window) for r in got] == [("a", 0), ("a", 1)]
    assert np.allclose([r.mean_loss for r in got], want) and np.allclose([r.perplexity for r in got], np.exp(want))
    summary = {r.epoch: r.perplexity for r in M.epoch_summary(df).collect()}
    assert math.isclose(summary["b"], math.e)


@pytest.mark.parametrize("smoothing", [0.0, 0.05])
def test_cross_entropy_like_numpy(spark, smoothing):
    rng = np.random.default_rng(2)
    scores = rng.normal(0, 300, (40, 7))
    labels = [int(x) for x in rng.integers(0, 7, 40)]
    labels[3] = labels[8] = -100
    df = spark.createDataFrame([(s.tolist(), y) for s, y in zip(scores, labels)], "scores array<double>, label int")
    row = M.cross_entropy(df, smoothing=smoothing, aux=0.5).first()
    top = scores.max(1, keepdims=True)
    logp = scores - top - np.log(np.exp(scores - top).sum(1, keepdims=True))
    each = [(1 - smoothing) * -logp[i, y] + smoothing * -logp[i].mean() for i, y in enumerate(labels) if y != -100]
    assert row.n == 38 and math.isclose(row.loss, np.mean(each), rel_tol=1e-9)
    assert math.isclose(row.total_loss, row.loss + 0.5)


def kept(spark, scores, **filters):
    df = spark.createDataFrame([(1, scores)], "ctx long, scores array<double>")
    rows = generation.probabilities(generation.candidates(df, **filters).drop("scores")).collect()
    return {r.cand: r.prob for r in rows}


def test_filters(spark):
    scores = [1.0, 3.0, 3.0, -2.0]
    p = np.exp(scores) / np.exp(scores).sum()
    everything = kept(spark, scores)
    assert np.allclose([everything[i] for i in range(4)], p)
    assert list(kept(spark, scores, k=1)) == [1]
    assert set(kept(spark, scores, k=99)) == {0, 1, 2, 3}
    # the first probability alone exceeds p: exactly one stays; the crossing one is kept
    assert list(kept(spark, scores, p=0.1)) == [1]
    assert set(kept(spark, scores, p=0.5)) == {1, 2}
    assert set(kept(spark, scores, k=2, p=0.6)) == {1, 2}
    cold = kept(spark, scores, temperature=0.5)
    assert np.allclose(cold[0], (np.exp(np.array(scores) / 0.5) / np.exp(np.array(scores) / 0.5).sum())[0])


def test_draws_follow_the_probabilities(spark):
    df = spark.range(6000).select(F.col("id").alias("ctx"), F.array(F.lit(0.0), F.lit(1.0), F.lit(-9.0)).alias("scores"))
    drawn = generation.next_tokens(generation.candidates(df, k=2), "ctx")
    share = {r.token_id: r["count"] / 6000 for r in drawn.groupBy("token_id").count().collect()}
    assert set(share) == {0, 1} and abs(share[1] - math.e / (1 + math.e)) < 0.02
    assert drawn.collect() == generation.next_tokens(generation.candidates(df.repartition(3), k=2), "ctx").orderBy("ctx").collect()


def test_soft_max_of_large_scores(column):
    got = column([[1000.0, 1000.0], [-1e6, 0.0]], "array<double>", S.softmax)
    assert got == [[0.5, 0.5], [0.0, 1.0]]


def test_routing(spark):
    df = spark.createDataFrame([([5.0, 1.0, 4.0, 0.0],), ([5.0, 4.0, 1.0, 0.0],)], "scores array<double>")
    rows = {r.cand: r for r in M.route_load(df, 2, 4).collect()}
    assert [rows[i].share for i in range(4)] == [0.5, 0.25, 0.25, 0.0]
    assert rows[0].balance == 1.0 and rows[0].worst == 2.0
    first = M.route(df, 2).first().routed
    assert [r.cand for r in first] == [0, 2] and math.isclose(sum(r.weight for r in first), 1.0)


def test_null_epochs_are_epochs(spark):
    log = spark.createDataFrame([(None, i, 1.0) for i in range(6)] + [("e", 1, 2.0)], "epoch string, step int, loss double")
    got = M.windowed_history(log, 2).collect()
    assert sorted((r.epoch, r.window, r.mean_loss) for r in got) == [(None, i, 1.0) for i in range(3)]


@pytest.mark.parametrize("label", [7, -1, None])
def test_labels_that_are_no_class_are_refused(spark, label):
    df = spark.createDataFrame([([0.0, 1.0], 0), ([0.0, 1.0], label)], "scores array<double>, label int")
    with pytest.raises(PySparkException, match="no class"):
        M.cross_entropy(df).collect()


def test_reports_of_nothing(spark):
    none = spark.createDataFrame([], "scores array<double>, n_tokens int")
    rows = M.route_load(none, 2, 3).collect()
    assert [(r.cand, r.share, r.balance, r.worst) for r in sorted(rows)] == [(i, 0.0, 0.0, 0.0) for i in range(3)]
    stats = R.length_stats(none).first()
    assert stats.n == 0 and stats["mean"] is None and stats["p99"] is None


def test_prompts_and_answers(spark):
    train = spark.createDataFrame([("Dialogue BadEnding ride work upset a b , . Tom ran",)], "text string")
    tok = Tokenizer.train(train, TokenizerSettings("word-level", "whitespace", 40, 1))
    df = spark.createDataFrame(
        [(1, ["Dialogue", "BadEnding"], ["ride", "work"], "Tom ran."), (2, [], None, None)],
        "prompt_id long, features array<string>, words array<string>, summary string",
    )
    rows = generation.story_prompts(df, tok).orderBy("prompt_id").collect()
    assert (rows[0].features, rows[0].words) == ("Dialogue, BadEnding", "ride, work")
    assert rows[1].prompt == [2, 5, 6, 7, 8, 9, 10, 11]
    t = {w: tok.token_to_id(w) for w in ("Tom", "ran", ",", ".")}
    story = [t["Tom"], t[","], t["ran"], t["."]]
    answered = spark.createDataFrame([(1, rows[0].prompt + story + [12] + story, rows[0].prompt_len)], "i long, ids array<int>, prompt_len int")
    assert generation.story_texts(answered, tok).first().story == "Tom, ran."
    more = generation.continuation_prompts(spark.createDataFrame([(1, "Tom ran")], "prompt_id long, text string"), tok)
    assert more.first().prompt == [2, t["Tom"], t["ran"]]
    done = spark.createDataFrame([(1, [2, *story, 3, *story])], "i long, ids array<int>")
    assert generation.continuation_texts(done, tok).first().text == "Tom, ran."
