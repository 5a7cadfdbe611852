"""Samples by a found cut-off, orders by a keyed permutation, loss windows of a running log."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions.permutation import permuted
from corpusloom.operators import batching, metrics, selection
from corpusloom.operators.order import shuffle_key
from corpusloom.streaming import metrics as SM


@pytest.mark.parametrize("n", [0, 1, 7, 100, 499, 500, 501, 9999])
def test_sample_is_the_first_of_the_shuffled_order(spark, monkeypatch, n):
    """Small cells and few keys at the end: the cut-off is found over several divisions."""
    monkeypatch.setattr(selection, "CELL_BITS", 3)
    monkeypatch.setattr(selection, "FEW", 4)
    df = spark.range(0, 500, 1, 5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    whole = [r.k for r in df.orderBy(shuffle_key(F.col("k"), 42), "k").collect()]
    got = selection.sample(df, "k", n).collect()
    assert [r.k for r in got] == whole[:n]
    assert all(r.v == 2 * r.k for r in got)


def test_sample_leaves_out_null_keys_and_takes_texts_as_keys(spark):
    df = spark.createDataFrame([(f"key {i}",) for i in range(50)] + [(None,)], "k string")
    assert selection.sample(df, "k", 100).count() == 50
    assert selection.sample(df, "k", 20).count() == 20
    assert selection.sample(df.limit(0), "k", 20).count() == 0


def test_sample_needs_no_window(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    plan = selection.sample(docs, "doc_id", 20)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


@settings(max_examples=25, deadline=None)
@given(n=st.integers(1, 400), seed=st.integers(0, 9), epoch=st.integers(0, 3))
def test_permutation_is_one(spark, n, seed, epoch):
    rows = spark.range(0, n, 1, 1).select(permuted(F.col("id"), n, seed, epoch).alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(n))


def test_orders_of_epochs_differ_and_mix(spark):
    n = 2000
    df = spark.range(0, n, 1, 3)
    orders = [[r.p for r in df.orderBy("id").select(permuted(F.col("id"), n, 42, e).alias("p")).collect()] for e in (0, 1)]
    assert sum(a == b for a, b in zip(*orders)) < 10
    for order in orders:
        # neighbours are far apart: their mean distance is a third of all in a random order
        assert sum(abs(a - b) for a, b in zip(order, order[1:])) / n == pytest.approx(n / 3, rel=0.1)


def test_an_epoch_neither_sorts_nor_joins(spark):
    df = spark.range(100).withColumnRenamed("id", "row_index")
    made = batching.batch_epoch(df, "row_index", 100, size=8)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Sort", "Join"))
    assert sorted(r["count"] for r in made.groupBy("batch_id").count().collect()) == [4] + [8] * 12


def log_of(seed, epochs=("a", "b", None)):
    rng = random.Random(seed)
    return [(rng.choice(epochs), step, rng.random() * 5) for step in range(400)]


@pytest.mark.parametrize("cuts", [(), (130,), (7, 200, 201, 390)])
def test_windows_of_a_running_log(spark, tmp_path, cuts):
    """Any cut into micro-batches gives the batch query's windows."""
    schema, rows = "epoch string, step long, loss double", log_of(len(cuts))
    for low, high in zip((0, *cuts), (*cuts, 400)):
        part = rows[low:high]
        random.Random(low).shuffle(part)
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        SM.write_history(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 9,
                         f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = {(r.epoch, r.window): r.mean_loss for r in spark.read.schema(SM.WINDOWS).parquet(f"{tmp_path}/out").collect()}
    want = metrics.windowed_history(spark.createDataFrame(rows, schema), 9).collect()
    assert got == pytest.approx({(r.epoch, r.window): r.mean_loss for r in want})
    assert len(got) > 30


def test_a_step_from_before_is_an_error(spark, tmp_path):
    schema = "epoch string, step long, loss double"
    for step in (5, 3):
        spark.createDataFrame([("a", step, 1.0)], schema).write.mode("append").parquet(f"{tmp_path}/in")
        query = SM.write_history(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 9,
                                 f"{tmp_path}/out", f"{tmp_path}/check")
        if step == 5:
            query.awaitTermination()
    with pytest.raises(Exception, match="step 3 comes after step 5"):
        query.awaitTermination()
