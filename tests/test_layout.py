"""Batches of like length, and a corpus layout that readers skip parts of."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import batching, selection
from corpusloom.sources import corpus as S


def lengths(spark, rows):
    return spark.createDataFrame(rows, "k long, n_tokens int")


def test_length_batches(spark):
    rows = [(i, (i * 7919) % 1000) for i in range(1003)]
    df = lengths(spark, rows)
    plan = batching.length_plan(df, "k", size=8)
    batches = {}
    for r in plan.collect():
        batches.setdefault(r.batch_id, []).append(r)
    assert sorted(batches) == list(range(126))
    assert sorted(map(len, batches.values())) == [3] + [8] * 125
    n = dict(rows)
    for inside in batches.values():
        assert sorted(r.row_in_batch for r in inside) == list(range(len(inside)))
        sizes = [n[r.k] for r in inside]
        assert {r.longest for r in inside} == {max(sizes)} and max(sizes) - min(sizes) < 2 * batching.CLASS_WIDTH
    # batches are in no order of length
    order = [batches[b][0].longest for b in sorted(batches)]
    assert sum(a <= b for a, b in zip(order, order[1:])) < 90


def test_less_padding_than_random_batches(spark):
    df = lengths(spark, [(i, (i * i) % 511 + 1) for i in range(2000)])
    made = batching.padding_waste(batching.length_plan(df, "k"), df, "k").first()
    random_ = batching.batch_train(df, "k").groupBy("batch_id").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("m"), F.count("*").alias("c"))
    total = random_.agg(F.sum("n").alias("n"), F.sum(F.col("m") * F.col("c")).alias("cells")).first()
    assert made.n_tokens == total.n
    assert made.waste < 0.15 < 0.3 < 1 - total.n / total.cells


def test_padding_by_plan_moves_arrays_once(spark):
    rows = [(i, list(range(i % 50))) for i in range(200)]
    seqs = spark.createDataFrame(rows, "k long, input_ids array<int>")
    plan = batching.length_plan(seqs.select("k", F.size("input_ids").alias("n_tokens")), "k")
    padded = batching.pad_by_plan(seqs, plan, "k", {"input_ids": 1})
    for r in padded.collect():
        want = dict(rows)[r.k]
        assert r.input_ids == want + [1] * (r.longest - len(want))
    tree = padded._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("Join Inner") >= 1 and "Window" not in tree.split("Join Inner")[0]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, 0), (2, None), (3, 5)]])
def test_few_and_null_lengths(spark, rows):
    df = lengths(spark, rows)
    plan = batching.length_plan(df, "k", size=2)
    assert sorted(r.k for r in plan.collect()) == [k for k, _ in rows]
    assert batching.padding_waste(plan, df, "k").count() == 1


def files_read(df):
    """How many files the scan of an executed plan has opened."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.head().metrics().get("numFiles").get().value()


def test_splits_and_ranges_read_few_files(spark, small, tmp_path):
    docs = selection.split(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"), "doc_id")
    path = f"{tmp_path}/corpus"
    S.write_corpus(docs, path, "doc_id", files=12)
    total = len(list((tmp_path / "corpus").rglob("*.parquet")))
    train = len(list((tmp_path / "corpus" / "split=train").glob("*.parquet")))
    val = len(list((tmp_path / "corpus" / "split=validation").glob("*.parquet")))
    assert train > 1 and train + val < total + 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert files_read(S.read_corpus(spark, path, "validation")) == val
        assert files_read(S.read_corpus(spark, path, "train")) == train
        assert files_read(S.read_corpus(spark, path)) == total
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = sorted(r.doc_id for r in docs.filter("split = 'train'").collect())
    assert sorted(r.doc_id for r in S.read_corpus(spark, path, "train").collect()) == want
    # ids of a file are a range of their own
    ranges = S.read_corpus(spark, path, "train").groupBy(F.input_file_name().alias("f")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    ends = sorted((r.a, r.b) for r in ranges.collect())
    assert all(b < a for (_, b), (a, _) in zip(ends, ends[1:]))
