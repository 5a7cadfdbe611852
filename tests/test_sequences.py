import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom.config import FINETUNING, PRETRAINING, StageSettings, TokenizerSettings
from corpusloom.functions import sequences as Q
from corpusloom.operators import batching as B
from corpusloom.operators.order import shuffled_index, stored_index, sum_before
from corpusloom.operators.selection import head, sample, split
from corpusloom.plans import finetuning, pretraining
from corpusloom.streaming.sequences import write_sequences
from corpusloom.tokenizer import Tokenizer


def test_frame_and_truncate(column):
    sizes = [0, 509, 510, 511, 600]
    got = column([[20] * n for n in sizes], "array<int>", lambda c: Q.truncate(Q.frame_corpus(c)))
    assert [len(g) for g in got] == [2, 511, 512, 512, 512]
    for g, n in zip(got, sizes):
        whole = [2] + [20] * n + [3]
        assert g == (whole[:511] + [3] if len(whole) > 512 else whole)


def sft(spark, rows, length):
    df = spark.createDataFrame(
        rows, "src string, rec_id long, features_ids array<int>, words_ids array<int>, summary_ids array<int>, story_ids array<int>"
    )
    made = finetuning.truncate_sft(finetuning.sft_sequences(df), length)
    return finetuning.require_equal_lengths(made).orderBy("rec_id").collect()


def test_sft_dataset_encodes_each_field_once_and_outside_python(spark):
    """The filter on lengths doesn't look the words up again."""
    records = spark.createDataFrame(
        [("s", 0, "a, b", "a", "a b", "b a c")], "src string, rec_id long, features string, words string, summary string, story string"
    )
    tok = Tokenizer.train(records.withColumnRenamed("story", "text"), TokenizerSettings("word-level", "whitespace", 100, 1))
    made = finetuning.sft_dataset(records, tok)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "AS __table" not in plan and plan.count("element_at(") == 4
    a, b, c = (tok.token_to_id(w) for w in "abc")
    assert made.first().input_ids == [2, 5, a, 0, b, 6, 7, a, 8, 9, a, b, 10, 11, b, a, c, 12, 3]


def test_sft_sequences(spark):
    rows = [("s", 0, [20], [21, 22], [], [30, 31]), ("s", 1, [20] * 30, [], [], [30]), ("s", 2, [], [], [], [])]
    a, b, e = sft(spark, rows, 16)
    assert a.input_ids == [2, 5, 20, 6, 7, 21, 22, 8, 9, 10, 11, 30, 31, 12, 3]
    assert a.labels == [-100] * 11 + [30, 31, 12, 3]
    # the prompt alone is too long: all labels ignored, but the cut ones still end in EOS
    assert b.input_ids == [2, 5] + [20] * 13 + [3] and b.labels == [-100] * 15 + [3]
    assert e.input_ids == [2, 5, 6, 7, 8, 9, 10, 11, 12, 3] and e.labels == [-100] * 8 + [12, 3]


def test_unequal_lengths_fail(spark):
    df = spark.createDataFrame([([1, 2], [1])], "input_ids array<int>, labels array<int>")
    assert finetuning.unequal_lengths(df).count() == 1
    with pytest.raises(PySparkException, match="differ in length"):
        finetuning.require_equal_lengths(df).collect()


def test_shifts_and_masks(column):
    rows = [[2, 20, 1, 3, 1, 1], [2], []]
    assert column(rows, "array<int>", Q.shift_labels_pretrain) == [[20, -100, 3, -100, -100], [], []]
    assert column(rows, "array<int>", Q.shift_labels_sft) == [[20, 1, 3, 1, 1], [], []]
    assert column(rows, "array<int>", Q.drop_last) == [[2, 20, 1, 3, 1], [], []]
    assert column(rows, "array<int>", Q.padding_mask) == [
        [True, True, False, True, False, False], [True], []
    ]


def test_cuts(column):
    rows = [[2, 20, 1, 21, 3, 22, 3], [2, 20], [3, 20], []]
    assert column(rows, "array<int>", Q.cut_continuation) == [[20, 21], [20], [], []]
    rows = [[2, 5, 11, 30, 1, 9, 31, 12, 32, 3], [2, 5, 11, 30, 3, 12], [2, 5, 11, 30], [2, 5, 11], [2]]
    assert column(rows, "array<int>", lambda c: Q.cut_story(c, F.lit(3))) == [[30, 31], [30], [30], [], []]


def test_sum_before_over_hot_and_sparse_parts(spark):
    rows = [("hot", i * 3, i % 5) for i in range(500)] + [("far", (1 << 45) * i + 5, 1) for i in range(-6, 6)]
    df = spark.createDataFrame(rows, "p string, at long, v long")
    got = sum_before(df, "at", "v", "b", part=["p"], total="t", shifts=(4, 6)).collect()
    for r in got:
        mine = [x for x in rows if x[0] == r.p]
        assert r.b == sum(x[2] for x in mine if x[1] < r.at) and r.t == sum(x[2] for x in mine)


def test_indexes_are_dense_and_reproducible(spark):
    keys = spark.createDataFrame([(i * i - 40,) for i in range(200)], "k long")
    stored = {r.k: r.row_index for r in stored_index(keys, "k").collect()}
    assert [stored[k] for k in sorted(stored)] == list(range(200))
    first = {r.k: r.row_index for r in shuffled_index(keys, "k").collect()}
    again = {r.k: r.row_index for r in shuffled_index(keys.repartition(7), "k").collect()}
    assert first == again and sorted(first.values()) == list(range(200))
    assert first != stored and first != {r.k: r.row_index for r in shuffled_index(keys, "k", 7).collect()}


def test_batches_keep_the_short_one(spark):
    df = spark.createDataFrame([(i, [20] * i) for i in range(17)], "doc_id long, input_ids array<int>")
    made = B.pad_corpus(B.batch_train(df, "doc_id", 8)).collect()
    sizes = {}
    for r in made:
        sizes.setdefault(r.batch_id, []).append(r)
    assert sorted(len(v) for v in sizes.values()) == [1, 8, 8]
    for rows in sizes.values():
        longest = max(r.doc_id for r in rows)
        assert all(r.input_ids == [20] * r.doc_id + [1] * (longest - r.doc_id) for r in rows)
    stored = B.batch_eval(df, "doc_id", PRETRAINING.eval_batch_size).orderBy("doc_id").collect()
    assert [(r.batch_id, r.row_in_batch) for r in stored] == [(i // 4, i % 4) for i in range(17)]
    assert StageSettings(batch_size=1).eval_batch_size == 1


def test_padding_sft(spark):
    df = spark.createDataFrame(
        [("s", 0, [2, 3], [-100, 3]), ("s", 1, [2, 20, 3], [-100, 20, 3])],
        "src string, rec_id long, input_ids array<int>, labels array<int>",
    )
    rows = finetuning.eval_batches(df).orderBy("rec_id").collect()
    assert (rows[0].input_ids, rows[0].labels) == ([2, 3, 1], [-100, 3, -100])
    assert finetuning.train_batches(df).count() == 2


def test_index_has_no_unpartitioned_window_over_rows(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.createDataFrame([(i, [i]) for i in range(9)], "doc_id long, input_ids array<int>").write.parquet(path)
    plan = pretraining.train_batches(spark.read.parquet(path), "doc_id")._jdf.queryExecution().executedPlan().toString()
    # only the cell totals, at most 2^20 rows, meet in one partition; numbering reads keys alone
    assert plan.count("SinglePartition") == 1
    assert plan.count("ReadSchema: struct<doc_id:bigint>") == 2


def test_step_budget(spark):
    rows = spark.range(1001)
    assert tuple(B.step_budget(rows, PRETRAINING).first()) == (126, 252, 7)
    assert tuple(B.step_budget(rows, FINETUNING).first()) == (126, 126, 3)
    assert tuple(B.step_budget(rows, PRETRAINING, start_epoch=1).first()) == (126, 126, 3)


def test_split_sample_head(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    shares = {r.split: r["count"] for r in split(df, "k").groupBy("split").count().collect()}
    assert abs(shares["train"] - 4000) < 150 and abs(shares["test"] - 500) < 100
    one = [r.k for r in sample(df, "k", 50).collect()]
    assert one == [r.k for r in sample(df.repartition(5), "k", 50).collect()] and len(set(one)) == 50
    assert sample(df, "k", 9999).count() == 5000
    records = df.selectExpr("'s' AS src", "k AS rec_id")
    assert [r.rec_id for r in head(records, 3).collect()] == [0, 1, 2] and head(records, 9999).count() == 5000


@pytest.fixture(scope="module")
def tokenizer(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts[:20]], "text string")
    return Tokenizer.train(df, TokenizerSettings(vocab_size=150))


def test_prepared_batches(spark, texts, tokenizer, tmp_path):
    df = spark.createDataFrame(list(enumerate(texts[:30])), "doc_id long, text string")
    train, val = pretraining.prepare(df.filter("doc_id < 20"), df.filter("doc_id >= 20"), tokenizer, str(tmp_path))
    rows = pretraining.model_inputs(train).collect()
    assert len(rows) == 20 and val.count() == 10
    for r in rows:
        assert r.input_ids[0] == 2 and len(r.labels) == len(r.input_ids) - 1 == len(r.mask) - 1
        assert [x for x in r.labels if x != -100] == [x for x in r.input_ids[1:] if x != 1]
    records = spark.createDataFrame(
        [("s", i, "f", None, "w", t) for i, t in enumerate(texts[:10])],
        "src string, rec_id long, features string, words string, summary string, story string",
    )
    a, b = finetuning.prepare(records.limit(6), records, tokenizer, str(tmp_path))
    assert a.count() == 6 and b.count() == 10


def test_stream_equals_batch(spark, texts, tokenizer, tmp_path):
    df = spark.createDataFrame(list(enumerate(texts[:12])), "doc_id long, text string")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.repartition(3).write.json(source)
    stream = spark.readStream.schema("doc_id long, text string").json(source)
    write_sequences(stream, tokenizer, out, str(tmp_path / "ck")).awaitTermination(120)
    want = pretraining.corpus_sequences(df, tokenizer, "doc_id").orderBy("doc_id").collect()
    assert spark.read.parquet(out).orderBy("doc_id").collect() == want
    words = Tokenizer.train(df, TokenizerSettings("word-level", "whitespace", 100))
    out = str(tmp_path / "words")
    write_sequences(stream, words, out, str(tmp_path / "ck2")).awaitTermination(120)
    want = pretraining.corpus_sequences(df, words, "doc_id").orderBy("doc_id").collect()
    assert spark.read.parquet(out).orderBy("doc_id").collect() == want


@pytest.mark.parametrize("sources", [("a", "b"), (None, "b", "c")])
def test_eval_batches_of_several_sources(spark, sources):
    rows = [(s, i, [i] * (i + 1), [i] * (i + 1)) for s in sources for i in range(5)]
    df = spark.createDataFrame(rows, "src string, rec_id long, input_ids array<int>, labels array<int>").repartition(3)
    got = finetuning.eval_batches(df).orderBy("batch_id", "row_in_batch").collect()
    assert [(r.src, r.rec_id, 4 * r.batch_id + r.row_in_batch) for r in got] == [
        (s, i, 5 * k + i) for k, s in enumerate(sources) for i in range(5)
    ]


def test_batch_keys(spark):
    some = spark.createDataFrame([(None,), (3,), (1,)], "k long")
    for made in (B.batch_eval(some, "k"), B.batch_train(some, "k")):
        assert sorted(r.row_in_batch for r in made.collect()) == [0, 1, 2]
    assert [r.k for r in B.batch_eval(some, "k").orderBy("row_in_batch").collect()] == [None, 1, 3]
    twice = spark.createDataFrame([(3,), (3,), (1,)], "k long")
    for made in (B.batch_eval(twice, "k"), B.batch_train(twice, "k")):
        with pytest.raises(PySparkException, match="not unique"):
            made.collect()
