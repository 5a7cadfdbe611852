"""Records from lines that arrive out of order, in micro-batches, over restarts."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import records as R
from corpusloom.streaming import records as SR

LINES = "src string, line_no long, text string"


def lines_of(seed, sources):
    rng = random.Random(seed)
    rows = []
    for src, records in sources:
        texts = []
        for i in range(records):
            texts += rng.sample(["Features: f", f" Words: w{i}", "Summary:s", "noise"], rng.randrange(5))
            texts += rng.choice([["Story:"], []]) + [rng.choice(["", f" line {i} ", None]) for _ in range(rng.randrange(4))]
            texts += ["<|endoftext|>"]
        rows += [(src, n, t) for n, t in enumerate(texts + ["Features: open", "tail"])]
    return rows


def dealt(spark, rows, folder, files, seed):
    """The rows in any order over so many files, each a micro-batch."""
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    for k in range(files):
        spark.createDataFrame(rows[k::files], LINES).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, horizon=None):
    read = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = SR.write_records(read, f"{tmp_path}/out", f"{tmp_path}/check", horizon)
    query.awaitTermination()
    return spark.read.schema(SR.RECORDS).parquet(f"{tmp_path}/out")


def same(stream, lines):
    columns = ["src", "rec_id", *R.FIELDS]
    got = sorted(tuple(r) for r in stream.filter("NOT late").select(columns).collect())
    want = sorted(tuple(r) for r in R.make_records(lines).select(columns).collect())
    assert got == want and want


def test_shuffled_micro_batches_and_a_restart(spark, tmp_path):
    rows = lines_of(1, [("hot", 40), ("cold", 3), ("", 2)])
    half = random.Random(2).sample(rows, len(rows) // 2)
    dealt(spark, half, f"{tmp_path}/in", 3, 3)
    first = run(spark, tmp_path).count()
    # the rest, with lines that come again, to a query that starts anew from its checkpoint
    rest = [r for r in rows if r not in half] + half[:20]
    dealt(spark, rest, f"{tmp_path}/in", 3, 4)
    after = run(spark, tmp_path)
    same(after, spark.createDataFrame(rows, LINES))
    assert first < after.count()


def test_nothing_is_put_out_before_its_turn(spark, tmp_path):
    rows = [("a", n, t) for n, t in enumerate(["Story:", "one", "<|endoftext|>", "two", "<|endoftext|>"])]
    dealt(spark, [r for r in rows if r[1] != 1], f"{tmp_path}/in", 1, 0)
    assert run(spark, tmp_path).count() == 0
    dealt(spark, rows[1:2], f"{tmp_path}/in", 1, 0)
    assert [(r.rec_id, r.story) for r in run(spark, tmp_path).orderBy("rec_id").collect()] == [(0, "one"), (1, "two")]


def test_gaps_and_late_lines_with_a_horizon(spark, tmp_path):
    ends = [("a", 10 * n, t) for n, t in enumerate(["x", "<|endoftext|>", "y", "<|endoftext|>", "z", "z", "z", "z"])]
    dealt(spark, ends, f"{tmp_path}/in", 1, 0)
    assert [(r.rec_id, r.story) for r in run(spark, tmp_path, 30).orderBy("rec_id").collect()] == [(0, "x"), (1, "y")]
    # one that can still be placed, one whose turn is over, and one without a place
    dealt(spark, [("a", 45, "w"), ("a", 5, "Words: late"), ("a", None, "lost"), ("a", 90, "<|endoftext|>"), ("a", 200, "v")],
          f"{tmp_path}/in", 1, 0)
    rows = run(spark, tmp_path, 30).collect()
    assert sorted((r.rec_id, r.story) for r in rows if not r.late) == [(0, "x"), (1, "y"), (2, "z w z z z")]
    assert sorted(r.story for r in rows if r.late) == ["late", "lost"]


def test_null_source_is_a_source(spark, tmp_path):
    rows = [(None, 0, "x"), (None, 1, "<|endoftext|>")]
    dealt(spark, rows, f"{tmp_path}/in", 1, 0)
    same(run(spark, tmp_path), spark.createDataFrame(rows, LINES))


def test_lines_of_the_tables(spark, small, tmp_path):
    from checks import inputs

    lines = inputs.dense_lines(spark, small)
    lines.repartition(5, F.xxhash64("line_no")).write.parquet(f"{tmp_path}/in")
    same(run(spark, tmp_path), lines)


def test_what_waits_is_a_table_and_a_batch_run_again_changes_nothing(spark, tmp_path):
    rows = lines_of(5, [("hot", 30)])
    for number, part in enumerate((rows[1:], rows[:1])):
        for _ in range(2):
            SR._assemble(spark, f"{tmp_path}/out", f"{tmp_path}/check", None, spark.createDataFrame(part, LINES), number)
        waiting = spark.read.schema(SR.LINES).parquet(f"{tmp_path}/check/assembly/{number}/waiting")
        assert waiting.count() == (2 if number else len(rows) - 1)
    same(spark.read.schema(SR.RECORDS).parquet(f"{tmp_path}/out"), spark.createDataFrame(rows, LINES))
