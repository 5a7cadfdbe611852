import random

import pytest

from corpusloom.operators import records as R
from corpusloom.sources import corpus as S

SCHEMA = "src string, line_no long, text string"


def parsed(df, src):
    rows = R.make_records(df).filter(f"src = '{src}'").orderBy("rec_id").collect()
    assert [r.rec_id for r in rows] == list(range(len(rows)))
    return [(r.features, r.words, r.summary, r.story) for r in rows]


EDGE = [
    "Features: a", "before", "Story:", "hello", "  ", "world", "<|endoftext|>", "<|endoftext|>",
    " Words:x", "Words: y z", "Features:Dx", "Summary:", "t1", "Story:", "t2", " Story: ", "t3",
    " <|endoftext|> ", None, "　only text\x1f", "<|endoftext|>", "Features: tail",
]


# the records of the lines above, written out by hand
EDGE_RECORDS = [
    ("a", "", "", "hello  world"),
    ("", "", "", ""),
    ("x", "y z", "", "t3"),
    ("", "", "", "only text"),
]


def test_edge_lines(spark):
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(EDGE)], SCHEMA)
    assert parsed(df, "s") == EDGE_RECORDS
    assert parsed(df.selectExpr("CAST(NULL AS string) AS src", "line_no", "text"), "") == EDGE_RECORDS


def written(rng, i):
    """A record, and lines that stand for it: fields in any order, some twice, text before the story."""
    fields = {"features": f"f{i}", "words": f"w{i}, v", "summary": f"s {i}"}
    marks = dict(R.FIELD_MARKS)
    chosen = {k: v for k, v in fields.items() if rng.random() < 0.7}
    lines = [f" {marks[k]} {v}" for k, v in chosen.items()]
    lines += [f"{marks[k]} old" for k in chosen if rng.random() < 0.2]
    lines.reverse()
    story = [f"line {i}.{j}" for j in range(rng.randrange(5))]
    if rng.random() < 0.8:
        lines += [f"noise {i}"] * rng.randrange(3) + ["Story:"]
    record = tuple(chosen.get(k, "") for k in ("features", "words", "summary")) + (" ".join(story),)
    return record, lines + [f"  {x} " for x in story] + ["<|endoftext|>"]


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_random_streams_give_the_records_they_were_made_of(spark, partitions):
    rng = random.Random(partitions)
    made = {src: [written(rng, i) for i in range(n)] for src, n in (("hot", 150), ("cold", 10))}
    streams = {src: [line for _, lines in some for line in lines] for src, some in made.items()}
    streams["never"] = ["Story:", "no end", "here"]
    rows = []
    for src, lines in streams.items():
        # positions rise with gaps and cross several cells
        at = 0
        for text in lines:
            at += rng.choice([1, 7, 1 << 19, 1 << 43 if src == "cold" else 3])
            rows.append((src, at, text))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    for src in streams:
        assert parsed(df, src) == [record for record, _ in made.get(src, [])]


def test_unended_source_is_dropped_before_it_is_collected(spark):
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(EDGE)], SCHEMA)
    plan = R.make_records(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "n_records" in plan[plan.index("Join") :]
    # the parts of the plan with a window all partition by source and cell
    physical = R.make_records(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in physical


def test_text_files_keep_their_line_order(spark, tmp_path):
    lines = [f"Features: {i}\nStory:\nline {i}\n<|endoftext|>" for i in range(300)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("Story:\nB\n<|endoftext|>\ntail")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = S.read_instruct_lines(spark, str(tmp_path), "text")
        rows = R.make_records(df).orderBy("src", "rec_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.features, r.story) for r in rows[:300]] == [(str(i), f"line {i}") for i in range(300)]
    assert [r.story for r in rows[300:]] == ["B"]


def test_records_go_on_in_the_next_file(spark, tmp_path):
    (tmp_path / "part-0.txt").write_text("Features: f\nStory:\none\n")
    (tmp_path / "part-1.txt").write_text("two\n<|endoftext|>\nStory:\n")
    (tmp_path / "part-2.txt").write_text("three\n<|endoftext|>\n")
    rows = R.make_records(S.read_instruct_lines(spark, str(tmp_path), "text")).orderBy("rec_id").collect()
    assert [(r.features, r.story) for r in rows] == [("f", "one two"), ("", "three")]
    alone = R.make_records(S.read_instruct_lines(spark, str(tmp_path), "text", per_file=True))
    assert sorted(r.story for r in alone.collect()) == ["three", "two"]


def test_a_failed_rebuild_leaves_no_pair(spark, tmp_path, monkeypatch):
    def lines(word):
        return spark.createDataFrame([("s", 0, f"Words: {word}"), ("s", 1, "<|endoftext|>")], SCHEMA)

    folder = str(tmp_path)
    S.get_or_make_records(lines("a"), lines("b"), folder)
    (tmp_path / "sft_train" / "_SUCCESS").unlink()
    save = S.save_records

    def fails(records, path):
        if path.endswith("sft_val"):
            raise OSError("lost")
        save(records, path)

    monkeypatch.setattr(S, "save_records", fails)
    with pytest.raises(OSError):
        S.get_or_make_records(lines("c"), lines("d"), folder)
    monkeypatch.undo()
    pair = S.get_or_make_records(lines("e"), lines("f"), folder)
    assert [df.first().words for df in pair] == ["e", "f"]


def test_records_are_reused_only_as_a_pair(spark, tmp_path):
    def lines(word):
        return spark.createDataFrame([("s", 0, f"Words: {word}"), ("s", 1, "<|endoftext|>")], SCHEMA)

    def words(pair):
        return [df.first().words for df in pair]

    folder = str(tmp_path)
    assert words(S.get_or_make_records(lines("a"), lines("b"), folder)) == ["a", "b"]
    assert words(S.get_or_make_records(lines("c"), lines("d"), folder)) == ["a", "b"]
    (tmp_path / "sft_val" / "_SUCCESS").unlink()
    assert words(S.get_or_make_records(lines("c"), lines("d"), folder)) == ["c", "d"]


def test_split_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", "train"), ("b", "validation")], "text string, split string").write.parquet(path)
    df = S.read_corpus(spark, path, "train")
    assert [r.text for r in df.collect()] == ["a"]
    assert "EqualTo(split,train)" in df._jdf.queryExecution().executedPlan().toString()
