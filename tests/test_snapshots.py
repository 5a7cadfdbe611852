"""Snapshots behind one pointer, and counts maintained under change."""

import pytest
from pyspark.sql import functions as F

from corpusloom.config import TokenizerSettings
from corpusloom.operators import maintained, vocab
from corpusloom.sources import corpus as S
from corpusloom.sources import snapshots
from corpusloom.tokenizer import Tokenizer, load_tokenizer

WORDS = TokenizerSettings("word-level", "whitespace", vocab_size=60)
BYTES = TokenizerSettings(vocab_size=150)


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def put(spark, *names):
    def write(folder):
        for name in names:
            spark.createDataFrame([(name,)], "x string").write.parquet(f"{folder}/{name[0]}")

    return write


def test_versions_in_order_and_earlier_ones_stay(spark, tmp_path):
    root = f"{tmp_path}/s"
    assert snapshots.current(spark, root) == (0, None)
    assert [snapshots.publish(spark, root, put(spark, f"a{i}", f"b{i}")) for i in range(12)] == list(range(1, 13))
    for asked, want in ((None, 11), (3, 2)):
        _, folder = snapshots.current(spark, root, asked)
        assert [spark.read.parquet(f"{folder}/{n}").first().x for n in "ab"] == [f"a{want}", f"b{want}"]
    with pytest.raises(FileNotFoundError):
        snapshots.current(spark, root, 77)


def test_of_two_writers_one_wins(spark, tmp_path):
    """The second begins and ends while the first writes: the first must not replace it."""
    root = f"{tmp_path}/s"
    snapshots.publish(spark, root, put(spark, "a0", "b0"))

    def slow(folder):
        put(spark, "a1", "b1")(folder)
        snapshots.publish(spark, root, put(spark, "a2", "b2"))

    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, root, slow)
    version, folder = snapshots.current(spark, root)
    assert version == 2
    assert [spark.read.parquet(f"{folder}/{n}").first().x for n in "ab"] == ["a2", "b2"]


@pytest.mark.parametrize("step", ["first table", "second table", "pointer"])
def test_a_crash_at_any_step_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    root = f"{tmp_path}/s"
    snapshots.publish(spark, root, put(spark, "a0", "b0"))

    def dies(folder):
        if step == "first table":
            raise OSError("lost")
        put(spark, "a1")(folder)
        if step == "second table":
            raise OSError("lost")
        put(spark, "b1")(folder)

    if step == "pointer":
        monkeypatch.setattr(snapshots, "_point", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        snapshots.publish(spark, root, dies)
    monkeypatch.undo()
    version, folder = snapshots.current(spark, root)
    assert (version, spark.read.parquet(f"{folder}/a").first().x) == (1, "a0")
    assert snapshots.publish(spark, root, put(spark, "a2", "b2")) == 2


def test_pairs_of_records(spark, tmp_path):
    def lines(word):
        rows = [("s", 0, f"Words: {word}"), ("s", 1, "<|endoftext|>")]
        return spark.createDataFrame(rows, "src string, line_no long, text string")

    def read(*pair):
        return [df.first().words for df in pair]

    root = f"{tmp_path}/r"
    assert read(*S.publish_records(lines("a"), lines("b"), root)) == ["a", "b"]
    assert read(*S.publish_records(lines("c"), lines("d"), root)) == ["a", "b"]
    before = S.publish_records(lines("c"), lines("d"), root)
    assert read(*S.publish_records(lines("c"), lines("d"), root, force=True)) == ["c", "d"]
    # a reader of the version before goes on reading it
    assert read(*before) == ["a", "b"]


def test_a_saved_tokenizer_has_versions(spark, tmp_path):
    path = f"{tmp_path}/t"
    for texts in (["a a b b"], ["c c d d e e"]):
        Tokenizer.train(frame(spark, texts), WORDS).save(path)
    assert [load_tokenizer(spark, path, v).size() for v in (1, 2, None)] == [15, 16, 16]


@pytest.mark.parametrize("settings", [WORDS, BYTES])
def test_vocabulary_after_changes_is_the_one_from_scratch(spark, texts, tmp_path, settings):
    root = f"{tmp_path}/c"
    first, later, gone = texts[:30], texts[30:60], texts[10:25]
    assert maintained.update_counts(spark, root, settings, frame(spark, first)) == 1
    assert maintained.update_counts(spark, root, settings, frame(spark, later), frame(spark, gone)) == 2
    left = frame(spark, first[:10] + first[25:] + later)
    got = maintained.stored_counts(spark, root, settings)
    want = vocab.word_counts(left, "text", settings.pre_tokenizer)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    made, scratch = Tokenizer.from_counts(got, settings), Tokenizer.train(left, settings)
    assert made.vocab.orderBy("id").collect() == scratch.vocab.orderBy("id").collect()
    assert made.merges == scratch.merges
    assert maintained.stored_counts(spark, root, settings, 1).count() > 0


def test_old_documents_are_not_read(spark, texts, tmp_path):
    """The folder of documents counted before may be gone."""
    old, root = tmp_path / "old", f"{tmp_path}/c"
    frame(spark, texts[:20]).write.parquet(str(old))
    maintained.update_counts(spark, root, WORDS, spark.read.parquet(str(old)))
    old.rename(tmp_path / "elsewhere")
    maintained.update_counts(spark, root, WORDS, frame(spark, ["zebra zebra"]))
    assert maintained.stored_counts(spark, root, WORDS).filter("word = 'zebra'").first().n == 2


def test_changes_are_made_once_and_checked(spark, tmp_path):
    root = f"{tmp_path}/c"
    maintained.update_counts(spark, root, WORDS, frame(spark, ["a b", None, ""]), after=0)
    with pytest.raises(snapshots.Conflict):  # the same change again
        maintained.update_counts(spark, root, WORDS, frame(spark, ["a b"]), after=0)
    with pytest.raises(Exception, match="more removed than added: zz"):
        maintained.update_counts(spark, root, WORDS, removed=frame(spark, ["zz"]))
    with pytest.raises(ValueError, match="split otherwise"):
        maintained.update_counts(spark, root, BYTES, frame(spark, ["a"]))
    maintained.update_counts(spark, root, WORDS, removed=frame(spark, ["a"]))
    assert [tuple(r) for r in maintained.stored_counts(spark, root, WORDS).collect()] == [("b", 1)]
    only = maintained.count_changes(frame(spark, ["x y"]), frame(spark, ["y"]), WORDS)
    assert [tuple(r) for r in only.filter(F.col("n") != 0).collect()] == [("x", 1)]
