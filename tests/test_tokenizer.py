import json
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer as Library
from tokenizers import decoders, models, normalizers, pre_tokenizers, trainers

from corpusloom.config import SPECIAL_TOKENS, TokenizerSettings
from corpusloom.operators import bpe, encode, merging, vocab
from corpusloom.plans import generation
from corpusloom.tokenizer import Tokenizer, get_or_train, load_tokenizer


def library(texts, how, size, min_frequency=2, model="bpe"):
    made = Library((models.BPE if model == "bpe" else models.WordLevel)(unk_token="[UNK]"))
    made.normalizer = normalizers.Sequence(
        [normalizers.Replace(Regex(r"\s+"), " "), normalizers.Strip()]
    )
    if how == "byte-level":
        made.pre_tokenizer, made.decoder = pre_tokenizers.ByteLevel(), decoders.ByteLevel()
    else:
        made.pre_tokenizer = pre_tokenizers.Whitespace()
    trainer = trainers.BpeTrainer if model == "bpe" else trainers.WordLevelTrainer
    made.train_from_iterator(
        [t for t in texts if t],
        trainer(vocab_size=size, min_frequency=min_frequency, special_tokens=list(SPECIAL_TOKENS),
                show_progress=False),
    )
    return made


def by_id(made):
    return [t for t, _ in sorted(made.get_vocab().items(), key=lambda e: e[1])]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def encoded(tok, df):
    rows = tok.encode(df, ["doc_id"], {"ids": "text"}).orderBy("doc_id").collect()
    return [r.ids for r in rows]


ODD = [
    "a[PAD]b <story>x", "The cat", " The cat", "", "   ", "日本", "[PAD] [EOS]", "x [PAD] y", "é 日本 [UNK]",
    "!<story>", "zzz qqq", "</story>end",
]


@pytest.fixture(scope="module", params=["byte-level", "whitespace"])
def pair(request, spark, texts):
    some = texts[:60] + ["x [PAD] y"] * 3
    chosen = TokenizerSettings(pre_tokenizer=request.param, vocab_size=500)
    return Tokenizer.train(frame(spark, some), chosen), library(some, request.param, 500), some


def test_bpe_training_like_library(pair):
    ours, theirs, _ = pair
    assert ours.merges.tokens == by_id(theirs)
    merges = [tuple(m) for m in json.loads(theirs.to_str())["model"]["merges"]]
    tokens = ours.merges.tokens
    assert [(tokens[a], tokens[b]) for a, b, _ in ours.merges.merges] == merges


def test_bpe_encoding_like_library(spark, pair, texts):
    ours, theirs, _ = pair
    some = texts + ODD + ["x" * 5000, "ab" * 3000]
    assert encoded(ours, frame(spark, some)) == [e.ids for e in theirs.encode_batch(some)]


def test_bpe_decoding_like_library(spark, pair, texts):
    ours, theirs, _ = pair
    some = texts[:50] + ODD
    coded = ours.encode(frame(spark, some), ["doc_id"], {"ids": "text"})
    got = [r.text for r in ours.decode(coded, "ids").orderBy("doc_id").collect()]
    assert got == [theirs.decode(e.ids) for e in theirs.encode_batch(some)]


REPEATS = (
    ["aaa aaaa aaaaa aa"] * 3
    + ["abab abab ababab", "aabb abba baab bbaa aaaabbbb abababab"] * 2
    + ["abcd bcd bcd abc abc ab cd cd dcba abab cdcd abcdabcd"] * 2
)


@pytest.mark.parametrize("pairs, segments", [(64, 50_000), (2, 50_000), (8, 3), (1, 0)])
def test_bpe_repeats_and_ties(spark, monkeypatch, pairs, segments):
    """Whatever a round may take, down to one pair, the merges are those learned one at a time."""
    monkeypatch.setattr(bpe, "FIRST_PAIRS", pairs)
    monkeypatch.setattr(bpe, "MAX_SEGMENTS", segments)
    monkeypatch.setattr(bpe, "MAX_PAIRS", pairs)
    theirs = library(REPEATS, "whitespace", 27)
    ours = bpe.train_bpe(
        frame(spark, REPEATS), TokenizerSettings(pre_tokenizer="whitespace", vocab_size=27)
    )
    assert ours.tokens == by_id(theirs)


def _best_pair(words):
    count = {}
    for syms, n in words:
        for pair in zip(syms, syms[1:]):
            count[pair] = count.get(pair, 0) + n
    return min(((-n, p) for p, n in count.items() if n > 0), default=None)


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=2, max_size=8), st.integers(1, 9)), min_size=1, max_size=12),
    st.integers(0, 4),
)
def test_bpe_merges_of_a_round_are_certain(words, shown):
    """With some of the words as segments and the sums of the others, what a round is sure of is right."""
    words = [(tuple(s), n) for s, n in words]
    counts = {}
    for syms, n in words:
        for pair in zip(syms, syms[1:]):
            counts[pair] = counts.get(pair, 0) + n
    step, new = bpe._Round(words[:shown], counts), 100
    while True:
        pair, n, sure = step.best()
        want = _best_pair(words)
        if pair is None or not sure:
            break
        assert (-n, pair) == want
        step.merge(pair, new)
        words = [(tuple(bpe.merged(list(s), {pair: (0, new)}) or s), n) for s, n in words]
        new += 1
    if shown >= len(words):
        assert pair is None and want is None


def test_bpe_counts_kept_by_differences(spark, texts):
    """The pair counts that rounds bring up to date are those of the words they leave."""
    df = frame(spark, texts[:40])
    counts = vocab.word_counts(df, "text", "byte-level")
    chars = sorted({c for r in counts.collect() for c in r.word})
    learner = bpe._Learner(counts, chars, TokenizerSettings(vocab_size=len(chars) + 60))
    learner.words = bpe.spell(counts, {c: learner.ids[c] for c in chars})
    learner._remove = lambda: None
    learner.run()
    assert learner.rounds >= 1
    kept = {(r.left_id, r.right_id): r.n for r in learner.pairs.collect()}
    assert kept == {(r.left_id, r.right_id): r.n for r in bpe.pair_counts(learner.words).collect()}


def test_bpe_same_string_from_two_merges(spark):
    """abc from a+bc and from ab+c: the second merge reuses the id and nothing else changes."""
    texts_ = ["bc bc bc bc bc bc abc abc abc abc xab xab xab xab xab xabc xabc ab ab ab ab"] * 3
    theirs = library(texts_, "whitespace", 60)
    ours = bpe.train_bpe(frame(spark, texts_), TokenizerSettings(pre_tokenizer="whitespace", vocab_size=60))
    assert ours.tokens == by_id(theirs)
    learned = {}
    for left, right, new in ours.merges:
        learned.setdefault(new, []).append((left, right))
    tok = Tokenizer(TokenizerSettings(pre_tokenizer="whitespace"), ours.vocab(spark), ours)
    some = ["abc xabc xab bc ab cab bcab xabcab"]
    assert encoded(tok, frame(spark, some)) == [e.ids for e in theirs.encode_batch(some)]


def test_word_level_like_library(spark, texts):
    settings = TokenizerSettings("word-level", "whitespace", vocab_size=300)
    tok = Tokenizer.train(frame(spark, texts), settings)
    theirs = library(texts, "whitespace", 300, model="word")
    got = [r.token for r in tok.vocab.orderBy("id").collect()]
    assert got == by_id(theirs)
    some = texts[:40] + ODD
    assert encoded(tok, frame(spark, some)) == [e.ids for e in theirs.encode_batch(some)]
    coded = tok.encode(frame(spark, some), ["doc_id"], {"ids": "text"})
    back = [r.text for r in tok.decode(coded, "ids").orderBy("doc_id").collect()]
    assert back == [theirs.decode(e.ids) for e in theirs.encode_batch(some)]


def test_null_text_encodes_to_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "a a")], "doc_id long, text string")
    tok = Tokenizer.train(df, TokenizerSettings("word-level", "whitespace", 20, 1))
    assert encoded(tok, df) == [[], [13, 13]]


def test_decoding_does_not_depend_on_the_size_in_the_settings(spark, texts):
    some = frame(spark, texts[:40])
    small = Tokenizer.train(some, TokenizerSettings("word-level", "whitespace", 300))
    named_large = Tokenizer(TokenizerSettings("word-level", "whitespace", 2_000_000), small.vocab)
    coded = named_large.encode(some, ["doc_id"], {"ids": "text"})
    answers = coded.withColumn("prompt_len", F.lit(0)).withColumn("ids", F.concat("ids", F.array(F.lit(12))))
    got = generation.story_texts(answers, named_large).orderBy("doc_id").collect()
    assert got == generation.story_texts(answers, small).orderBy("doc_id").collect()
    assert generation.continuation_texts(coded, named_large).count() == 40


def test_prompts_take_time_in_proportion_to_the_text(spark):
    """Long texts are encoded row by row; nothing carries the whole text along with every word."""
    tok = Tokenizer.train(frame(spark, ["a b c"]), TokenizerSettings("word-level", "whitespace", 50, 1))

    def seconds(words):
        df = spark.createDataFrame([(1, ["x"], ["y"], "a b " * (words // 2))], "k int, features array<string>, words array<string>, summary string")
        start = time.time()
        row = generation.story_prompts(df, tok, "k").collect()[0]
        assert len(row.prompt) == words + 10
        return time.time() - start

    seconds(1000)
    assert seconds(40_000) < 8 * seconds(10_000) + 1


def test_several_texts_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a b", "c"), (2, "", "b b a"), (3, None, "")], "k long, x string, y string")
    tok = Tokenizer.train(df.select(F.lit("a b c").alias("text")), TokenizerSettings("word-level", "whitespace", 20, 1))
    rows = tok.encode(df, ["k"], {"p": "x", "q": "y"}).orderBy("k").collect()
    assert [(r.p, r.q) for r in rows] == [([13, 14], [15]), ([], [14, 14, 13]), ([], [])]


def test_save_load_and_reuse(spark, texts, tmp_path):
    df = frame(spark, texts[:30])
    for settings in (
        TokenizerSettings("word-level", "whitespace", 100),
        TokenizerSettings(vocab_size=200),
    ):
        path = str(tmp_path / settings.strategy)
        with pytest.raises(FileNotFoundError):
            load_tokenizer(spark, path)
        made = get_or_train(df, path, settings)
        again = get_or_train(frame(spark, ["other words only"]), path, settings)
        assert again.settings == made.settings
        assert again.vocab.orderBy("id").collect() == made.vocab.orderBy("id").collect()
        assert again.merges == made.merges
        size = made.size()
        forced = get_or_train(frame(spark, ["other words only"] * 2), path, settings, force=True)
        assert forced.size() < size


def test_long_words_have_ids_of_their_own(spark):
    long = ["x" * 5000, "x" * 4999 + "y", "é" * 32, "é" * 33, "z" * 64, "z" * 65]
    df = frame(spark, [" ".join(long), " ".join(reversed(long))])
    tok = Tokenizer.train(df, TokenizerSettings("word-level", "whitespace", 100, 1))
    ids = {w: tok.token_to_id(w) for w in long}
    assert len({*ids.values()}) == len(long) and None not in ids.values()
    assert encoded(tok, df) == [[ids[w] for w in long], [ids[w] for w in reversed(long)]]
    assert encoded(tok, frame(spark, ["x" * 5001])) == [[0]]


def test_token_lookup(spark):
    tok = Tokenizer.train(frame(spark, ["a a b"]), TokenizerSettings("word-level", "whitespace", 20, 1))
    assert (tok.size(), tok.token_to_id("[PAD]"), tok.token_to_id("a"), tok.token_to_id("zz")) == (15, 1, 13, None)
    asked = spark.createDataFrame([("a",), ("zz",), ("[EOS]",)], "token string")
    found = {r.token: r.id for r in vocab.token_to_id(asked, tok.vocab).collect()}
    assert found == {"a": 13, "zz": None, "[EOS]": 3}


def test_word_counts_tokenize_each_text_once(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = vocab.word_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_word_level_encoding_needs_no_shuffle(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    tok = Tokenizer.train(docs, TokenizerSettings("word-level", "whitespace", 100))
    plan = tok.encode(docs, ["doc_id"], {"ids": "text"})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_word_level_encoding_and_decoding_stay_out_of_python(spark, small):
    """No Python worker holds rows, so its memory can't grow with them; and no row carries the vocabulary."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    tok = Tokenizer.train(docs, TokenizerSettings("word-level", "whitespace", 100))
    made = tok.decode(tok.encode(docs, ["doc_id"], {"ids": "text", "again": "text"}), "ids")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "AS __table" not in plan


def test_word_level_ids_of_many_words(spark):
    """Words that share a slot, unknown and empty ones, a table for each of several texts, one named as its source."""
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, f"w{i} no w{i + 1}", f"[PAD] w{i}") for i in range(0, 2900, 29)] + [(-1, None, "")]
    vocab_ = spark.createDataFrame(list(enumerate([*SPECIAL_TOKENS, *words])), "id int, token string")
    tok = Tokenizer(TokenizerSettings("word-level", "whitespace"), vocab_)
    df = spark.createDataFrame(rows, "i int, text string, other string")
    got = {r.i: (r.text, r.ids) for r in tok.encode(df, ["i"], {"text": "text", "ids": "other"}).collect()}
    first = len(SPECIAL_TOKENS)
    assert got.pop(-1) == ([], [])
    assert got == {i: ([first + i, 0, first + i + 1], [1, first + i]) for i, *_ in rows[:-1]}


def test_bpe_encoding_needs_no_shuffle(spark, pair, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = pair[0].encode(docs, ["doc_id"], {"ids": "text"})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.lists(st.integers(0, 3), max_size=9), max_size=12),
    st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7), st.integers(4, 8)), max_size=8),
)
def test_merges_of_many_words_at_once(words, merges):
    """Merges in order, and by lowest rank (ids made twice or taken up earlier, too), as word by word."""
    ranks = {(a, b): (i, new) for i, (a, b, new) in enumerate(merges)}
    flat = np.array([s for w in words for s in w], np.int32)
    off = np.cumsum([0, *map(len, words)])

    def cut(values, begins, _):
        return [values[a:b].tolist() for a, b in zip(begins, begins[1:])]

    assert cut(*merging.merge(flat, off, merging.Ranks(ranks, in_order=True))) == [bpe.merged(list(w), ranks) or w for w in words]

    def lowest_first(word):
        word = list(word)
        while found := [(ranks[p][0], i) for i, p in enumerate(zip(word, word[1:])) if p in ranks]:
            _, i = min(found)
            word[i : i + 2] = [ranks[word[i], word[i + 1]][1]]
        return word

    if all(new not in (a, b) for a, b, new in merges) and all(new > max(a, b) for a, b, new in merges):
        assert cut(*merging.merge(flat, off, merging.Ranks(ranks, in_order=False))) == [lowest_first(w) for w in words]


@pytest.mark.parametrize("words_at_once", [1, 1 << 18])
def test_words_of_any_length_in_stretches(spark, monkeypatch, words_at_once):
    """Segmented together or alone (long words, marks), in stretches of any size, with the library's ids."""
    monkeypatch.setattr(encode, "WORDS_AT_ONCE", words_at_once)
    rows = ["ab" * 400 + " abc [EOS] aaaaa", "", "é abab" * 3, "ab" * 300] + REPEATS
    theirs = library(rows, "whitespace", 60)
    ours = bpe.train_bpe(frame(spark, rows), TokenizerSettings(pre_tokenizer="whitespace", vocab_size=60))
    assert ours.tokens == by_id(theirs)
    tok = Tokenizer(TokenizerSettings(pre_tokenizer="whitespace"), ours.vocab(spark), ours)
    got = encode.encode_texts(frame(spark, rows), tok._encoder(), {"ids": "text"}, "whitespace").select("text", "ids").collect()
    assert [r.ids for r in got] == [theirs.encode(r.text).ids for r in got]


def test_a_batch_of_words_takes_its_ids_once(spark):
    """Beside the ids there is one stretch, whatever the number of words."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    per_word = encode._per_word(lambda words: (np.arange(len(words), dtype=np.int32), np.arange(len(words) + 1)))

    def peak(rows: int) -> int:
        texts = pa.array([["ab", "c", "ab", "d"] * 2048] * rows, pa.list_(pa.string()))
        tracemalloc.start()
        made = per_word.func(texts)
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert made.to_pylist() == [[0, 1, 0, 2] * 2048] * rows
        return held

    words = 256 * 8192
    assert peak(320) - peak(64) < 6 * words  # four bytes an id; the ids twice and each word's end would be twelve
