import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from corpusloom.config import SPECIAL_TOKENS, TokenizerSettings
from corpusloom.functions import text as T
from corpusloom.operators.selection import drop_empty

ODD = [
    "  hi\n\n there ", "a b", "　x y ", "", "   ", "The cat isn't 12 été", " The cat",
    "日本語 text", "x‍y", "éa ①②", "don't we'll I'M", "a  b\t\tc", "1½ Ⅷ", "_a_b", "\x1cq\x1f",
    "emoji 😀😀!", "\x00nul", "\x85next",
]


def library_normalizer():
    return normalizers.Sequence([normalizers.Replace(Regex(r"\s+"), " "), normalizers.Strip()])


def library_words(text, how):
    cut = pre_tokenizers.ByteLevel() if how == "byte-level" else pre_tokenizers.Whitespace()
    clean = library_normalizer().normalize_str(text)
    return [w for w, _ in cut.pre_tokenize_str(clean)] if clean else []


def test_normalize_like_library(column):
    got = column(ODD, "string", T.normalize_whitespace)
    assert got == [library_normalizer().normalize_str(t) for t in ODD]
    assert got[0] == "hi there"


@pytest.mark.parametrize("how", ["whitespace", "byte-level"])
def test_words_like_library(column, texts, how):
    some = ODD + texts[:80]
    got = column(some, "string", lambda c: T.pre_tokenize(c, how))
    assert got == [library_words(t, how) for t in some]


def test_byte_level_without_normalizer(column):
    raw = ["a  b \n c", "  lead", "tail  ", "x\n\ny", " one"]
    got = column(raw, "string", lambda c: T.pre_tokenize(c, "byte-level", normalize=False))
    cut = pre_tokenizers.ByteLevel()
    assert got == [[w for w, _ in cut.pre_tokenize_str(t)] for t in raw]


def test_bytes_round_trip(column):
    assert column(ODD, "string", lambda c: T.read_bytes(T.show_bytes(c))) == ODD
    # a cut multi-byte character becomes the replacement character
    assert column(["Ã"], "string", T.read_bytes) == ["�"]


def test_python_strip(column):
    blanks = ["\x1c\x1d a \x1e\x1f", " b ", " \x85c　", "​d"]
    assert column(blanks, "string", T.python_strip) == [t.strip() for t in blanks]
    assert set(T.PYTHON_BLANKS) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_split_specials(column):
    assert column(["a[PAD]b <story>x", "plain", "[EOS][EOS]", "", "[PAD"], "string", T.split_specials) == [
        ["a", "[PAD]", "b ", "<story>", "x"], ["plain"], ["[EOS]", "[EOS]"], [""], ["[PAD"],
    ]
    # a token that starts another gives way to the longer one
    got = column(["xabcab"], "string", lambda c: T.split_specials(c, ("ab", "abc")))
    assert got == [["x", "abc", "ab"]]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([*SPECIAL_TOKENS[:7], "a", " ", "[", "<", "]", "\n"])), min_size=20, max_size=20))
def test_split_specials_loses_nothing(column, parts):
    written = ["".join(p) for p in parts]
    got = column(written, "string", T.split_specials)
    assert ["".join(p) for p in got] == written
    for pieces in got:
        for piece in pieces:
            assert piece in SPECIAL_TOKENS or not any(s in piece for s in SPECIAL_TOKENS)


def test_clean_generated_follows_order(column):
    expected = {
        "a , b . c ! d ? it 's \n x": "a, b. c! d? it's\n x",
        "a  , b": "a , b",
        "  ,": ",",
        "Hello , world !": "Hello, world!",
    }
    got = column(list(expected), "string", T.clean_generated)
    assert got == list(expected.values())


def test_format_duration(column):
    expected = {
        0.0: "0:0:0.0", 0.25: "0:0:0.2", 0.75: "0:0:0.8", 12.35: "0:0:12.3", 59.94: "0:0:59.9", 60.0: "0:1:0.0",
        61.5: "0:1:1.5", 3599.9: "0:59:59.9", 3600.0: "1:0:0.0", 3725.04: "1:2:5.0", 86399.9: "23:59:59.9",
        360000.0: "100:0:0.0",
    }
    assert column(list(expected), "double", T.format_duration) == list(expected.values())


def test_join_fields(column):
    assert column([["a", "b"], [], None], "array<string>", T.join_fields) == ["a, b", "", ""]


def test_missing_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "x")], "i int, text string")
    assert [r.i for r in drop_empty(df).orderBy("i").collect()] == [3, 4]
    filled = df.select("i", T.default_text(F.col("text")).alias("t")).orderBy("i").collect()
    assert [r.t for r in filled] == ["", "", "  ", "x"]


@pytest.mark.parametrize(
    "strategy, cut", [("other", "whitespace"), ("word-level", "other"), ("word-level", "byte-level")]
)
def test_settings_are_validated(strategy, cut):
    with pytest.raises(ValueError):
        TokenizerSettings(strategy, cut)
