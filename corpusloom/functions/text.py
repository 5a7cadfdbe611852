"""Column functions over text. All of them stay in the JVM and need no shuffle."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.config import SPECIAL_TOKENS

# The characters Python's str.strip() removes.
PYTHON_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Pre-tokenizer patterns (Unicode classes).
WORD_OR_SYMBOLS = r"(?U)\w+|[^\w\s]+"
BYTE_LEVEL_PIECES = (
    r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

# Spacing repairs of generated text, in the order they apply.
SPACING_REPAIRS = (
    (" ,", ","),
    (" .", "."),
    (" !", "!"),
    (" ?", "?"),
    (" '", "'"),
    (" \n", "\n"),
    ("Ġ", " "),
    ("Ċ", "\n"),
)


def _byte_characters() -> tuple[str, str]:
    """Bytes without a printable Latin-1 character, and the characters that stand for them.

    Those bytes take the code points from 256 on, in byte order; every other byte stands for itself.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return "".join(map(chr, hidden)), "".join(chr(256 + i) for i in range(len(hidden)))


RAW_BYTES, SHOWN_BYTES = _byte_characters()


def default_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def python_strip(text: Column) -> Column:
    return F.btrim(text, F.lit(PYTHON_BLANKS))


def words_whitespace(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_OR_SYMBOLS), F.lit(0))


def show_bytes(word: Column) -> Column:
    """Spell the UTF-8 bytes of a word with one printable character each."""
    return F.translate(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), RAW_BYTES, SHOWN_BYTES)


def read_bytes(shown: Column) -> Column:
    """Reverse of :func:`show_bytes`; invalid UTF-8 becomes U+FFFD."""
    # byte 0 is put back on its own: translate takes it for a deletion
    latin = F.translate(shown, SHOWN_BYTES[1:], RAW_BYTES[1:])
    latin = F.replace(latin, F.lit(SHOWN_BYTES[0]), F.lit(RAW_BYTES[0]))
    return F.make_valid_utf8(F.encode(latin, "ISO-8859-1").cast("string"))


def pieces_bytelevel(text: Column) -> Column:
    """Byte-level words in plain spelling: one blank is put in front of a text that has none."""
    spaced = F.when(
        F.startswith(text, F.lit(" ")) | (text == ""), text
    ).otherwise(F.concat(F.lit(" "), text))
    return F.regexp_extract_all(spaced, F.lit(BYTE_LEVEL_PIECES), F.lit(0))


def words_bytelevel(text: Column) -> Column:
    return F.transform(pieces_bytelevel(text), show_bytes)


def pre_tokenize(text: Column, how: str, normalize: bool = True, spelled: bool = True) -> Column:
    """Words of one text, without regard to special tokens written in it (training side).

    ``spelled=False`` leaves byte-level words in plain spelling, for callers that spell each
    distinct word once.
    """
    clean = default_text(text)
    clean = normalize_whitespace(clean) if normalize else clean
    if how == "whitespace":
        return words_whitespace(clean)
    if how == "byte-level":
        return words_bytelevel(clean) if spelled else pieces_bytelevel(clean)
    raise ValueError(f"no such way to split words: {how}")


def _any_of(tokens: Sequence[str]) -> str:
    # longest first, so that a token that starts another never hides it
    longest_first = sorted(tokens, key=lambda t: (-len(t), t))
    starts = "".join(sorted({re.escape(t[0]) for t in tokens}))
    # the look-ahead rejects most characters by one class test
    return rf"(?=[{starts}])(?:{'|'.join(map(re.escape, longest_first))})"


def split_specials(text: Column, specials: Sequence[str] = SPECIAL_TOKENS) -> Column:
    """Cut a text into special tokens written in it and the stretches between them."""
    token = _any_of(specials)
    pieces = F.regexp_extract_all(
        text, F.lit(rf"(?s){token}|.+?(?={token}|\z)"), F.lit(0)
    )
    return F.when(text.rlike(token), pieces).otherwise(F.array(text))


def encodable_words(
    text: Column,
    how: str,
    normalize: bool = True,
    specials: Sequence[str] = SPECIAL_TOKENS,
    spelled: bool = True,
) -> Column:
    """Words of one text as the encoder sees them: special tokens whole, the rest pre-tokenized."""
    text = default_text(text)
    plain = pre_tokenize(text, how, normalize, spelled)
    mixed = F.flatten(
        F.transform(
            split_specials(text, specials),
            lambda piece: F.when(piece.isin(*specials), F.array(piece)).otherwise(
                pre_tokenize(piece, how, normalize, spelled)
            ),
        )
    )
    return F.when(text.rlike(_any_of(specials)), mixed).otherwise(plain)


def join_fields(items: Column) -> Column:
    return F.coalesce(F.array_join(items, ", "), F.lit(""))


def clean_generated(text: Column) -> Column:
    for written, wanted in SPACING_REPAIRS:
        text = F.replace(text, F.lit(written), F.lit(wanted))
    return python_strip(text)


def _round_tenth(x: Column) -> Column:
    """Nearest tenth of the exact binary value, ties to the even tenth, as Python rounds.

    20x is taken as an exact sum of two doubles, so 12.35 (stored a little below) gives 12.3.
    """
    high = x * 16 + x * 4
    low = x * 4 - (high - x * 16)
    half_steps = F.rint(high)
    excess = (high - half_steps) + low
    lower = F.floor(half_steps / 2)
    up = (half_steps % 2 == 1) & ((excess > 0) | ((excess == 0) & (lower % 2 == 1)))
    return F.when(up, lower + 1).otherwise(lower) / F.lit(10.0)


def format_duration(seconds: Column) -> Column:
    """``h:m:s.s`` without zero padding; hours and minutes truncated, seconds to one decimal."""
    return F.concat_ws(
        ":",
        F.floor(seconds / 3600).cast("string"),
        F.floor(seconds % F.lit(3600) / 60).cast("string"),
        _round_tenth(seconds % F.lit(60)).cast("string"),
    )
