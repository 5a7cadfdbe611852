"""Words and shingles of a batch of texts as 64-bit fingerprints, in numpy.

A word is a run of ASCII letters, ASCII digits and bytes beyond ASCII; ASCII and Latin-1 letters are
lower-cased. Every function takes a whole batch, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of words that are fingerprinted at once; bounds the working memory, not the texts.
PIECE = 1 << 20
SHINGLE_WORDS = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_PLACE = mix(np.arange(1, 1025, dtype=np.uint64)) | np.uint64(1)
_BYTE = mix(np.arange(1001, 1257, dtype=np.uint64))
_STEP = mix(np.arange(5001, 5065, dtype=np.uint64)) | np.uint64(1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one array, and where each begins (one more for the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals as small letters, byte for byte."""
    out = _LOWER[data]
    latin = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    out[1:][latin] += 0x20
    return out


def spans(
    data: np.ndarray, off: np.ndarray, is_word: np.ndarray = _IS_WORD
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each text (one more for all).

    ``is_word`` tells the bytes of words from others, where words of another kind are wanted.
    """
    inside = is_word[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    cuts = off[:-1][off[:-1] < len(data)]
    if len(data):
        before[0] = False
        before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(data):
        after[-1] = False
        after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def fingerprints(
    low: np.ndarray, starts: np.ndarray, ends: np.ndarray, is_word: np.ndarray = _IS_WORD
) -> np.ndarray:
    """A 64-bit value for each word of the lower-cased bytes."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE)))
        first = starts[at]
        part = low[first : ends[to - 1]]
        begin = starts[at:to] - first
        place = np.arange(len(part)) - np.repeat(begin, np.diff(begin, append=len(part)))
        values = _BYTE[part] * _PLACE[place & 1023]
        values[~is_word[part]] = 0
        out[at:to] = np.add.reduceat(values, begin) + (ends[at:to] - starts[at:to]).astype(np.uint64)
        at = to
    return mix(out)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of a batch, and the number of words before each text."""
    data, off = utf8(column)
    starts, ends, counts = spans(data, off)
    return fingerprints(lowered(data), starts, ends), counts


def windows(values: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A fingerprint for each run of ``size`` values inside a text: fingerprints, first value, text.

    A text with fewer values, but one at least, counts as one window of all it has.
    """
    n = len(values)
    per_text = np.diff(counts)
    text = np.repeat(np.arange(len(per_text)), per_text)
    left = counts[1:][text] - np.arange(n)
    total = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        shifted = np.zeros(n, np.uint64)
        shifted[: n - k] = values[k:]
        shifted[left <= k] = 0
        total += shifted * _STEP[k % 64]
    keep = (left >= size) | ((per_text[text] < size) & (left == per_text[text]))
    first = np.flatnonzero(keep)
    return mix(total[first]), first, text[first]


def weighted(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each text with their counts: 48-bit value, text, count, ordered by text.

    Takes fewer than 65,536 texts at once, as one sort by text and value serves for all.
    """
    if not len(values):
        return values, text, np.zeros(0, np.int64)
    key = np.sort((text.astype(np.uint64) << np.uint64(48)) | (values >> np.uint64(16)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(first, append=len(key))
    key = key[first]
    return key & np.uint64((1 << 48) - 1), (key >> np.uint64(48)).astype(np.int64), counts


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 * PIECE, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``limit`` bytes of text; a longer text comes alone."""
    _, off = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
