"""Byte-level BPE by backtracking over longest matches.

A sequence of tokens is what BPE's merges give exactly when each two neighbours are: merging the bytes
of the two must end in these two. So a piece is encoded by taking the longest token at each position,
trying the next shorter one when it doesn't go with the token before, and stepping back when none does.
A position that was left without success is marked, so none is tried twice and the time is linear in
the piece. Whether two tokens go together is worked out once and kept.

Tokens are looked up in a trie of strings, in which each byte is the Latin-1 character of its value. The
longest tokens of a piece come from one pass of the automaton, up to the first two that don't go together;
from there the piece is gone through step by step.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the two memos; they are emptied when full, which changes no result.
MEMO = 1 << 19
#: Longer pieces are not kept.
MEMO_CHARS = 64


class _Known(dict):
    """The ids of pieces as an array's bytes; one that is missing is encoded, and kept if it is short."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, match: str) -> bytes:
        found = array("i", self.encode(match.encode().decode("latin-1"))).tobytes()
        if len(match) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[match] = found
        return found


class Codec:
    """Encoder and decoder of one vocabulary, given as ``{bytes: rank}``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.ids = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.token = dict(zip(self.ids.values(), self.ids, strict=True))
        self.spelling = dict(zip(ranks.values(), ranks, strict=True))
        self.widest = max(map(len, self.ids), default=1)
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in self.ids.items():
            self.trie.add_word(token, rank)
        self.trie.make_automaton()
        size = max(self.token, default=0) + 1
        self.none = size  # above every rank
        self.widths = [len(self.token.get(i, "")) for i in range(size)]
        self.prefixes = [-2] * size
        self.pairs: dict[tuple[int, int], bool] = {}
        self.traces: dict[int, tuple | None] = {}
        self.known = _Known(self.encode_piece)

    def trace(self, token: int) -> tuple:
        """How a token comes about by merging: the ranks in their order, its first part before each and its last one.

        After the last merge there is no next rank, and both parts are the token. None if merging ends otherwise.
        """
        if token not in self.traces:
            ids, none, text = self.ids, self.none, self.token[token]
            parts, merges, first, last = list(text), [], [], []
            while len(parts) > 1:
                ranks = [ids.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
                best = min(ranks)
                if best == none:
                    break
                merges.append(best)
                first.append(parts[0])
                last.append(parts[-1])
                at = ranks.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            whole = parts == [text]
            self.traces[token] = ((*merges, none), (*first, text), (*last, text)) if whole else None
        return self.traces[token]

    def together(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens gives these two: no merge takes a part of each.

        Each token merges as it does alone, the lower rank first and the left one of equals, until the last part of
        the left one and the first of the right one are next.
        """
        if len(self.pairs) >= MEMO:
            self.pairs.clear()
        ids, none = self.ids, self.none
        one, two = self.trace(left), self.trace(right)
        found = one is not None and two is not None
        if found:
            (ours, _, last), (theirs, first, _) = one, two
            i = j = 0
            while True:
                a, b, across = ours[i], theirs[j], ids.get(last[i] + first[j], none)
                if across < a and across <= b and across < none:
                    found = False
                    break
                if a == b == none:
                    break
                if a <= b:
                    i += 1
                else:
                    j += 1
        self.pairs[left, right] = found
        return found

    def prefix(self, token: int) -> int:
        """The id of the longest token that begins this one and is shorter, or -1."""
        found = self.prefixes[token]
        if found == -2:
            text, found = self.token[token], -1
            for n in range(len(text) - 1, 0, -1):
                if text[:n] in self.ids:
                    found = self.ids[text[:n]]
                    break
            self.prefixes[token] = found
        return found

    def encode_piece(self, text: str) -> list[int]:
        """The ids of one match of the pattern, given as Latin-1 characters."""
        ids, pairs, widths, path = self.ids, self.pairs, self.widths, self.trie.longest_prefix
        whole = ids.get(text)
        if whole is not None:
            return [whole]
        left = bytearray(len(text) + 1)
        out: list[int] = []
        at, now, last = 0, None, None
        # one pass for the longest tokens, as far as neighbours go together
        for _, token in self.trie.iter_long(text):
            if last is not None:
                fits = pairs.get((last, token))
                if fits is None:
                    fits = self.together(last, token)
                if not fits:
                    now = self.prefix(token)
                    break
            out.append(token)
            at += widths[token]
            last = token
        while at < len(text):
            if now is None:
                ahead = text[at : at + self.widest]
                n = path(ahead)
                while n and (now := ids.get(ahead[:n])) is None:
                    n -= 1
                if not n:
                    raise ValueError("the vocabulary lacks a byte")
            if now < 0:
                left[at] = 1
                last = out.pop()
                at -= widths[last]
                now = self.prefix(last)
                last = out[-1] if out else None
                continue
            to = at + widths[now]
            if not left[to]:
                fits = last is None or pairs.get((last, now))
                if fits is None:
                    fits = self.together(last, now)
                if fits:
                    out.append(now)
                    at, last, now = to, now, None
                    continue
            now = self.prefix(now)
        return out

    def encode(self, text: str) -> array:
        known, out = self.known.__getitem__, array("i")
        if len(text) > 1 << 20:
            for match in self.pattern.finditer(text):
                out.frombytes(known(match[0]))
        else:
            out.frombytes(b"".join(map(known, self.pattern.findall(text))))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spelling.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a file with a base-64 token and its rank in each line; one for each Python worker."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}
    return Codec(ranks, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """Adds the ids of each text; null counts as empty, and a column of the name ``to`` is replaced.

    ``path`` is a vocabulary file that every machine has. Row-local: no shuffle, whatever the rows are.
    """

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        own, flat, off = codec(path, pattern), array("i"), [0]
        for value in column:
            flat.extend(own.encode(value.as_py() or ""))
            off.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))

    return df.withColumn(to, ids(F.col(text).cast("string")))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for; null counts as no ids, an unknown id is an error."""

    @F.arrow_udf("binary")
    def spelt(column: pa.Array) -> pa.Array:
        own, column = codec(path, pattern), pc.fill_null(column, pa.scalar([], column.type))
        flat, off = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        return pa.array([own.decode(flat[a:b].tolist()) for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())

    return df.withColumn(to, spelt(F.col(ids)))


def digests(df: DataFrame) -> DataFrame:
    """What the ids and the decoded bytes are, as counts and digests instead of the values."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
