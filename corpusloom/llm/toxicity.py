"""Toxicity of documents whose words may be disguised.

A noisy channel turns letters into look-alikes (digits, symbols, Cyrillic letters), stretches them and puts
separators or blanks between them. A token that shows signs of it becomes a lattice of what its characters
may stand for, and Viterbi takes the likeliest path under a trigram model of characters, counted over all
documents. Then the restored words are scored: the features are whole words and their beginnings (3 to 8
letters), learned from the labels, and a document is as toxic as its most telling word, mapped
to a probability by a logistic curve fitted on labelled texts that chose no feature.

The features are learned on the first ``rows`` labelled texts in the order of a hash of their ids. Counting
and scoring take one pass each over all documents, row by row; only character counts are shuffled.

Null text is the empty text, which has the score of a text without a telling word. Labels other than 0 and
1, and labels without a text, don't count. Without labels of both kinds every score is the share of label
1, or 0.5 without any. Repeated rows have the same score; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import words as W
from corpusloom.llm.nbsvm import labelled_ids

LEAST, MOST = 3, 8
#: What a character may stand for, with the cost of it, in nats.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¥": "y", "%": "x", "(": "c", "<": "c",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "к": "k", "м": "m", "т": "t",
}
WILDCARD = "*#"
SEPARATORS = ".-_~·'`​‌‍­"
COST, WILD_COST, STRETCH_COST = 0.5, 1.0, 1.0
#: Of a separator that stands for a word break, and of a look-alike before or after a word that stands for nothing.
BREAK_COST, EDGE_COST = 2.0, 10.0
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøùúûüýßœ"
OTHER = 63

#: Entries of the memo of tokens; it is emptied when full, which changes no result.
MEMO = 100_000
#: Different tokens of several texts, or of a part of one, that are weighed together.
AT_ONCE = 1 << 17

_CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
_TABLE = np.zeros(0x3000, np.uint8)
for _point in range(0x3000):
    if chr(_point).isalpha():
        _TABLE[_point] = _CODE.get(chr(_point).lower(), OTHER)
_WORD = re.compile(r"[^\W\d_]+")
_LETTER_BY_LETTER = re.compile(r"(?<![^\W_])(?:[^\W_@$!]|[@$!])(?:[ .\-_*~]{1,2}(?:[^\W_]|[@$!])(?![^\W_])){3,}")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_DISGUISE = re.compile("[" + re.escape("".join(LOOKALIKES) + WILDCARD + SEPARATORS) + "]")
#: What only stands between words, so a token is parted there.
_BETWEEN = re.compile(r"[,;:/\\?\"\[\]{}=&…“”«»]+")
#: Symbols and punctuation before and after a word, and symbols that stand there more than once.
_EDGES = re.compile(r"^[\W_]+(?=\w)|(?:[.,;:!?\"'’”)\]}…]+|([#$%&*!?+|@])\1+)+$")

#: What may follow a plain word.
_AFTER = ".,;:"
#: Look-alikes that are no letters or digits, and other characters around a word.
_SYMBOLS = "".join(c for c in LOOKALIKES if not c.isalnum()) + WILDCARD
_PLAIN = SEPARATORS + "^)'’”…>"


def _signs(text: str) -> np.ndarray:
    """A number for each character: a letter's, or 0 for what is between words."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], OTHER)


def character_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigrams of characters over all texts, words apart: a table of 64 x 64 x 64, whatever the texts are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 18, np.int64)
        held, size = [], 0
        for batch in batches:
            for part in W.pieces(batch, "text"):
                for value in part["text"]:
                    whole = value.as_py() or ""
                    for at in range(0, len(whole), W.PIECE):
                        # the two characters before a piece are only context
                        signs = _signs((" " + whole)[max(0, at - 1) : at + W.PIECE + 1]).astype(np.int64)
                        signs = np.concatenate([[0], signs, [0]] if not at else [signs, [0]])
                        held.append((signs[:-2] << 12) | (signs[1:-1] << 6) | signs[2:])
                        size += len(held[-1])
                        if size >= W.PIECE:  # a count goes through the whole table
                            total += np.bincount(np.concatenate(held), minlength=1 << 18)
                            held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=1 << 18)
        kept = np.flatnonzero(total)
        yield pa.record_batch({"gram": pa.array(kept), "n": pa.array(total[kept])})

    rows = (
        docs.select(F.col(text).cast("string").alias("text"))
        .mapInArrow(count, "gram long, n long")
        .groupBy("gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    out = np.zeros(1 << 18)
    out[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log-probability of a character after two others, interpolated with shorter contexts."""
    three = counts.reshape(64, 64, 64)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + 64)
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    return np.log((three + 20 * p2[None]) / (three.sum(axis=2, keepdims=True) + 20)).astype(np.float32)


class Restorer:
    """Viterbi over the lattice of what a token's characters may stand for."""

    def __init__(self, model: np.ndarray):
        self.model = model

    def options(self, sign: str, times: int) -> list[tuple[str, float]]:
        if sign == " ":
            return [("", 0.0)]
        if sign in SEPARATORS:
            return [("", 0.0), (" ", BREAK_COST if times == 1 else 0.0)]
        if sign in WILDCARD:
            return [(c, WILD_COST) for c in LETTERS[:26]] + [("", WILD_COST)]
        letters = [(c, COST) for c in LOOKALIKES[sign]] if sign in LOOKALIKES else [(sign, 0.0)]
        out = []
        for letter, cost in letters:
            if times < 3:
                out.append((letter * times, cost * times))
            if times > 1:
                out.append((letter, cost + STRETCH_COST * (3 if times == 2 else 1)))
            if times > 2:
                out.append((letter * 2, cost + STRETCH_COST))
        return out

    def __call__(self, token: str, lead: int = 0, trail: int = 0) -> str:
        """The likeliest reading; look-alikes among the first and last so many characters may be nothing."""
        runs, at = [], 0
        while at < len(token):
            to = at
            while to < len(token) and token[to] == token[at]:
                to += 1
            runs.append((token[at], to - at, at < lead or to > len(token) - trail))
            at = to
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for sign, times, edge in runs:
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            options = self.options(sign, times)
            if edge:  # a doubled one is two letters, as the reading without it is there anyway
                options = [o for o in options if times != 2 or len(o[0]) == 2 or sign in WILDCARD] + [("", EDGE_COST)]
            for letters, cost in options:
                for (a, b), (score, path) in states.items():
                    for letter in letters:
                        code = _CODE.get(letter, OTHER if letter.isalpha() else 0)
                        score, a, b = score + float(self.model[a, b, code]), b, code
                    score -= cost
                    if (a, b) not in after or score > after[a, b][0]:
                        after[a, b] = (score, (path, letters))
            states = after
        _, path = max(((s + float(self.model[a, b, 0]), p) for (a, b), (s, p) in states.items()), key=lambda x: x[0])
        parts = []
        while path:
            path, letters = path
            parts.append(letters)
        return "".join(reversed(parts))

    def token(self, token: str) -> str:
        """A token between blanks, its parts restored if they show signs of disguise."""
        return " ".join(filter(None, map(self.part, _BETWEEN.split(token))))

    def readings(self, token: str) -> list[str]:
        """The token restored, and its parts with the look-alikes before and after them as letters."""
        out = [self.token(token)]
        for part in _BETWEEN.split(token):
            core = part.strip(_PLAIN)
            inner = core.strip(_SYMBOLS)
            if inner != core and any(c.isalpha() for c in inner):
                lead = core.index(inner)
                out.append(self(core, lead, len(core) - len(inner) - lead))
        return out

    def part(self, token: str) -> str:
        core = _EDGES.sub("", token)
        if core.isalpha():
            return self(core) if _STRETCHED.search(core) else core
        if not core or core.isdigit() or not any(c.isalpha() for c in core):
            return core
        if not (_DISGUISE.search(core) or _STRETCHED.search(core)):
            return core
        # words that are only joined, such as by a hyphen, stand for themselves
        parts = re.split("[" + re.escape(SEPARATORS) + "]", core)
        if len(parts) > 1 and all(len(p) > 2 and p.isalpha() and not _STRETCHED.search(p) for p in parts):
            return core
        return self(core)


def beginnings(word: str) -> list[str]:
    return [word[:n] for n in range(LEAST, min(MOST, len(word)) + 1)] + [word + "$"]


def spelt_words(letters: str, step: int = 10_000) -> Iterator[list[str]]:
    """Lists of the words that letters without word breaks may hold: all of them, and those from any letter on."""
    yield [letters]
    for at in range(0, len(letters), step):
        yield [letters[i : i + n] for i in range(at, min(at + step, len(letters))) for n in range(LEAST, MOST + 1) if i + n <= len(letters)]


class Reader(dict):
    """Tokens that show signs of disguise to what ``weigh`` says of their restored words; kept for each that was seen.

    Plain words, the most of all, are not kept: ``weigh_each`` says of many of them what ``weigh`` says of each alone.
    """

    def __init__(
        self,
        restorer: Restorer,
        weigh: Callable[[list[str]], object],
        weigh_each: Callable[[list[str]], list] | None = None,
    ):
        super().__init__()
        self.restorer, self.weigh = restorer, weigh
        self.weigh_each = weigh_each or (lambda words: [weigh([word]) for word in words])

    def __missing__(self, token: str):
        if len(self) >= MEMO:
            self.clear()
        found = self[token] = self.weigh(_WORD.findall(" ".join(self.restorer.readings(token))))
        return found

    def tokens(self, tokens: Iterable[str]) -> dict[str, object]:
        """What each token weighs; the only reading of letters without a sign of disguise is the word itself."""
        bare = {token: token.rstrip(_AFTER) for token in tokens}
        plain = {token: b for token, b in bare.items() if b.isalpha() and not _STRETCHED.search(b)}
        found = dict(zip(plain, self.weigh_each(list(plain.values())), strict=True))
        found.update((token, self[token]) for token in bare.keys() - plain.keys())
        return found

    def of(self, text: str) -> list:
        return next(self.of_each([text]))

    def of_each(self, texts: list[str]) -> Iterator[list]:
        """What the tokens of each text weigh, and what is spelt letter by letter there."""
        lows = [text.lower() for text in texts]
        tokens = [set(low.split()) for low in lows]
        every = set().union(*tokens)
        if len(every) > AT_ONCE and len(texts) > 1:
            half = len(texts) // 2
            yield from self.of_each(texts[:half])
            yield from self.of_each(texts[half:])
            return
        found = self.tokens(every) if len(texts) > 1 else None
        for low, own in zip(lows, tokens, strict=True):
            if found is None:  # a text alone may have any number of tokens
                out = [x for some in batched(own, AT_ONCE) for x in self.tokens(some).values()]
            else:
                out = list(map(found.__getitem__, own))
            for spelt in _LETTER_BY_LETTER.finditer(low):
                out += [self.weigh(words) for words in spelt_words(self.restorer("".join(" " if c in ".-_~" else c for c in spelt[0])))]
            yield out


@dataclass(frozen=True)
class Model:
    characters: np.ndarray
    weights: dict[int, float] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    @cached_property
    def reader(self) -> Reader:
        """One for all batches that a Python worker gets with the same model."""
        weights = self.weights
        number = np.array(sorted(weights), np.int64)
        weight = np.array([weights[n] for n in number.tolist()], np.float64)

        def most(words: list[str]) -> float:
            return max((weights.get(_number(f), 0.0) for w in words for f in beginnings(w)), default=0.0)

        def most_each(words: list[str]) -> list[float]:
            out = np.full(len(words), -np.inf)
            for which, numbers in _numbers(words):
                if len(number):
                    at = np.minimum(np.searchsorted(number, numbers), len(number) - 1)
                    out[which] = np.maximum(out[which], np.where(number[at] == numbers, weight[at], 0.0))
                else:
                    out[which] = np.maximum(out[which], 0.0)
            return out.tolist()

        return Reader(Restorer(self.characters), most, most_each)

    def score(self, most: float) -> float:
        return 1 / (1 + np.exp(-np.clip(self.slope * most + self.shift, -35, 35)))


def _number(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) - (1 << 31)


#: What a byte does to a CRC-32, from the library's own.
_CRC = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], np.uint32)


def _numbers(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The numbers of the words' beginnings, many at once: which words, and a feature's number of each.

    A feature's number goes on from that of the next shorter one, so each byte is taken once.
    """
    data = np.frombuffer("\0".join([*words, ""]).encode("utf-8", "replace"), np.uint8)
    ends = np.flatnonzero(data == 0)
    at = np.concatenate(([0], ends[:-1] + 1))
    which, state, letters = np.arange(len(words)), np.full(len(words), 0xFFFFFFFF, np.uint32), np.zeros(len(words), np.int32)

    def after(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
        return _CRC[(state ^ byte) & 0xFF] ^ (state >> 8)

    def number(state: np.ndarray) -> np.ndarray:
        return (state ^ np.uint32(0xFFFFFFFF)).astype(np.int64) - (1 << 31)

    while len(which):
        byte = data[at].astype(np.uint32)
        begins = (byte & 0xC0) != 0x80  # a character does, or the word has ended
        some = begins & (letters >= LEAST) & (letters <= MOST)
        if some.any():
            yield which[some], number(state[some])
        ended = at == ends
        if ended.any():
            yield which[ended], number(after(state[ended], np.uint32(ord("$"))))
            going = ~ended
            which, at, ends, state, letters, byte, begins = (x[going] for x in (which, at, ends, state, letters, byte, begins))
        state, letters, at = after(state, byte), letters + begins, at + 1


def _batch(texts: pa.Array) -> Iterator[pa.RecordBatch]:
    return W.pieces(pa.record_batch({"text": texts}), "text")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 8000, key="doc_id", text="text") -> Model:
    """Character model of all documents, and the telling words of a bounded sample of labelled ones."""
    characters = language_model(character_counts(docs, text))
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(characters)

    @F.arrow_udf("array<int>")
    def found(column: pa.Array) -> pa.Array:
        reader = Reader(Restorer(shared.value), lambda words: tuple({_number(f) for w in words for f in beginnings(w)}))
        read = (x for part in _batch(column) for x in reader.of_each([v or "" for v in part["text"].to_pylist()]))
        out = [sorted(set().union(*x)) for x in read]
        return pa.array(out, pa.list_(pa.int32()))

    chosen = labelled_ids(labels, label, rows, key)
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").select("id", "label", found("text").alias("features"))
    got = sample.toArrow().sort_by([("id", "ascending")])
    y = got["label"].to_numpy() == 1
    if not len(y) or y.all() or not y.any():
        return Model(characters, constant=float(y.mean()) if len(y) else 0.5)
    features = [np.asarray(f.values) for f in got["features"]]
    held = np.arange(len(y)) % 4 == 3
    if len(y) < 40 or not y[held].any() or not y[~held].any():
        held = np.zeros(len(y), bool)
    weights = _telling([f for f, h in zip(features, held, strict=True) if not h], y[~held])
    most = np.array([max((weights.get(int(n), 0.0) for n in f), default=0.0) for f in features])
    use = held if held.any() else ~held
    slope, shift = _curve(most[use], y[use])
    return Model(characters, weights, slope, shift)


def _telling(features: list[np.ndarray], y: np.ndarray, least: int = 3, evidence: float = 12.0) -> dict[int, float]:
    """Log-odds of the features that are surely commoner in label 1: by a likelihood ratio test."""
    flat = np.concatenate(features) if features else np.zeros(0, np.int32)
    value, place = np.unique(flat, return_inverse=True)
    positive = np.repeat(y, [len(f) for f in features])
    n1 = np.bincount(place, positive, len(value))
    n0 = np.bincount(place, ~positive, len(value))
    share = y.mean()
    n = n1 + n0
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (n1 * np.log(n1 / (n * share)) + np.where(n0 > 0, n0 * np.log(n0 / (n * (1 - share))), 0))
    keep = (n1 >= least) & (n1 > n * share) & (ratio > evidence)
    odds = np.log((n1 + 0.5) / (y.sum() + 1) * ((~y).sum() + 1) / (n0 + 0.5))
    return dict(zip(value[keep].tolist(), odds[keep].tolist(), strict=True))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton steps, with one made-up text of either kind at either end."""
    top = max(float(x.max()), 1.0)
    x = np.concatenate([x, [0.0, top]])
    y = np.concatenate([y, [False, True]]).astype(float)
    a, b = 1.0, -top / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        w = np.maximum(p * (1 - p), 1e-6)
        gradient = np.array([((p - y) * x).sum() + 0.01 * a, (p - y).sum()])
        hessian = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(hessian + 1e-6 * np.eye(2), gradient)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    return float(max(a, 1e-3)), float(b)


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """Adds the score of each whole text; a column of the name ``to`` is replaced."""
    if model.constant is not None:
        return docs.withColumn(to, F.lit(model.constant))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(column: pa.Array) -> pa.Array:
        own = shared.value
        reader = own.reader
        read = (x for part in _batch(column) for x in reader.of_each([v or "" for v in part["text"].to_pylist()]))
        most = [max(x, default=0.0) for x in read]
        return pa.array(own.score(np.array(most, np.float64)), pa.float64())

    return docs.withColumn(to, scores(F.col(text).cast("string")))
