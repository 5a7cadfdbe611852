"""Byte-pair-encoding vocabularies, learned from distributed word counts.

The corpus-sized work (word counts, pair counts, segment counts, rewriting the words) runs as Spark
jobs. Pair counts are made once; afterwards a round adds the differences that its merges make, which
come from the words it changed only. A round learns many merges at once, exactly:

* Take the most frequent pairs, and cut each word where another pair stands. A merge never raises the
  count of a pair that already existed, and a pair built across a cut comes after the pair at the cut
  in the order of choice (it is no more frequent, and its ids are larger). So until the best pair falls
  behind the best one left out, the cuts cannot matter.
* What lies between the cuts repeats heavily. The most frequent segments, a bounded table, are merged
  on the driver as an example. What they don't cover is known by its sum per pair only: a merge there
  may take something from each neighbouring pair and give it to a new one, so these counts become
  ranges. The round goes on for as long as the best pair is an exact count. The first one always is,
  so a round learns one merge at least, and several whatever the number of distinct segments is.

Symbols are ids throughout: specials first, then the alphabet by code point, then merged strings.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import SPECIAL_TOKENS, TokenizerSettings
from corpusloom.operators.merging import LONGEST, NO_RANK, Ranks, flat_lists, lists, merge, neighbours
from corpusloom.operators.vocab import VOCAB_SCHEMA, word_counts
from corpusloom.session import cut_lineage, remove, written

MERGE_SCHEMA = "rank int, left_id int, right_id int, merged_id int"

# What a round brings to the driver: the most frequent segments of limited length, and pairs. What
# is beyond stays in its sums, so neither bound changes a merge.
MAX_SEGMENTS = 50_000
MAX_SEGMENT_SYMBOLS = 80
FIRST_PAIRS = 64
MAX_PAIRS = 8_192


@dataclass(frozen=True)
class Merges:
    """What training yields: token strings by id, and merges (left, right, merged) by rank."""

    tokens: list[str]
    alphabet_end: int
    merges: list[tuple[int, int, int]]

    def vocab(self, spark: SparkSession) -> DataFrame:
        def kind(i: int) -> str:
            if i < len(SPECIAL_TOKENS):
                return "special"
            return "char" if i < self.alphabet_end else "merge"

        rows = [(i, token, kind(i)) for i, token in enumerate(self.tokens)]
        return spark.createDataFrame(rows, VOCAB_SCHEMA)

    def merge_table(self, spark: SparkSession) -> DataFrame:
        rows = [(rank, *merge) for rank, merge in enumerate(self.merges)]
        return spark.createDataFrame(rows, MERGE_SCHEMA)


#: Words that a task takes at once: what they have in common is summed up there.
WORDS_AT_ONCE = 1 << 17


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of several batches together."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= WORDS_AT_ONCE:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    return table[name].combine_chunks() if table[name].num_chunks != 1 else table[name].chunk(0)


def spell(words: DataFrame, char_ids: dict[str, int]) -> DataFrame:
    """``syms, n``: each distinct word as its characters' ids."""

    @F.arrow_udf("array<int>")
    def to_ids(batch):
        points = np.frombuffer("".join(batch.to_pylist()).encode("utf-32-le"), np.uint32)
        distinct, place = np.unique(points, return_inverse=True)
        ids = np.array([char_ids[chr(c)] for c in distinct], np.int32)
        return lists(ids[place], np.concatenate(([0], np.cumsum(pc.utf8_length(batch).to_numpy()))))

    return words.select(to_ids("word").alias("syms"), "n")


def _pair_sums(syms: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs, as one number each, and the sums of their words' counts."""
    values, offsets = flat_lists(syms)
    at = neighbours(values, offsets)
    pairs = values[at].astype(np.int64) << 32 | values[at + 1]
    pairs, place = np.unique(pairs, return_inverse=True)
    sums = np.zeros(len(pairs), np.int64)
    np.add.at(sums, place, np.repeat(n, np.diff(offsets))[at])
    return pairs, sums


def _pair_rows(pairs: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    left, right = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
    return pa.record_batch({"left_id": left, "right_id": right, "n": sums})


PAIRS = "left_id int, right_id int, n long"


def pair_counts(words: DataFrame) -> DataFrame:
    """``left_id, right_id, n`` over all adjacent symbols, weighted by word count."""

    def count(batches):
        for table in _bundles(batches):
            yield _pair_rows(*_pair_sums(_column(table, "syms"), table["n"].to_numpy()))

    return words.select("syms", "n").mapInArrow(count, PAIRS).groupBy("left_id", "right_id").agg(F.sum("n").alias("n"))


def segment_counts(words: DataFrame, active: set[tuple[int, int]]) -> DataFrame:
    """``seg, n``: distinct stretches of at least two symbols joined by active pairs only."""
    wanted = Ranks({pair: (i, 0) for i, pair in enumerate(active)}, in_order=True)

    def stretches(batches):
        for table in _bundles(batches):
            values, offsets = flat_lists(_column(table, "syms"))
            at = neighbours(values, offsets)
            apart = np.ones(len(values) + 1, bool)
            apart[at[wanted.of(values[at], values[at + 1]) != NO_RANK] + 1] = False
            begins = np.flatnonzero(apart)  # and the end
            sizes = np.diff(begins)
            kept = sizes > 1
            n = np.repeat(table["n"].to_numpy(), np.diff(offsets))[begins[:-1][kept]]
            ends = np.concatenate(([0], np.cumsum(sizes[kept]))) * 4
            data = np.ascontiguousarray(values[np.repeat(kept, sizes)], np.int32)
            seg = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]
            )
            summed = pa.table({"seg": seg, "n": n}).group_by("seg").aggregate([("n", "sum")])
            spelled = _column(summed, "seg")
            ends = np.concatenate(([0], np.cumsum(pc.binary_length(spelled).to_numpy()))) // 4
            symbols = np.frombuffer(b"".join(spelled.to_pylist()), np.int32)
            yield pa.record_batch({"seg": lists(symbols, ends), "n": _column(summed, "n_sum")})

    counted = words.select("syms", "n").mapInArrow(stretches, "seg array<int>, n long")
    return counted.groupBy("seg").agg(F.sum("n").alias("n"))


def merged(syms: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int] | None:
    """A word after a round's merges, one after the other, each leftmost first; None if none applies.

    ``ranks`` has the place of a pair among the merges, and what it becomes.
    """
    done, changed = -1, False
    while True:
        following = [r for pair in zip(syms, syms[1:]) if (r := ranks.get(pair)) and r[0] > done]
        if not following:
            return syms if changed else None
        (done, new), changed = min(following), True
        out, i = [], 0
        while i < len(syms):
            r = ranks.get((syms[i], syms[i + 1])) if i + 1 < len(syms) else None
            if r and r[0] == done:
                out.append(new)
                i += 2
            else:
                out.append(syms[i])
                i += 1
        syms = out


def rewrite(words: DataFrame, merges: list[tuple[tuple[int, int], int]]) -> DataFrame:
    """``syms, n, before``: the words after ``merges``; ``before`` is null where nothing changed."""
    places = {pair: (i, new) for i, (pair, new) in enumerate(merges)}
    ranks = Ranks(places, in_order=True)

    def after(batches):
        for table in _bundles(batches):
            before = _column(table, "syms")
            values, offsets = flat_lists(before)
            sizes = np.diff(offsets)
            long = np.flatnonzero(sizes > LONGEST)
            short = np.where(sizes > LONGEST, 0, sizes)
            picked = values[np.repeat(sizes <= LONGEST, sizes)]
            made, begins, count = merge(picked, np.concatenate(([0], np.cumsum(short))), ranks)
            syms, changed = lists(made, begins), count > 0
            if len(long):
                alone = [merged(values[offsets[i] : offsets[i + 1]].tolist(), places) for i in long]
                changed[long] = [x is not None for x in alone]
                alone = [values[offsets[i] : offsets[i + 1]] if x is None else x for i, x in zip(long, alone, strict=True)]
                place = np.arange(len(syms))
                place[long] = len(syms) + np.arange(len(long))
                syms = pa.concat_arrays([syms, pa.array(alone, pa.list_(pa.int32()))]).take(pa.array(place))
            before = pc.if_else(pa.array(changed), before, pa.scalar(None, before.type))
            yield pa.record_batch({"syms": syms, "n": _column(table, "n"), "before": before})

    return words.select("syms", "n").mapInArrow(after, "syms array<int>, n long, before array<int>")


def pair_changes(rewritten: DataFrame) -> DataFrame:
    """``left_id, right_id, n``: by how much the words a round changed alter the pair counts; several rows a pair."""

    def count(batches):
        for table in _bundles(batches):
            n = table["n"].to_numpy()
            (pairs, sums), (gone, less) = _pair_sums(_column(table, "syms"), n), _pair_sums(_column(table, "before"), -n)
            yield _pair_rows(np.concatenate([pairs, gone]), np.concatenate([sums, less]))

    return rewritten.filter(F.col("before").isNotNull()).mapInArrow(count, PAIRS)


class _Round:
    """The merges of one round, from its frequent segments and the sums of what they don't cover.

    ``counts`` are exact counts of all active pairs. A pair's count here is the largest it can be;
    ``rest`` is the part of it from outside the segments, ``sure`` what of that part is certain.
    """

    def __init__(self, segments: list[tuple[tuple[int, ...], int]], counts: dict[tuple[int, int], int]):
        self.now = [list(seg) for seg, _ in segments]
        self.weight = [n for _, n in segments]
        self.count: Counter = Counter()
        self.where = defaultdict(set)
        for i, seg in enumerate(self.now):
            self._add(i, seg, self.weight[i])
        self.rest = {p: n - self.count[p] for p, n in counts.items() if n > self.count[p]}
        self.sure = dict(self.rest)
        self.by_left, self.by_right = defaultdict(set), defaultdict(set)
        for p in self.rest:
            self.by_left[p[0]].add(p)
            self.by_right[p[1]].add(p)
        self.count.update(self.rest)
        self.heap = [(-n, pair) for pair, n in self.count.items()]
        heapq.heapify(self.heap)

    def _add(self, i, seg, n):
        for pair in zip(seg, seg[1:]):
            self.count[pair] += n
            self.where[pair].add(i)

    def best(self):
        """Most frequent pair, ties by ids, and whether that is certain; outdated entries are passed over."""
        while self.heap:
            negative, pair = self.heap[0]
            if self.count[pair] == -negative:
                rest = self.rest.get(pair, 0)
                # how often a pair of equals overlaps itself isn't known from its sum
                return pair, -negative, rest == self.sure.get(pair, 0) and (pair[0] != pair[1] or not rest)
            heapq.heappop(self.heap)
        return None, 0, True

    def merge(self, pair, new) -> int:
        """Apply one merge. Returns how often ``pair`` itself was consumed by an overlap."""
        overlaps, touched = 0, set()
        for i in self.where.pop(pair, ()):
            old, fresh, j = self.now[i], [], 0
            while j < len(old):
                if j + 1 < len(old) and (old[j], old[j + 1]) == pair:
                    fresh.append(new)
                    j += 2
                    if j < len(old) and (old[j - 1], old[j]) == pair:
                        overlaps += self.weight[i]
                else:
                    fresh.append(old[j])
                    j += 1
            for gone in zip(old, old[1:]):
                self.count[gone] -= self.weight[i]
                touched.add(gone)
            self._add(i, fresh, self.weight[i])
            touched.update(zip(fresh, fresh[1:]))
            self.now[i] = fresh
        if pair in self.rest:
            touched |= self._merge_rest(pair, new)
        for p in touched:
            if self.count[p] > 0:
                heapq.heappush(self.heap, (-self.count[p], p))
        return overlaps

    def _merge_rest(self, pair, new) -> set:
        """Outside the segments any occurrence may have taken from its neighbours, and so made new pairs."""
        left, right = pair
        size = self.rest.pop(pair)
        self.sure.pop(pair, None)
        self.count[pair] -= size
        self.by_left[left].discard(pair)
        self.by_right[right].discard(pair)
        made: Counter = Counter()
        if (right, left) in self.rest:
            made[new, new] = self.rest[right, left]
        for p in self.by_right[left]:
            made[p[0], new] = self.rest[p]
        for p in self.by_left[right]:
            made[new, p[1]] = self.rest[p]
        for p in self.by_right[left] | self.by_left[right]:
            self.sure[p] = max(0, self.sure[p] - size)
        for p, most in made.items():
            self.rest[p], self.sure[p] = min(size, most), 0
            self.count[p] += self.rest[p]
            self.by_left[p[0]].add(p)
            self.by_right[p[1]].add(p)
        return set(made)


class _Learner:
    def __init__(self, words: DataFrame, alphabet: list[str], settings: TokenizerSettings):
        self.words = words
        self.tokens = list(SPECIAL_TOKENS)
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        for char in alphabet:
            self._id_of(char)
        self.alphabet_end = len(self.tokens)
        self.vocab_size = settings.vocab_size
        self.least = max(settings.min_frequency, 1)
        self.merges: list[tuple[int, int, int]] = []
        # Count a merged pair is credited with, should a later merge bring the pair back. That can
        # happen only after a merge whose string already had an id.
        self.credit: dict[tuple[int, int], int] = {}
        self.reused = False
        self.paths: list[str] = []
        self.rounds = 0

    def _id_of(self, token: str) -> int:
        if token not in self.ids:
            self.ids[token] = len(self.tokens)
            self.tokens.append(token)
        return self.ids[token]

    def _learn(self, pair: tuple[int, int]) -> int:
        joined = self.tokens[pair[0]] + self.tokens[pair[1]]
        self.reused = joined in self.ids
        new = self._id_of(joined)
        self.merges.append((*pair, new))
        return new

    def _count(self) -> None:
        """Count all pairs, once."""
        self.pairs, path = written(pair_counts(self.words), "pairs")
        self.paths = [path]

    def _apply(self, merges) -> None:
        """Rewrite the words and bring the pair counts up to date; the tables before are not needed any more."""
        rewritten, words_path = written(
            rewrite(self.words, merges).filter((F.size("syms") > 1) | F.col("before").isNotNull()), "words"
        )
        counts = self.pairs.unionByName(pair_changes(rewritten)).groupBy("left_id", "right_id")
        self.pairs, pairs_path = written(counts.agg(F.sum("n").alias("n")).filter("n <> 0"), "pairs")
        self.words = rewritten.select("syms", "n").filter(F.size("syms") > 1)
        self.changed = rewritten.filter(F.col("before").isNotNull())
        self._remove()
        self.paths = [words_path, pairs_path]

    def _made(self, new: int) -> int:
        """How often the last round made the symbol ``new``."""
        here, before = (F.size(F.filter(c, lambda x: x == new)) for c in ("syms", "before"))
        return self.changed.agg(F.sum((here - before) * F.col("n"))).first()[0] or 0

    def _remove(self) -> None:
        for path in self.paths:
            remove(self.words.sparkSession, path)

    def _returned(self):
        """A merged pair that a reused string brought back, with its credited count."""
        done = self.words.sparkSession.createDataFrame(
            list(self.credit), "left_id int, right_id int"
        )
        rows = self.pairs.join(F.broadcast(done), ["left_id", "right_id"]).collect()
        return [(r.n + self.credit[r.left_id, r.right_id], (r.left_id, r.right_id)) for r in rows]

    def _segments(self, active) -> list:
        """The most frequent segments: a bounded number, of a bounded length."""
        table = segment_counts(self.words, active).filter(F.size("seg") <= MAX_SEGMENT_SYMBOLS)
        return [(tuple(r.seg), r.n) for r in table.orderBy(F.desc("n"), "seg").limit(MAX_SEGMENTS).collect()]

    def run(self) -> Merges:
        wanted = FIRST_PAIRS
        self._count()
        while len(self.tokens) < self.vocab_size:
            rows = self.pairs.orderBy(F.desc("n"), "left_id", "right_id").limit(wanted + 1).collect()
            top = [((r.left_id, r.right_id), r.n) for r in rows]
            returned = self._returned() if self.reused else []
            if returned:
                candidates = returned + [(n, pair) for pair, n in top[:1]]
                count, pair = min(candidates, key=lambda c: (-c[0], c[1]))
                self.credit[pair] = count
                self._apply([(pair, self._learn(pair))])
                continue
            if not top or top[0][1] < self.least:
                break
            active = dict(top[:wanted])
            left_out = (-top[wanted][1], top[wanted][0]) if len(top) > wanted else None
            learned, ended = self._round(active, left_out)
            # a round cut short by uncertain counts had too long segments
            wanted = min(wanted * 2, MAX_PAIRS) if ended else max(wanted // 2, FIRST_PAIRS)
            self.rounds += 1
            self._apply(learned)
            pair, new = learned[-1]
            if not ended and pair[0] == pair[1]:
                # each merge but those that overlap another makes one symbol
                self.credit[pair] = self._made(new)
        self._remove()
        return Merges(self.tokens, self.alphabet_end, self.merges)

    def _round(self, active: dict, left_out: tuple | None) -> tuple[list, bool]:
        """Merges of pairs and their ids, and whether the pairs were used up before certainty was."""
        step, learned = _Round(self._segments(set(active)), active), []
        while len(self.tokens) < self.vocab_size:
            pair, count, sure = step.best()
            if pair is None or count < self.least or left_out and (-count, pair) >= left_out:
                break
            if not sure and learned:
                return learned, False
            new = self._learn(pair)
            learned.append((pair, new))
            self.credit[pair] = count - step.merge(pair, new)
            # equals outside the segments end a round; so does an old symbol in new places, as it can
            # make old pairs more frequent
            if not sure:
                return learned, False
            if self.reused:
                break
        return learned, True


def train_bpe(df: DataFrame, settings: TokenizerSettings, text: str = "text") -> Merges:
    if settings.strategy != "subword-level":
        raise ValueError(f"not a subword-level strategy: {settings.strategy}")
    return bpe_of(word_counts(df, text, settings.pre_tokenizer, settings.normalize_whitespace), settings)


def bpe_of(counts: DataFrame, settings: TokenizerSettings) -> Merges:
    """The same from ``word, n``."""
    # rounds are CPU work per word, so the word table keeps all partitions however few its bytes
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = cut_lineage(counts.repartition(partitions))
    seen = counts.select(F.explode_outer(F.split("word", "")).alias("c")).distinct()
    # at most one row per code point
    alphabet = sorted(r.c for r in seen.filter(F.col("c") != "").collect())
    learner = _Learner(counts, alphabet, settings)
    learner.words = cut_lineage(spell(counts, {c: learner.ids[c] for c in alphabet}))
    return learner.run()
