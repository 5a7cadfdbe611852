"""Merges applied to many words at once: a batch's symbols are one flat array, and a turn does one merge in every word.

A word's next merge is that of its lowest rank, and words don't depend on each other, so in each turn every word that
still has a merge does its own. A batch takes as many turns as its slowest word, each over the words not done yet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Up to so many symbols, a pair's rank is looked up in a table of all pairs.
DENSE_SYMBOLS = 1024
#: Words of more symbols are left to the caller, as their turns would cost the square of their length.
LONGEST = 256
NO_RANK = np.int32(2**31 - 1)


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and where each list begins, from 0, with the end of the last."""
    column = column.cast(pa.large_list(pa.int32()))
    off = column.offsets.to_numpy()
    return column.values.to_numpy()[off[0] : off[-1]], off - off[0]


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32, copy=False)))


def neighbours(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places that have a next symbol in the same word."""
    inside = np.ones(len(values), bool)
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    inside[ends] = False
    return np.flatnonzero(inside)


class Ranks:
    """Merges ``{(left, right): (rank, merged)}`` for lookups of whole arrays."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]], in_order: bool):
        #: In order, a merge is done once, and what comes up again later stays; otherwise the lowest rank is next.
        self.in_order = in_order
        left, right, rank, new = (np.array(x, np.int64) for x in zip(*((*p, *m) for p, m in merges.items()), strict=True)) if merges else [np.zeros(0, np.int64)] * 4
        self.new = np.zeros(rank.max(initial=-1) + 1, np.int32)
        self.new[rank] = new
        # a merge that makes a symbol which an earlier rank takes up is done one place at a time
        takes: dict[int, int] = {}
        for pair, (r, _) in merges.items():
            for symbol in pair:
                takes[symbol] = min(r, takes.get(symbol, r))
        self.single = np.zeros(len(self.new), bool)
        for r, made in merges.values():
            self.single[r] = not in_order and takes.get(made, r + 1) <= r
        self.size = int(max(left.max(initial=0), right.max(initial=0))) + 1
        if self.size <= DENSE_SYMBOLS:
            self.table = np.full((self.size + 1) ** 2, NO_RANK, np.int32)
            self.table[left * (self.size + 1) + right] = rank
        else:
            self.keys = left << 32 | right
            order = np.argsort(self.keys)
            self.table, self.keys = rank[order].astype(np.int32), self.keys[order]

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if self.size <= DENSE_SYMBOLS:
            left, right = np.minimum(left, self.size), np.minimum(right, self.size)
            return self.table[left.astype(np.int64) * (self.size + 1) + right]
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.table[at], NO_RANK)


def merge(values: np.ndarray, offsets: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words after their merges, where each begins, and how many merges were found in each."""
    n = len(offsets) - 1
    word = np.repeat(np.arange(n), np.diff(offsets))
    merges = np.zeros(n, np.int64)
    done = np.full(n, -1, np.int32)
    ended_word, ended = [], []
    if not len(ranks.new):
        return values, offsets, merges
    while len(values):
        rank = np.full(len(values), NO_RANK, np.int32)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = ranks.of(values[inside], values[inside + 1])
        if ranks.in_order:
            rank[rank <= done[word]] = NO_RANK
        begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        best = np.minimum.reduceat(rank, begins)
        sizes = np.diff(np.append(begins, len(values)))
        open_ = best < NO_RANK
        going = np.repeat(open_, sizes)
        ended_word.append(word[~going])
        ended.append(values[~going])
        values, word, rank = values[going], word[going], rank[going]
        if not len(values):
            break
        best, sizes = best[open_], sizes[open_]
        done[word[np.cumsum(sizes) - 1]] = best
        hits = np.flatnonzero(rank == np.repeat(best, sizes))
        # in a run of equal symbols every other place is a merge, from the left
        run = np.flatnonzero(np.concatenate(([True], np.diff(hits) != 1)))
        if len(run) < len(hits):
            hits = hits[(np.arange(len(hits)) - np.repeat(run, np.diff(np.append(run, len(hits))))) % 2 == 0]
        which = rank[hits]
        if ranks.single[which].any():
            first = np.concatenate(([True], word[hits][1:] != word[hits][:-1]))
            hits = hits[first | ~ranks.single[which]]
            which = rank[hits]
        merges += np.bincount(word[hits], minlength=n)
        values[hits] = ranks.new[which]
        stays = np.ones(len(values), bool)
        stays[hits + 1] = False
        values, word = values[stays], word[stays]
    word, values = np.concatenate([*ended_word, word]), np.concatenate([*ended, values])
    values = values[np.argsort(word, kind="stable")]
    return values, np.concatenate(([0], np.cumsum(np.bincount(word, minlength=n)))), merges
