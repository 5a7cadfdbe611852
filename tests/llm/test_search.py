"""Ranked search: brute force over whole tables and over random lists, early stopping, awkward rows."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_all, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in sorted(set(items), key=str):
        asked.setdefault(i, Counter()).update(terms(t))
    rows = []
    for item, wanted in asked.items():
        scores = []
        for doc, c in held:
            m = 25 + (75 * c.total() * n_all) // total
            score = sum(
                r * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t, r in wanted.items() if c[t]
            )
            scores.append((-score, math.inf if doc is None else doc))
        best = [x for x in sorted(scores) if x[0] < 0][:k]
        rows += [(item, j + 1, None if d == math.inf else d, -s) for j, (s, d) in enumerate(best)]
    return rows


def ranked(spark, docs, items, k=10):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return [tuple(r) for r in search.rank(a, b, k).collect()]


def by_rank(rows):
    return sorted(rows, key=lambda r: (str(r[0]), r[1]))


def test_equals_brute_force_on_the_tables(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert by_rank(ranked(spark, docs, items)) == by_rank(brute(docs, items))


@pytest.mark.parametrize("k", [1, 3])
def test_ties_blocks_and_groups(spark, monkeypatch, k):
    """Many equal scores, small blocks, several groups of items: the smallest ids win."""
    monkeypatch.setattr(search, "GROUP_BYTES", 8)
    docs = [(500 - i, ["alpha beta", "beta gamma gamma", "delta", "ALPHA beta"][i % 4]) for i in range(400)]
    items = [(1, "alpha beta"), (2, "gamma gamma delta"), (3, "nowhere"), (4, "beta"), (5, "Alpha")]
    assert by_rank(ranked(spark, docs, items, k)) == by_rank(brute(docs, items, k))


def test_awkward_rows(spark):
    docs = [(1, None), (2, ""), (3, "..."), (None, "wörter über alles"), (4, "Wörter ÜBER"), (4, "Wörter ÜBER"),
            (5, "x" * 100_000 + " über"), (6, "über " * 50_000), (7, "中文 wörter"), (-8, "a_b1 2c")]
    items = [(1, "wörter über"), (1, "wörter über"), (1, "中文"), (None, "über"), (2, None), (3, ""), (4, "A B1 2C")]
    assert by_rank(ranked(spark, docs, items)) == by_rank(brute(docs, items))


def test_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")]) == []
    assert ranked(spark, [(1, "a")], []) == []
    assert ranked(spark, [(1, "?")], [(1, "a")]) == []


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 7, 8)], "doc_id long, text string, item_id int, score int")
    items = spark.createDataFrame([(2, "a", 7, 8)], "item_id long, text string, doc_id int, rank int")
    got = search.rank(docs, items).collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in got] == [(2, 1, 1)]


impacts = st.lists(st.lists(st.integers(0, 5), min_size=12, max_size=12), min_size=1, max_size=4)


def block(table):
    table = np.array(table, np.int64)
    term, doc = np.nonzero(table >= 0)
    return search.Block(doc, term, table[term, doc], table.shape[1], len(table)), table


@settings(max_examples=300, deadline=None)
@given(impacts, st.lists(st.integers(1, 3), min_size=4, max_size=4), st.integers(1, 6), st.integers(0, 20))
def test_lists_by_brute_force(table, repeats, k, floor):
    table = [[x - 1 for x in row] for row in table]  # -1: the document doesn't hold the term
    made, table = block(table)
    repeats = np.array(repeats[: len(table)])
    docs, scores, _ = made.best(np.arange(len(table)), repeats, k, floor)
    whole = (np.maximum(table, 0) * repeats[:, None]).sum(0)
    want = sorted((-s, d) for d, s in enumerate(whole.tolist()) if s > 0)[:k]
    got = sorted(zip((-scores).tolist(), docs.tolist()))[:k]
    # what is below the floor may be missing; all else is there, with the whole score
    assert [x for x in got if -x[0] >= floor] == [x for x in want if -x[0] >= floor]
    assert all(whole[d] == s for d, s in zip(docs, scores))


def test_stops_before_the_lists_end(monkeypatch):
    """A document on top of both lists ends reading at once, and by the best positions, not by the last ones read."""
    n = 1000
    table = np.full((2, n), 1)
    table[:, 7] = 1000
    made, _ = block(table)
    *_, read = made.best(np.arange(2), np.ones(2, np.int64), 1, 0)
    assert read <= 4 * search.FIRST_READ
    monkeypatch.setattr(search, "FIRST_READ", 1)
    # the second list's top is met in the first list, so its best position runs ahead of what was read of it
    table = np.array([[90, 80, 70, 5, 5, 5], [80, 70, 60, 5, 5, 5]])
    made, _ = block(table)
    docs, scores, read = made.best(np.arange(2), np.ones(2, np.int64), 1, 0)
    assert docs.tolist()[scores.argmax()] == 0 and read == 2
    # an unmet document could tie: reading goes on while the bound equals the k-th score
    made, _ = block([[5, 5, 5, 5]])
    docs, *_ = made.best(np.arange(1), np.ones(1, np.int64), 1, 0)
    assert 0 in docs.tolist()
