"""The prefix trie: brute force on random and long conversations, small bands and cells, awkward rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from corpusloom.llm import trie

ROWS = "conv_id long, turn long, role string, text string, node string, d int, depth int"


def digest(turn):
    role, text = turn
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [t for *_, t in sorted(x, key=lambda r: (r[0], r[1], digest(r[2])))] for c, x in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in sorted(made.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, inside in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(inside) - 1) * len(node[-1][1]) if node else 0
    return {
        (inside[0], len(node), members[node[:-1]][0] if node else None, len(inside), len(children[node]), leaves[node],
         saved[node], hashlib.sha256(",".join(str(c) for c in inside if made[c] == node).encode()).hexdigest())
        for node, inside in members.items()
    }


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], ROWS)
    found = [tuple(r) for r in trie.trie(df).collect()]
    assert len(found) == len(set(found))
    return set(found)


def random_rows(seed, convs, longest, words=2):
    r = random.Random(seed)
    return [
        (c, t, r.choice("ua"), "é" * r.randrange(words))
        for c in convs for t in range(r.choice([1, 2, 3, 7, longest]))
    ]


@pytest.mark.parametrize("band,cells", [(16, (10, 16)), (2, (2, 2)), (3, (1, 1))])
def test_equals_brute_force(spark, monkeypatch, band, cells):
    """Depths of several bands of bands, cells of few turns: the sums and prefixes don't depend on either."""
    monkeypatch.setattr(trie, "BAND", band)
    monkeypatch.setattr(trie, "CELLS", cells)
    rows = random_rows(1, [*range(30), 100, 105, 233, 250, 1_000_000_007], 40)
    # a path that many share, and that branches late
    rows += [(c, t, "u", "same" if t < 33 else str(c)) for c in range(300, 312) for t in range(36)]
    random.Random(2).shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_equals_brute_force_on_the_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(spark, rows) == brute(rows)


def test_ends_of_more_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_BITS", 2)
    rows = [(c, t, "u", "hi") for c in range(-60, 60) for t in range(6)]
    assert got(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    rows = [
        (None, 1, "u", "x"), (1, None, "u", None), (1, None, None, "x"), (1, 0, "u", ""), (1, 0, "u", ""), (1, -5, "u", "z"),
        (2, 3, "", "long" * 50_000), (2, 3, "", "long" * 50_000), (200, None, None, None), (201, None, None, None),
        (-7, 1, "u", "x"), (-150, 1, "u", "x"), (7, 2**62, "u", "x"), (7, -(2**63), "u", "y"), (7, None, "u", "n"),
    ]
    rows += [(7, k, "u", "t") for k in range(8)]
    assert got(spark, rows) == brute(rows)


def test_role_and_text_are_kept_apart(spark):
    rows = [(c, t, *(("ab", "c") if c else ("a", "bc"))) for c in (0, 1000) for t in range(7)]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == set()
