"""Host-level rules: counts by brute force, shrinking, verdicts, awkward rows."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import hosts

ROWS = "doc_id long, source string, text string, host string, key int, rule string"


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {i + k for found in places.values() if len(found) > 1 for i in found for k in range(8)}
    lines = Counter(line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line))
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_lines": sum(lines.values()),
        "n_dup_lines": sum(lines.values()) - len(lines),
        "n_repeat_words": len(inside),
    }


def measured(texts):
    found = hosts.measure(pa.array(texts, pa.string()))
    return [{name: int(values[i]) for name, values in found.items()} for i in range(len(texts))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab é\n\t\r\x0b #|中", max_size=120)), min_size=1, max_size=6))
def test_counts_by_brute_force(texts):
    assert measured(texts) == [brute(t) for t in texts]


def test_counts_of_real_and_long_texts(texts):
    some = [*texts, "x" * 100_000, "one two three four five six seven eight\n" * 5000, "", None]
    assert measured(some) == [brute(t) for t in some]


def words(n, start=0):
    return " ".join(f"word{i}" for i in range(start, start + n))


def test_a_bad_host_takes_its_good_documents_along(spark):
    rows = [(i, "bad", "too short") for i in range(40)] + [(100 + i, "bad", words(30, i)) for i in range(10)]
    rows += [(200 + 50 * h + i, f"good{h}", words(30, i)) for h in range(6) for i in range(50)]
    # a host of one document, which fails by its symbols, is drawn to the mean and stays
    rows += [(900, "tiny", words(30) + " ####")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = {r.doc_id: r.kept for r in hosts.judge(df).collect()}
    assert not any(kept[i] for i in kept if i < 200)
    assert all(kept[i] for i in kept if i >= 200)
    rates = {(r.host, r.rule): r.rate for r in hosts.host_rates(hosts.measures(df)).collect()}
    assert 0.5 < rates["bad", "base"] < 0.8
    assert 0 <= rates["tiny", "base"] < 0.5
    assert rates["tiny", "symbols"] < 0.5


def test_rates_by_the_formula(spark):
    rows = [("a", 10, 7), ("b", 40, 4), ("c", 5, 0), (None, 1, 1)]
    made = [(h, 10 if i < bad else 50) for h, n, bad in rows for i in range(n)]
    df = spark.createDataFrame(
        [(h, n, 5 * n, 0, 5, 0, 0) for h, n in made],
        "host string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long",
    )
    total = sum(n for _, n, _ in rows)
    p = sum(x for *_, x in rows) / total
    spread = sum(n * (x / n - p) ** 2 for _, n, x in rows)
    k = len(rows) - 1
    share = (spread / (p * (1 - p)) - k) / (total - sum(n * n for _, n, _ in rows) / total - k)
    share = min(max(share, 0), 1 / 11)
    weight = (1 - share) / share
    got = {r.host: r.rate for r in hosts.host_rates(df).filter("rule = 'base'").collect()}
    assert got == pytest.approx({h: (weight * p + x) / (weight + n) for h, n, x in rows})


def test_one_host_and_no_failures(spark):
    df = spark.createDataFrame([(1, "a", words(30))] * 3, "doc_id long, source string, text string")
    assert [(r.doc_id, r.kept, r.worst_rate) for r in hosts.judge(df).collect()] == [(1, True, 0.0)] * 3


def test_awkward_rows(spark):
    rows = [
        (1, None, words(25), "x", 1, "y"), (1, None, words(25), "x", 1, "y"), (None, "", None, None, None, None),
        (2, "", "", "x", 1, "y"), (3, "s", "a" * 300_000, "x", 1, "y"), (4, "s", words(60_000), "x", 1, "y"),
    ]
    got = hosts.judge(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, s, t, *_ in rows if (i, s) == (r.doc_id, r.host))
        assert {c: r[c] for c in brute(text)} == brute(text)
        assert r.base_failed == (r.n_words < 20)
    assert {r.kept for r in got if r.base_failed} == {False}


def test_empty_table(spark):
    assert hosts.judge(spark.createDataFrame([], ROWS)).collect() == []
