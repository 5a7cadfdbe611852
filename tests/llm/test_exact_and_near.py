"""Exact and near dedup, decontamination: brute force on small tables, and the awkward rows."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, exact, near
from corpusloom.llm import words as W
from corpusloom.llm.components import components

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, digest string, buckets int"


def _plain(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _exact(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[_plain(text)].append(key)
    return {(k, max(groups[_plain(t)]), len(groups[_plain(t)]), k == max(groups[_plain(t)])) for k, t in rows}


AWKWARD = [
    (1, None, "x", 1), (2, "", "x", 1), (3, "Ab É", "x", 1), (4, "aB É", "x", 1), (5, "ab é", "x", 1),
    (6, "word " * 200_000, "x", None), (7, "WORD " * 200_000, None, 1), (8, "...", "x", 1), (9, "one two", "x", 1),
    (10, "one  TWO!", "x", 1),
]


def test_exact_on_awkward_rows(spark):
    rows = spark.createDataFrame(AWKWARD, DOCS)
    got = exact.exact_dedup(rows).collect()
    assert {tuple(r)[:4] for r in got} == _exact([r[:2] for r in AWKWARD])
    assert len(got) == len(AWKWARD)


def test_exact_null_ids_and_repeated_rows(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "b"), (1, "b"), (1, "b")], "doc_id long, text string")
    got = sorted(map(tuple, exact.exact_dedup(rows).drop("text_sha256").collect()), key=str)
    assert got == sorted([(None, None, 1, True), (None, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)], key=str)


def test_exact_empty(spark):
    assert exact.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_bytes_decide_when_digests_collide(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    weak = exact.exact_dedup(rows, digest=lambda c: F.pmod(F.crc32(c), F.lit(5)).cast("string"))
    want = _exact([(r.doc_id, r.text) for r in rows.collect()])
    assert {tuple(r)[:4] for r in weak.collect()} == want


def test_later_arrivals_meet_earlier_texts(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    later = spark.createDataFrame([(3, "A"), (4, "c")], "doc_id long, text string")
    exact.exact_dedup(first, state=state).count()
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_dedup(later, state=state).collect()}
    assert got == {3: (3, 2), 4: (4, 1)}
    assert exact.known(spark, state).count() == 3


def test_exact_plan_has_no_python(spark):
    plan = exact.exact_dedup(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (7, 7)] + [(k, k + 1) for k in range(100, 160)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {k: 100 for k in range(100, 161)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _jaccard_p(a, b):
    """Probability Jaccard similarity by its definition, term by term."""
    every = set(a) | set(b)
    return sum(
        1 / sum(max(a.get(z, 0) / a[x], b.get(z, 0) / b[x]) for z in every) for x in every if a.get(x) and b.get(x)
    )


def _weights(text):
    value, _, weight = near.shingles(pa.array([text]))
    return dict(zip(value.tolist(), weight.tolist(), strict=True))


def test_similarity_is_probability_jaccard():
    rng = np.random.default_rng(3)
    left = [" ".join(rng.choice(list("abc"), 40)) for _ in range(20)]
    right = [" ".join(rng.choice(list("abc"), 30)) + " " + x[:20] for x in left]
    got = near.similarity(pa.array(left), pa.array(right))
    want = [_jaccard_p(_weights(a), _weights(b)) for a, b in zip(left, right, strict=True)]
    assert np.allclose(got, want)


def test_registers_estimate_the_similarity():
    words = [f"w{k}" for k in range(400)]
    texts = pa.array([" ".join(words), " ".join(words[:360] + words[:20])])
    value, text, weight = near.shingles(texts)
    who = near.signatures(value, text, weight, 2)
    estimate = (who[0] == who[1]).mean()
    assert abs(estimate - near.similarity(texts.slice(0, 1), texts.slice(1, 1))[0]) < 0.2


def test_near_classes_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    base = " ".join(f"t{k}" for k in range(300))
    rows += [(9000 + k, base.replace(f"t{7 * k} ", "other ")) for k in range(1, 20)]
    got = dict(map(tuple, near.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id").collect()))
    weights = {k: _weights(t) for k, t in rows}
    label = {k: k for k, _ in rows}
    for i, (a, _) in enumerate(rows):
        for b, _ in rows[i + 1 :]:
            x, y = weights[a], weights[b]
            if x and y and len(x.keys() & y.keys()) >= 0.6 * min(len(x), len(y)) and _jaccard_p(x, y) >= 0.8:
                old, new = sorted((label[a], label[b]), reverse=True)
                label = {k: new if v == old else v for k, v in label.items()}
    assert got == label


def test_a_family_of_half_alike_texts_loses_no_copy(spark):
    rng = np.random.default_rng(8)
    form = [f"form{k}" for k in range(130)]
    texts = [" ".join([*form, *(f"own{k}x{j}" for j in range(40))]) for k in range(700)]
    copies = sorted(int(k) for k in rng.choice(700, 12, replace=False))
    texts += [texts[k] + " more" for k in copies]
    column = pa.array(texts)
    value, text, weight = near.shingles(column)
    sketch = near._sketch(near.signatures(value, text, weight, len(texts))).tolist()
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    buckets = spark.createDataFrame([(b, k, s) for k, s in enumerate(sketch) for b in (1, 2)], "bucket long, id long, sketch array<long>")
    assert near.similarity(column.slice(0, 1), column.slice(1, 1))[0] < 0.79
    got = dict(map(tuple, near.bucket_classes(rows, buckets).collect()))
    assert got == {k: k for k in range(700)} | {700 + n: k for n, k in enumerate(copies)}


def test_near_awkward_rows(spark):
    rows = [*AWKWARD, (None, "one two", "x", 1)]
    got = {r.doc_id: (r.class_id, r.class_size, r.kept) for r in near.near_classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1] == (1, 1, True) and got[2] == (2, 1, True) and got[8] == (8, 1, True)
    assert got[3] == (3, 3, True) and got[4] == (3, 3, False)
    assert got[7] == (6, 2, False) and got[10] == (9, 2, False) and None not in got
    assert near.near_classes(spark.createDataFrame([], DOCS)).count() == 0


def test_contamination_equals_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    want = {
        (d.doc_id, b.item_id)
        for d in docs.collect()
        for b in items.collect()
        if b.text.lower() in (d.text or "").lower()
    }
    assert want and got == want


QUESTION = "As we know, Tom Baker has 12 apples and gives 5 kg to his sister Mary, who then walks 3 miles to the old market with Tom Baker."


@pytest.mark.parametrize(
    ("text", "found", "same"),
    [
        (QUESTION, True, True),
        ("Before it. " + QUESTION + " After it.", True, True),
        ("As we know, Ann Lee has 99 apples and gives 7 lb to his sister Eve, who then walks 8 km to the old market with Ann Lee.", True, False),
        ("As we know, Ann Lee has 99 apples and gives 7 lb to his sister Eve, who then walks 8 km to the old market with Bob Ray.", False, None),
        ("as we know nobody has any apples and so gives nothing to anyone who then stays at home", False, None),
        (None, False, None),
        ("", False, None),
    ],
)
def test_templates(spark, text, found, same):
    docs = spark.createDataFrame([(5, text, "c")], "doc_id long, text string, window string")
    items = spark.createDataFrame([(1, QUESTION), (2, None), (3, ""), (4, "12 13")], "item_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.exact) for r in got] == ([(5, 1, same)] if found else [])


def test_copies_with_one_altered_slot_or_in_another_case(spark):
    item = "At noon the teacher John opened the wide old door to the garden and went slowly down the long path, and there the gardener John sat."
    docs = [(1, item.replace("John sat", "Jon sat")), (2, QUESTION.lower()), (3, QUESTION.upper()), (4, "12 13 5 kg")]
    items = spark.createDataFrame([(1, item), (2, QUESTION), (3, "12 13"), (4, "5 kg")], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.item_id, r.exact) for r in got) == [(1, 1, False), (2, 2, True), (3, 2, True)]


def test_names_at_the_start_of_sentences_are_slots(spark):
    item = "Tom has 5 red apples. Tom buys 3 more apples. Anna gives Tom 2 apples. How many apples does Tom have now?"
    other = "Ben has 9 red apples. Ben buys 4 more apples. Lucy gives Ben 7 apples. How many apples does Ben have now?"
    mixed = "Ben has 9 red apples. Max buys 4 more apples. Lucy gives Ben 7 apples. How many apples does Max have now?"
    clean = "Ben sold red apples at the market. The apples were more than Ben could carry, and so Lucy helped Ben all day."
    docs = [(1, item), (2, other), (3, mixed), (4, clean), (5, other), (5, other)]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.exact) for r in got) == [(1, True), (2, False), (5, False)]


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(5, QUESTION)], "doc_id long, text string")
    items = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_word_fingerprints_do_not_depend_on_neighbours():
    texts = ["Éa bc", None, "", "bc, éA!", "x" * 3000 + " bc"]
    values, counts = W.words(pa.array(texts))
    own = [W.words(pa.array([t]))[0].tolist() for t in texts]
    assert [values[a:b].tolist() for a, b in zip(counts[:-1], counts[1:], strict=True)] == own
    assert own[0] == own[3][::-1] and own[4][1] == own[0][1]


def test_sketches_count_registers_alike(spark):
    rng = np.random.default_rng(4)
    one = rng.integers(0, 1 << 48, (30, near.REGISTERS)).astype(np.uint64)
    other = np.where(rng.random(one.shape) < rng.random((30, 1)), one, one + np.uint64(1))
    bits = [(W.mix(x) & np.uint64(15)) for x in (one, other)]
    rows = list(zip(near._sketch(one).tolist(), near._sketch(other).tolist(), strict=True))
    frame = spark.createDataFrame(rows, "a array<long>, b array<long>")
    got = [r.n for r in frame.select(near._alike(F.col("a"), F.col("b")).alias("n")).collect()]
    assert got == (bits[0] == bits[1]).sum(axis=1).tolist()


def test_signatures_are_those_of_one_arrival_at_a_time():
    texts = pa.array(["one two", "a b c d e f g", "x " * 300, "", " ".join(f"w{k} w{k % 7}" for k in range(400))])
    value, text, weight = near.shingles(texts)
    time, want = np.full((5, near.REGISTERS), np.inf), np.zeros((5, near.REGISTERS), np.uint64)
    for v, t, w in zip(value, text, weight, strict=True):
        at, turn = 0.0, 0
        while at < time[t].max():
            turn += 1
            draw = W.mix(np.array([v + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)]))[0]
            at -= np.log((float(draw >> np.uint64(11)) + 1) / (2.0**53 + 1)) / w
            slot = int(draw) % near.REGISTERS
            if at < time[t, slot]:
                time[t, slot], want[t, slot] = at, v
    assert (near.signatures(value, text, weight, 5) == want).all()


def test_bounds_decide_as_the_similarity_does(monkeypatch):
    rng = np.random.default_rng(6)
    left = [" ".join(rng.choice(list("abc"), n)) for n in rng.integers(5, 200, 300)]
    right = [x if k % 3 else x[: -2 * int(rng.integers(1, 12))] + " " + left[k - 1][:9] for k, x in enumerate(left)]
    merged = near._merged(*near.shingles(pa.array(left)), *near.shingles(pa.array(right)))
    want = near.similarity(pa.array(left), pa.array(right))
    assert (near._linked(*merged, 300, 0.8) == (want >= 0.8 - 1e-9)).all() and 0 < (want < 0.8).sum() < 300
    row, a, b = merged
    one, other = (np.bincount(row, x * (a > 0) * (b > 0), 300) / np.bincount(row, x, 300) for x in (a, b))
    assert (near._most(one, other) >= want - 1e-9).all()


def test_open_pairs_of_cells_that_span_batches():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 16, near.REGISTERS)
    rows, want = [], set()
    for bucket in (5, 9):
        for j in (0, 1):
            cell = []
            for k in range(23):
                bits = np.where(rng.random(near.REGISTERS) < 0.14, rng.integers(0, 16, near.REGISTERS), base).astype(np.uint64)
                sketch = np.bitwise_or.reduce(bits.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1)
                label = int(rng.integers(0, 4))
                cell.append((bucket, 3, j, k >= 12, label == 0 and k < 12, 1000 * (10 * bucket + j) + k, label, [5, 9] if k % 5 else [bucket], sketch.view(np.int64).tolist(), bits))
            rows += [r[:-1] for r in cell]
            for x in cell[:12]:
                for y in cell[12:]:
                    if x[6] != y[6] and (x[4] or x[5] < y[5]) and (x[9] == y[9]).sum() >= near.LEAST_ALIKE and min(set(x[7]) & set(y[7])) == bucket:
                        want.add((x[5], y[5], int((x[9] == y[9]).sum())))
    names = [*near.CELL, "outside", "of_most", "id", "label", "buckets", "sketch"]
    table = pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
    batches = [b for at in range(0, len(rows), 9) for b in table.slice(at, 9).to_batches()]
    tables = list(near._whole(iter(batches)))
    assert len(tables) > 1 and pa.concat_tables(tables).equals(pa.Table.from_batches(batches))
    got = [(t["id"][int(a)].as_py(), t["id"][int(b)].as_py(), int(n)) for t in tables for p in near._open_pairs(t) for a, b, n in zip(*p, strict=True)]
    assert want and len(got) == len(set(got)) and set(got) == want
    kept = [k for b in near._with_pairs(iter(batches)) for k in b["id"].to_pylist()]
    assert sorted(kept) == sorted({k for p in want for k in p[:2]})


def test_a_cell_compares_no_pair_that_its_shares_rule_out(monkeypatch):
    """Each text is taken apart once, not once for each of its pairs."""
    form = [f"form{k}" for k in range(130)]
    texts = [" ".join([*form, *(f"own{k}x{j}" for j in range(40))]) for k in range(60)]
    texts += [t + " more" for t in texts[:7]] + [texts[0] + " even more"]
    value, text, weight = near.shingles(pa.array(texts))
    sketch = near._sketch(near.signatures(value, text, weight, len(texts))).tolist()
    cell = {"i": 0, "j": 0, "of_most": False}
    rows = [
        {"bucket": bucket, **cell, "outside": out, "id": k, "label": k, "buckets": [bucket], "sketch": sketch[k], "text": t, "size": len(t)}
        for bucket in (1, 2) for out in (False, True) for k, t in enumerate(texts)
    ]
    table = pa.Table.from_pylist(rows)
    taken, compared = [], []
    shingles, linked = near.shingles, near._linked
    monkeypatch.setattr(near, "shingles", lambda column: taken.append(len(column)) or shingles(column))
    monkeypatch.setattr(near, "_linked", lambda row, a, b, n, t: compared.append(n) or linked(row, a, b, n, t))
    links = [r for b in near._verified_cells(0.8)(iter(table.to_batches(50))) for r in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)]
    label = list(range(len(texts)))
    for a, b in links:
        label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    assert label == [*range(60), *range(7), 0]
    assert sum(taken) == 4 * len(texts) and sum(compared) <= 20


def test_a_family_far_larger_than_a_block_is_compared_as_a_whole(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 8)
    monkeypatch.setattr(near, "BLOCK_BYTES", 9000)
    form = [f"form{k}" for k in range(130)]
    texts = [" ".join([*form, *(f"own{k}x{j}" for j in range(40))]) for k in range(90)]
    texts += [texts[k] + " more" for k in (3, 50, 89)]
    value, text, weight = near.shingles(pa.array(texts))
    sketch = near._sketch(near.signatures(value, text, weight, len(texts))).tolist()
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = rows.unionByName(rows.filter("id < 5"))  # an id may come twice
    buckets = spark.createDataFrame([(b, k, s) for k, s in enumerate(sketch) for b in (1, 2)], "bucket long, id long, sketch array<long>")
    got = dict(map(tuple, near.bucket_classes(rows, buckets).collect()))
    assert got == {k: k for k in range(90)} | {90: 3, 91: 50, 92: 89}
