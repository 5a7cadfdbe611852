"""Removal of every byte inside a 100-byte string that also starts earlier in the corpus.

Texts are their UTF-8 bytes; a string starts earlier in a document of a smaller id, or further left in the
same one. All decisions are made on the input.

1. Each window of 100 bytes has an anchor: the smallest fingerprint of its 69 grams of 32 bytes. Equal
   windows have equal anchors, and neighbouring windows mostly share theirs, so a run of windows with one
   anchor is one narrow row: the anchor, a fingerprint of all bytes of the run, and its place. Only these
   rows are shuffled, about one for 37 bytes. An equal run that a task has seen before is marked at once.
2. Runs whose anchor is unique hold nothing that repeats. Of equal runs all but the first are marked whole.
   What is left are first runs whose anchor also has other runs (passages that end or begin there), or
   that have it more than once (a text that repeats itself).
3. Only of these the windows themselves are compared, within their anchor, in the order of their places.
4. The marked windows of a document are joined with its text, and the bytes that they cover go.

Anchors and windows are compared by 64-bit fingerprints, and a window's only among those with the same
anchor, which makes 128 bits of its content.

Null texts are empty. Ids are whole numbers. Rows with one id and text are one document, which none of them
makes go; texts that share an id are parts of it, in the order of a fingerprint. Rows without an id have the defined result that
nothing of them is removed or makes others go. Texts under 100 bytes keep all bytes. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import words as W
from corpusloom.session import scratch_path, shared_folder

LENGTH = 100
GRAM = 32
_FACTOR = 0x9E3779B97F4A7C15
_BYTE = W.mix(np.arange(1, 257, dtype=np.uint64))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_FACTOR, n, 1 << 64))


def gram_prints(data: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Fingerprints of all grams of the given lengths, by joining shorter grams. Lengths over the data lack."""
    powers = {1: _BYTE[data]}
    size = 1
    while 2 * size <= min(max(sizes), len(data)):
        half = powers[size]
        powers[2 * size] = half[:-size] * _power(size) + half[size:]
        size *= 2
    out = {}
    for wanted in sizes:
        if wanted > len(data):
            continue
        total, at, left = None, 0, wanted
        count = len(data) - wanted + 1
        while left:
            step = 1 << (left.bit_length() - 1)
            part = powers[step][at : at + count]
            total = part if total is None else total * _power(step) + part
            at, left = at + step, left - step
        out[wanted] = W.mix(total)
    return out


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: anchor, fingerprint, first window, number of windows, inner repeats.

    A window can repeat inside its run only if the run has the anchor's gram more than once.
    """
    prints = gram_prints(data, (GRAM, LENGTH))
    low, size, span = prints[GRAM], 1, LENGTH - GRAM + 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if span > size:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    count = np.diff(first, append=len(low))
    place = (np.arange(len(low)) - np.repeat(first, count)).astype(np.uint64)
    whole = np.add.reduceat(W.mix(prints[LENGTH] + place), first)
    grams = count + span - 1
    at = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams - first, grams)
    anchors = np.add.reduceat(prints[GRAM][at] == np.repeat(low[first], grams), np.cumsum(grams) - grams, dtype=np.int64)
    return low[first], W.mix(whole + count.astype(np.uint64)), first, count, anchors > 1


def _blocks(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of a long text that share all but one byte of a window, so every window is in one of them."""
    step = 4 * W.PIECE
    for at in range(0, max(1, len(data) - LENGTH + 1), step):
        yield at, data[at : at + step + LENGTH - 1]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each text. One that equals an earlier run of the batch is marked: its anchor is null."""
    for batch in batches:
        for part in W.pieces(batch, "text"):
            data, off = W.utf8(part["text"])
            ids, parts = part["id"].to_numpy(), part["part"].to_numpy()
            found = []
            for row in np.lexsort((parts, ids)).tolist():
                text = data[off[row] : off[row + 1]]
                if len(text) >= LENGTH:
                    for at, block in _blocks(text):
                        anchor, whole, first, count, inner = runs(block)
                        found.append((anchor, whole, np.full(len(first), ids[row]), np.full(len(first), parts[row]), first + at, count, inner))
            if not found:
                continue
            anchor, whole, key, of, first, count, inner = (np.concatenate(x) for x in zip(*found, strict=True))
            _, earliest, back = np.unique(anchor ^ W.mix(whole), return_index=True, return_inverse=True)
            at = earliest[back]
            again = (key != key[at]) | (of != of[at]) | (first != first[at])
            yield pa.record_batch(
                {
                    "anchor": pa.array(anchor.view(np.int64), mask=again),
                    "whole": pa.array(whole.view(np.int64)),
                    "id": pa.array(key),
                    "part": pa.array(of),
                    "start": pa.array(first),
                    "n": pa.array(count.astype(np.int32)),
                    "inner": pa.array(inner),
                }
            )


def _pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs that are to be compared window by window."""
    for batch in batches:
        for part in W.pieces(batch, "text"):
            data, off = W.utf8(part["text"])
            out = {"anchor": [], "id": [], "part": [], "start": [], "bytes": []}
            for row, (key, of, wanted) in enumerate(zip(*(part[c].to_pylist() for c in ("id", "part", "wanted")), strict=True)):
                for run in wanted:
                    a = off[row] + run["start"]
                    out["anchor"].append(run["anchor"])
                    out["id"].append(key)
                    out["part"].append(of)
                    out["start"].append(run["start"])
                    out["bytes"].append(data[a : a + run["n"] + LENGTH - 1].tobytes())
            yield pa.record_batch({k: pa.array(v, pa.binary() if k == "bytes" else pa.int64()) for k, v in out.items()})


def _later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that an earlier run of the same anchor has. Rows come by anchor, then by place."""
    last, known, place_before = None, np.zeros(0, np.uint64), None
    for batch in batches:
        # rows that are repeated follow each other, and count once
        places = list(zip(*(batch[c].to_pylist() for c in ("anchor", "id", "part", "start")), strict=True))
        once = [a != b for a, b in zip(places, [place_before, *places], strict=False)]
        place_before = places[-1] if places else place_before
        batch = batch.filter(pa.array(once, pa.bool_()))
        anchors = batch["anchor"].to_numpy()
        ids, parts, starts = batch["id"].to_numpy(), batch["part"].to_numpy(), batch["start"].to_numpy()
        data = batch["bytes"]
        cut = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]])) if len(anchors) else []
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(cut, [*cut[1:], len(anchors)], strict=True):
            if anchors[a] != last:
                last, known = anchors[a], np.zeros(0, np.uint64)
            for block in range(a, b, 256):
                rows = range(block, min(b, block + 256))
                prints = [gram_prints(np.frombuffer(data[i].as_py(), np.uint8), (LENGTH,))[LENGTH] for i in rows]
                sizes = np.array([len(p) for p in prints])
                flat = np.concatenate(prints)
                row = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                value, first, back = np.unique(flat, return_index=True, return_inverse=True)
                later = (np.arange(len(flat)) != first[back]) | np.isin(value, known, assume_unique=True)[back]
                if len(rows) < b - a or b == len(anchors):
                    known = np.union1d(known, value)
                key, of, at = ids[block : block + len(rows)][row], parts[block : block + len(rows)][row], starts[block : block + len(rows)][row] + place
                # neighbouring windows become one run again
                hit = np.flatnonzero(later)
                if len(hit):
                    new = np.flatnonzero(np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(row[hit]) > 0)]))
                    out.append((key[hit[new]], of[hit[new]], at[hit[new]], np.diff(new, append=len(hit))))
        if out:
            key, of, at, n = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.record_batch({"id": pa.array(key), "part": pa.array(of), "start": pa.array(at), "n": pa.array(n.astype(np.int32))})


def repeated_windows(rows: DataFrame) -> DataFrame:
    """Runs of windows that also start earlier (id, part, start, n), from rows of id, part and text."""
    spark = rows.sparkSession
    found = rows.mapInArrow(_anchors, "anchor long, whole long, id long, part long, start long, n int, inner boolean")
    # a run that is marked already goes anywhere
    key = F.coalesce("anchor", F.xxhash64("id", "part", "start"))
    same = Window.partitionBy("key")
    equal = Window.partitionBy("key", "whole").orderBy("id", "part", "start")
    placed = (
        found.withColumn("key", key)
        .withColumn("marked", F.col("anchor").isNull())
        .drop("anchor")
        .withColumn("several", F.col("inner") | (F.min("whole").over(same) != F.max("whole").over(same)))
        .withColumn("again", F.col("marked") | (F.rank().over(equal) > 1))
        .filter("again OR several")
        .select("key", "id", "part", "start", "n", "again")
    )
    path = scratch_path(spark, "runs")
    placed.write.parquet(path)
    placed = spark.read.parquet(path)
    wanted = (
        placed.filter("NOT again")
        .groupBy("id", "part")
        .agg(F.collect_set(F.struct(F.col("key").alias("anchor"), "start", "n")).alias("wanted"))
    )
    parts = rows.join(wanted, ["id", "part"]).mapInArrow(_pieces_of, "anchor long, id long, part long, start long, bytes binary")
    parts = parts.repartition("anchor").sortWithinPartitions("anchor", "id", "part", "start")
    return (
        placed.filter("again").select("id", "part", "start", "n").unionByName(
            parts.mapInArrow(_later_windows, "id long, part long, start long, n int")
        )
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.pieces(batch, "text"):
            data, off = W.utf8(part["text"])
            out = []
            for row, marks in enumerate(part["marks"].to_pylist()):
                text = data[off[row] : off[row + 1]]
                change = np.zeros(len(text) + 1, np.int32)
                for mark in marks or ():
                    change[mark["start"]] += 1
                    change[mark["start"] + mark["n"] + LENGTH - 1] -= 1
                gone = np.cumsum(change[:-1]) > 0
                begins = gone & ~np.concatenate([[False], gone[:-1]])
                out.append((len(text), int(gone.sum()), int(begins.sum()), text[~gone].tobytes()))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.record_batch(
                {
                    "id": part["id"],
                    "n_bytes": pa.array(columns[0], pa.int64()),
                    "n_removed": pa.array(columns[1], pa.int64()),
                    "n_spans": pa.array(columns[2], pa.int64()),
                    "kept": pa.array(columns[3], pa.binary()),
                }
            )


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: ``key``, n_bytes, n_removed, n_spans, and kept, the bytes that stay."""
    shared_folder(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.xxhash64("text"))
    marks = (
        repeated_windows(rows.filter("id IS NOT NULL"))
        .groupBy("id", "part")
        .agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    )
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return rows.join(marks, ["id", "part"], "left").mapInArrow(_cut, schema).withColumnRenamed("id", key)
