"""Near-duplicate documents by ProbMinHash.

A document is a set of shingles of five words, each weighted by 1 + ln(its count). Two documents are
linked if the probability Jaccard similarity of these weights is 0.8 or more; for shingles that occur once
it is the Jaccard similarity. A class is a connected component of links.

1. Documents with the same words in the same order are one class from the start, whose smallest id stands
   for it, so a large group of copies is summed up by each task and goes no further.
2. Signatures: each shingle is a Poisson process whose rate is its weight; its arrivals fall into random
   registers, a register keeps its first arrival, and a shingle stops when its next arrival comes later
   than all registers' (ProbMinHash). The share of equal registers estimates the similarity.
3. Banding: documents that share all registers of a band meet in a bucket. With 16 bands of 4 a pair at 0.8
   meets with a probability of 0.9998.
4. Verification in rounds: per bucket one member is the centre, in the first round the one whose buckets are
   fullest, as a family's most typical text shares most of its buckets; later two drawn ones. Members of other
   classes that have enough registers in common with a centre are compared with it on their whole texts; then
   classes are joined. So a bucket costs its size in a round, not its square. Rounds end when few of the compared
   pairs are links.
5. The rest: in buckets that still hold several classes, the members outside the largest class meet all others in
   cells of two blocks of bounded size, whose registers are compared as arrays. The texts of a cell's pairs with
   enough registers in common are taken apart once for all its pairs; a pair is dropped if the weight that two
   texts share is too small for the threshold, whatever the rest, and left out if its classes are joined by then.
   No pair of a bucket stays open; what the rounds have put into one class is not compared with itself.

Ids must be whole numbers, and one row per id; rows without an id are left out. Texts without a word
(null, empty, punctuation) have no shingles and are classes of their own. Texts of fewer than five words
are one shingle. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import words as W
from corpusloom.llm.components import components, stored
from corpusloom.session import scratch_path, shared_folder

BANDS, ROWS = 16, 4
#: Registers of a signature, of which the first BANDS * ROWS make the bands; all are compared before texts are.
REGISTERS = 256
THRESHOLD = 0.8
#: Pairs with fewer registers alike, by four bits of each, are not compared. A pair at 0.8 has 208 of 256 on
#: average, with a deviation of 6.2, so one in 10,000 of such pairs is lost; at 0.7 it has 184, at 0.6 160.
LEAST_ALIKE = 184
#: Centres of a bucket in the first round and in later ones; the share of links that calls for another round.
CENTRES, WORTH = (1, 2), 0.05
#: Members of a block of a bucket and bytes of their texts, on average.
BLOCK, BLOCK_BYTES = 512, 4 * W.PIECE
#: Arrivals that are drawn at once when few shingles are left.
FEW = 1 << 14
#: Pairs whose registers, and shingles whose weights, are looked up at once.
AT_ONCE = 1 << 16
CELL = ("bucket", "i", "j")


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a batch with their weights: shingle, text, weight."""
    values, counts = W.words(column)
    values, _, text = W.windows(values, counts, W.SHINGLE_WORDS)
    values, text, n = W.weighted(values, text)
    return values, text, 1 + np.log(n)


def signatures(values: np.ndarray, text: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """One row of registers per text, each with the shingle that came first; 0 for texts without any."""
    time = np.full(texts * REGISTERS, np.inf)
    who = np.zeros(texts * REGISTERS, np.uint64)
    latest = np.full(texts, np.inf)
    at = np.zeros(len(values))
    turn = 0
    while len(values):
        turns = np.arange(turn + 1, turn + 1 + min(max(1, FEW // len(values)), 64), dtype=np.uint64)  # of few shingles many arrivals at once
        turn += len(turns)
        draw = W.mix(values[:, None] + turns * np.uint64(0x9E3779B97F4A7C15))
        wait = np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) / (2.0**53 + 1)) / weight[:, None]
        wait[:, 0] = at - wait[:, 0]
        arrival = np.subtract.accumulate(wait, axis=1)
        soon, k = np.nonzero(arrival < latest[text][:, None])
        arrival, at, of = arrival[soon, k], arrival[:, -1], text[soon]
        slot = of * REGISTERS + (draw[soon, k] & np.uint64(REGISTERS - 1)).astype(np.int64)
        np.minimum.at(time, slot, arrival)
        first = time[slot] == arrival
        who[slot[first]] = values[soon[first]]
        live = of[np.flatnonzero(np.diff(of, prepend=-1))]
        latest[live] = time.reshape(texts, REGISTERS)[live].max(axis=1)
        go_on = at < latest[text]
        values, text, weight, at = values[go_on], text[go_on], weight[go_on], at[go_on]
    return who.reshape(texts, REGISTERS)


def _bands(who: np.ndarray) -> np.ndarray:
    out = np.zeros((len(who), BANDS), np.uint64)
    for row in range(ROWS):
        out = W.mix(out + who[:, row : BANDS * ROWS : ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64))
    return out.view(np.int64)


def _sketch(who: np.ndarray) -> np.ndarray:
    """Four bits of each register, sixteen registers in a number."""
    bits = (W.mix(who) & np.uint64(15)).reshape(len(who), -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(bits, axis=2).view(np.int64)


def _alike(one: Column, other: Column) -> Column:
    """Registers whose four bits agree in two sketches."""
    count = F.lit(REGISTERS)
    for k in range(REGISTERS // 16):
        x = one[k].bitwiseXOR(other[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        count = count - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return count


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id, a fingerprint of the words in order, buckets and sketch of each text that has words."""
    for batch in batches:
        for part in W.pieces(batch, "text"):
            values, counts = W.words(part["text"])
            per_text = np.diff(counts)
            text = np.repeat(np.arange(len(per_text)), per_text)
            place = (np.arange(len(values)) - counts[text]).astype(np.uint64)
            same = []
            for salt in (0x1F3D5B79, 0x2E4C6A88):
                one = np.zeros(len(per_text), np.uint64)
                np.add.at(one, text, W.mix(W.mix(values + np.uint64(salt)) + place))
                same.append(W.mix(one + per_text.astype(np.uint64)).view(np.int64))
            shingle, _, of = W.windows(values, counts, W.SHINGLE_WORDS)
            shingle, of, n = W.weighted(shingle, of)
            who = signatures(shingle, of, 1 + np.log(n), len(per_text))
            buckets, sketch = _bands(who), _sketch(who)
            keep = np.flatnonzero(per_text)
            off = pa.array(np.arange(len(keep) + 1, dtype=np.int32) * BANDS)
            yield pa.record_batch(
                {
                    "id": part["id"].take(pa.array(keep)),
                    "same1": pa.array(same[0][keep]),
                    "same2": pa.array(same[1][keep]),
                    "buckets": pa.ListArray.from_arrays(off, pa.array(buckets[keep].reshape(-1))),
                    "sketch": pa.ListArray.from_arrays(
                        pa.array(np.arange(len(keep) + 1, dtype=np.int32) * sketch.shape[1]), pa.array(sketch[keep].reshape(-1))
                    ),
                }
            )


def similarity(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Probability Jaccard similarity of the texts in each row of two columns."""
    return _similarity(*_merged(*shingles(left), *shingles(right)), len(left))


def _merged(
    av: np.ndarray, at: np.ndarray, aw: np.ndarray, bv: np.ndarray, bt: np.ndarray, bw: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of either text of a row, once: row, weight in the one and in the other text (0 for none)."""
    key = np.concatenate([(at.astype(np.uint64) << np.uint64(48)) | av, (bt.astype(np.uint64) << np.uint64(48)) | bv])
    key, place = np.unique(key, return_inverse=True)
    a, b = np.zeros(len(key)), np.zeros(len(key))
    a[place[: len(av)]] = aw
    b[place[len(av) :]] = bw
    return (key >> np.uint64(48)).astype(np.int64), a, b


def _similarity(row: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    both = np.flatnonzero((a > 0) & (b > 0))
    ratio = a[both] / b[both]
    out = np.zeros(rows)
    for t in np.unique(ratio):
        mine = both[ratio == t]
        has = np.zeros(rows, bool)
        has[row[mine]] = True
        part = has[row]
        total = np.bincount(row[part], np.maximum(a[part], t * b[part]), rows)
        out += np.bincount(row[mine], a[mine] / total[row[mine]], rows)
    return out


def _most(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The largest similarity that two texts can have, from the shares of their weights that lie on common shingles.

    With p and q the weights as shares and y the other's share on its own shingles, a common shingle adds at most
    1 / (1 / p + y / q), which is concave, so all of them add at most that of their sums.
    """
    return one * other / np.maximum(1 - (1 - one) * (1 - other), 1e-300)


def _linked(row: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int, threshold: float) -> np.ndarray:
    """Rows whose similarity is the threshold or more; where bounds don't tell, by the similarity itself."""
    both = (a > 0) & (b > 0)
    one, other = (np.bincount(row, x * both, rows) / np.maximum(np.bincount(row, x, rows), 1e-300) for x in (a, b))
    least = np.bincount(row, np.minimum(a, b), rows) / np.maximum(np.bincount(row, np.maximum(a, b), rows), 1e-300)
    out = least >= threshold + 1e-6
    open_ = ~out & (_most(one, other) >= threshold - 1e-6)
    if open_.any():
        part = open_[row]
        out[open_] = _similarity((np.cumsum(open_) - 1)[row[part]], a[part], b[part], int(open_.sum())) >= threshold - 1e-9
    return out


def _verified(threshold: float):
    """The classes of the pairs whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.pieces(batch, "text_b", rows=512):
                merged = _merged(*shingles(part["text_a"]), *shingles(part["text_b"]))
                alike = pa.array(_linked(*merged, part.num_rows, threshold))
                yield pa.record_batch({"a": part["class_a"].filter(alike), "b": part["class_b"].filter(alike)})

    return run


def _cells(table: pa.Table) -> np.ndarray:
    """Where each cell begins, and the end."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in CELL:
        key = table[name].to_numpy()
        new[1:] |= key[1:] != key[:-1]
    return np.append(np.flatnonzero(new), len(new))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches as tables of whole cells, of rows in the order of their cells."""
    held = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, new]) if held is not None else new
        last = int(_cells(held)[-2:][0])
        if last:
            yield held.slice(0, last)
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield held


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists as rows, a shorter one filled up with its first value."""
    column = column.combine_chunks()
    size = column.value_lengths().to_numpy()
    start = np.cumsum(size) - size
    place = np.arange(size.max(initial=0))
    return column.flatten().to_numpy()[start[:, None] + np.where(place < size[:, None], place, 0)]


def _runs(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of several runs, and the number of the run of each."""
    run = np.repeat(np.arange(len(size)), size)
    return np.arange(len(run)) + (start - (np.cumsum(size) - size))[run], run


def _open_pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Every two members of different classes that share a bucket and have enough registers alike: rows, registers alike.

    A cell has members of one block of a bucket, and then those of a block of the members outside the largest class.
    A pair that shares several buckets is taken in the first of them.
    """
    cut = _cells(table)
    outside, of_most = (table[name].to_numpy() for name in ("outside", "of_most"))
    bucket, key, label = (table[name].to_numpy() for name in ("bucket", "id", "label"))
    buckets, sketch = _matrix(table["buckets"]), _matrix(table["sketch"]).view(np.uint64).T.copy()
    others = np.add.reduceat(outside.astype(np.int64), cut[:-1])
    ones = np.diff(cut) - others
    before = np.append(0, np.cumsum(ones * others))
    for at in range(0, int(before[-1]), AT_ONCE):
        pair = np.arange(at, min(at + AT_ONCE, before[-1]))
        of = np.searchsorted(before, pair, side="right") - 1
        x, y = np.divmod(pair - before[of], others[of])
        x, y = x + cut[of], y + cut[of] + ones[of]
        met = (label[x] != label[y]) & (of_most[x] | (key[x] < key[y]))
        x, y = x[met], y[met]
        alike = np.full(len(x), REGISTERS)
        for part in sketch:
            bits = part[x] ^ part[y]
            bits |= bits >> np.uint64(1)
            bits |= bits >> np.uint64(2)
            alike -= np.bitwise_count(bits & np.uint64(0x1111111111111111))
        near = alike >= LEAST_ALIKE
        x, y, alike = x[near], y[near], alike[near]
        mine, theirs = buckets[x], buckets[y]
        common = (mine[:, :, None] == theirs[:, None, :]).any(axis=2)
        last = np.iinfo(np.int64).max
        first = np.where(common, mine, last).min(axis=1, initial=last) == bucket[x]
        yield x[first], y[first], alike[first]


def _with_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each cell that have a pair there."""
    for table in _whole(batches):
        has = np.zeros(table.num_rows, bool)
        for x, y, _ in _open_pairs(table):
            has[x] = has[y] = True
        yield from table.filter(pa.array(has)).to_batches()


def _enough_shared(
    start: np.ndarray, code: np.ndarray, weight: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float
) -> np.ndarray:
    """Pairs of texts x and y that share enough weight for the threshold; ``start`` is where each text's shingles begin."""
    total = np.append(0, np.cumsum(weight))
    total = np.maximum(total[start[1:]] - total[start[:-1]], 1e-300)
    size = np.diff(start)
    held = np.zeros(int(code.max(initial=-1)) + 1)
    out = np.zeros(len(x), bool)
    if len(np.unique(y)) < len(np.unique(x)):
        x, y = y, x
    order = np.argsort(x, kind="stable")
    first = np.flatnonzero(np.diff(x[order], prepend=-1))
    for lo, hi in zip(first, np.append(first[1:], len(x)), strict=True):
        one = x[order[lo]]
        own = slice(start[one], start[one + 1])
        held[code[own]] = weight[own]
        steps = np.cumsum(size[y[order[lo:hi]]]) // AT_ONCE
        for pairs in np.split(order[lo:hi], np.flatnonzero(np.diff(steps)) + 1):
            place, pair = _runs(start[y[pairs]], size[y[pairs]])
            mine = held[code[place]]
            shared = np.bincount(pair, mine, len(pairs)) / total[one]
            theirs = np.bincount(pair, weight[place] * (mine > 0), len(pairs)) / total[y[pairs]]
            out[pairs] = _most(shared, theirs) >= threshold - 1e-6
        held[code[own]] = 0
    return out


def _cell_links(part: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Classes that links between the texts of some cells join; not all links of classes that are joined already."""
    pieces = [piece["text"] for batch in part.select(["text"]).to_batches() for piece in W.pieces(batch, "text")]
    before = np.cumsum([0, *map(len, pieces)])
    value, of, weight = zip(*map(shingles, pieces), strict=True)
    value, weight = np.concatenate(value), np.concatenate(weight)
    of = np.concatenate([o + n for o, n in zip(of, before[:-1], strict=True)])
    start = np.searchsorted(of, np.arange(part.num_rows + 1))
    code = np.unique(value, return_inverse=True)[1]
    classes, label = np.unique(part["label"].to_numpy(), return_inverse=True)
    joined, size, found = np.arange(len(classes)), np.diff(start), ([], [])
    for x, y, alike in _open_pairs(part):
        left = np.flatnonzero(joined[label[x]] != joined[label[y]])
        left = left[_enough_shared(start, code, weight, x[left], y[left], threshold)]
        left = left[np.argsort(-alike[left], kind="stable")]
        x, y, rows = x[left], y[left], 16
        while len(x):
            to = max(1, min(rows, int(np.searchsorted(np.cumsum(size[x] + size[y]), W.PIECE))))
            at, of_a = _runs(start[x[:to]], size[x[:to]])
            bt, of_b = _runs(start[y[:to]], size[y[:to]])
            merged = _merged(value[at], of_a, weight[at], value[bt], of_b, weight[bt])
            for k in np.flatnonzero(_linked(*merged, len(x[:to]), threshold)):
                low, high = sorted((joined[label[x[k]]], joined[label[y[k]]]))
                if low != high:
                    joined[joined == high] = low
                    found[0].append(classes[label[x[k]]])
                    found[1].append(classes[label[y[k]]])
            left = to + np.flatnonzero(joined[label[x[to:]]] != joined[label[y[to:]]])
            x, y, rows = x[left], y[left], min(2 * rows, 512)
    return np.array(found[0], np.int64), np.array(found[1], np.int64)


def _verified_cells(threshold: float):
    """The classes that the pairs of each cell join, where texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            cut = _cells(table)
            steps = np.cumsum(np.add.reduceat(table["size"].to_numpy(), cut[:-1])) // BLOCK_BYTES
            for cells in np.split(np.arange(len(steps)), np.flatnonzero(np.diff(steps)) + 1):
                part = table.slice(cut[cells[0]], cut[cells[-1] + 1] - cut[cells[0]])
                one, other = _cell_links(part, threshold)
                yield pa.record_batch({"a": pa.array(one), "b": pa.array(other)})

    return run


def _dealt(df: DataFrame, *then: str) -> DataFrame:
    """Rows of a cell one after another in one task."""
    return df.repartition(*CELL).sortWithinPartitions(*CELL, *then)


def _rest(members: DataFrame, known: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links between the classes that are still apart: enough of them to join all classes that links join.

    A bucket's members, and those of them outside its largest class, are dealt into blocks, and each two blocks
    are a cell.
    """
    sizes = texts.groupBy("id").agg(F.sum("size").alias("size"))
    classes = members.join(sizes, "id").groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES))
    spread = (
        classes.groupBy("bucket")
        .agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "label", "size")).alias("most"))
        .filter("n > most.n")
        .select(
            "bucket", F.col("most.label").alias("most"), blocks(F.col("n"), F.col("size")).alias("all_blocks"),
            blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("blocks"),
        )
    )
    rows = members.join(spread, "bucket").join(known.select("id", "buckets", "sketch"), "id")
    every = F.pmod(F.xxhash64("bucket", "id"), "all_blocks")
    other = F.pmod(F.xxhash64("id", "bucket"), "blocks")
    in_cells = lambda df, i, j, outside: df.select(
        "bucket", i.alias("i"), j.alias("j"), F.lit(outside).alias("outside"),
        (F.col("label") == F.col("most")).alias("of_most"), "id", "label", "buckets", "sketch",
    )
    all_of = in_cells(rows, every, F.explode(F.expr("sequence(0L, blocks - 1)")), False)
    outside = in_cells(rows.filter("label <> most"), F.explode(F.expr("sequence(0L, all_blocks - 1)")), other, True)
    cells = all_of.unionByName(outside)
    met = stored(_dealt(cells, "outside").mapInArrow(_with_pairs, cells.schema), "cells")
    return stored(_dealt(met.join(texts, "id"), "outside").mapInArrow(_verified_cells(threshold), "a long, b long"), "links")


def _star_pairs(members: DataFrame, known: DataFrame, turn: int) -> DataFrame:
    """Members of each bucket with its centres, where the classes differ and enough registers are alike."""
    centre = F.struct("id", "label")
    if turn:
        ranks = [F.xxhash64(F.lit(turn), F.lit(k), "bucket", "id") for k in range(CENTRES[1])]
    else:
        ranks = [F.struct(-F.col("density"), "id")]
    open_ = members.groupBy("bucket").agg(
        *[F.min_by(centre, r).alias(f"c{k}") for k, r in enumerate(ranks)],
        F.min("label").alias("least"), F.max("label").alias("most"),
    )
    centres = F.explode(F.array(*[f"c{k}" for k in range(len(ranks))])).alias("c")
    met = members.join(open_.filter("least <> most").select("bucket", centres), "bucket").filter("label <> c.label")
    pairs = _pairs(met, centre, F.struct("c.id", "c.label")).distinct()
    pairs = pairs.join(known.select(F.col("id").alias("a"), F.col("sketch").alias("one")), "a")
    pairs = pairs.join(known.select(F.col("id").alias("b"), F.col("sketch").alias("other")), "b")
    return pairs.filter(_alike(F.col("one"), F.col("other")) >= LEAST_ALIKE).select("a", "class_a", "b", "class_b")


def _pairs(met: DataFrame, one: Column, other: Column) -> DataFrame:
    """Pairs of members that met, the smaller id first."""
    return met.select(F.least(one, other).alias("x"), F.greatest(one, other).alias("y")).select(
        F.col("x.id").alias("a"), F.col("x.label").alias("class_a"),
        F.col("y.id").alias("b"), F.col("y.label").alias("class_b"),
    )


def bucket_classes(
    texts: DataFrame, buckets: DataFrame, threshold: float = THRESHOLD, sketches: DataFrame | None = None
) -> DataFrame:
    """``id`` and ``label``, the smallest id of its class, for the ids that share a bucket with others.

    ``texts`` has a row (id, text) for each id, ``buckets`` a row (bucket, id) for each membership, ``sketches`` a row
    (id, sketch) for each id; without it ``buckets`` has a column sketch.
    """
    spark = buckets.sparkSession
    if sketches is None:
        sketches = buckets.select("id", "sketch").dropDuplicates(["id"])
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(buckets.select("bucket", "id").join(sizes, "bucket"), "shared")
    own = shared.groupBy("id").agg(F.sum("n").alias("density"), F.collect_set("bucket").alias("buckets"))
    known = stored(own.join(sketches, "id"), "known")
    label = known.select("id", F.col("id").alias("label"))
    members = stored(shared.drop("n").join(known.select("id", "density"), "id").withColumn("label", F.col("id")), "members")
    texts = texts.join(label.select("id"), "id", "left_semi")
    texts = stored(texts.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), "texts")
    compared, turn, stars = scratch_path(spark, "pairs"), 0, True
    while True:
        if stars:
            pairs = _star_pairs(members, known, turn)
            if turn:  # no pair is compared twice
                before = spark.read.schema(pairs.schema).parquet(f"{compared}/*").select("a", "b")
                pairs = pairs.join(before, ["a", "b"], "left_anti")
            pairs.write.parquet(f"{compared}/{turn}")
            pairs = spark.read.schema(pairs.schema).parquet(f"{compared}/{turn}")
            both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
            both = both.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            new = stored(both.mapInArrow(_verified(threshold), "a long, b long"), "links")
        else:
            new = _rest(members, known, texts, threshold)
        links = new.count()
        if links:
            joined = components(new).select(F.col("node").alias("label"), F.col("label").alias("whole"))
            whole = F.coalesce("whole", "label").alias("label")
            label = stored(label.join(joined, "label", "left").select("id", whole), "labels")
        if not stars:
            return label
        if links:
            members = stored(members.join(joined, "label", "left").select("bucket", "id", "density", whole), "members")
        turn += 1
        stars = links > 0 and links >= WORTH * pairs.count()


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: ``key``, class_id (its smallest id), class_size, kept (it is that one)."""
    spark = docs.sparkSession
    shared_folder(spark)
    rows = docs.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")
    )
    signed = rows.mapInArrow(_signed, "id long, same1 long, same2 long, buckets array<long>, sketch array<long>")
    signed = stored(signed, "signatures")
    same = signed.groupBy("same1", "same2").agg(
        F.min("id").alias("first"), F.first("buckets").alias("buckets"), F.first("sketch").alias("sketch")
    )
    same = stored(same, "texts-apart")
    buckets = same.select(F.explode("buckets").alias("bucket"), F.col("first").alias("id"))
    sketches = same.select(F.col("first").alias("id"), "sketch")
    label = bucket_classes(rows, buckets, threshold, sketches).withColumnRenamed("id", "first")
    named = same.select("same1", "same2", "first").join(label, "first", "left")
    named = named.select("same1", "same2", F.coalesce("label", "first").alias("class_id"))
    member = signed.select("id", "same1", "same2").join(named, ["same1", "same2"]).select("id", "class_id")
    member = stored(member, "classes")
    bare = rows.select("id").join(member.select("id"), "id", "left_anti").withColumn("class_id", F.col("id"))
    every = member.unionByName(bare)
    # written, so that the join's sides are plain exchanges, which can be split at a large class
    sizes = stored(every.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")), "sizes")
    return every.join(sizes, "class_id").select(
        F.col("id").alias(key), "class_id", "class_size", (F.col("id") == F.col("class_id")).alias("kept")
    )
