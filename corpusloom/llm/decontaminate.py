"""Documents that hold benchmark passages, also with other numbers, names and units.

Texts become templates: runs of numbers, names (capitalised words inside a sentence) and units (after a
number) are replaced by one typed placeholder each, other words are lower-cased. Windows of eight template
tokens, at least half of them words, are hash-joined with the benchmark's windows. An alignment is a
document, an item and the distance between their positions; it counts if its slots are consistent: the
same value in the item always has the same value in the document, and the reverse. Windows with the item's own
values always count, and so do windows of eight lower-cased words that are the item's, whatever their case. A word
that a text has as a name inside a sentence may be one at a sentence's start too; texts with such words have a second
set of template windows, in which it is a placeholder there as well. A document is reported
with an item if the counting alignments have half of the item's windows, or six of them or more (13 tokens
of a passage that goes on).

A bitmap of fixed size, made of the benchmark's windows, spares the other windows of the documents the
shuffle; it lets all matching ones through, whatever the size of the benchmark.

Null texts are empty and match nothing. An item with fewer tokens than a window is one window; items
whose words are fewer than half of it (or none) match nothing. Rows that repeat an id count as parts of the same document
or item. Ids must be whole numbers, rows without one are left out. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import words as W
from corpusloom.session import cut_lineage, shared_folder

WINDOW = 8
SHARE = 0.5
#: So many windows report an item of whatever length; 13 tokens in a row have six.
RUN = 6
BITMAP_BITS = 24

UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ton tons tonne tonnes "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days "
    "week weeks month months year years percent degree degrees c f k mph kmh kph hz khz mhz ghz w kw mw v kv a "
    "j kj cal kcal pa kpa bar usd eur gbp dollar dollars cent cents euro euros pound pounds"
)

LITERAL, NUMBER, NAME, UNIT = range(4)
_TYPED = W.mix(np.arange(90001, 90005, dtype=np.uint64))


def _unit_values() -> np.ndarray:
    values, _ = W.words(pa.array([UNITS]))
    return np.unique(values)


#: Forms of a text's windows: placeholders, lower-cased words only, placeholders at the start of sentences too.
TYPED, PLAIN, LED = range(3)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a batch: fingerprint, kind, text, names that begin a sentence, and the words before each text."""
    data, off = W.utf8(column)
    starts, ends, counts = W.spans(data, off)
    value = W.fingerprints(W.lowered(data), starts, ends)
    n = len(starts)
    text = np.repeat(np.arange(len(off) - 1), np.diff(counts))
    kind = np.full(n, LITERAL)
    if not n:
        return value, kind, text, np.zeros(0, bool), counts
    same = np.concatenate([[False], text[1:] == text[:-1]])
    before = np.concatenate([[0], ends[:-1]])
    gap = starts - before

    def byte(at: np.ndarray) -> np.ndarray:
        return np.where(at < len(data), data[np.minimum(at, len(data) - 1)], 0)

    first, second, third = byte(starts), byte(starts + 1), byte(starts + 2)
    small = lambda b: ((b >= 97) & (b <= 122)) | (b >= 0xC3)
    wide = (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    capital = ((first >= 65) & (first <= 90) & small(second) & (ends - starts > 1)) | (wide & small(third))
    inside = ((gap == 1) & (byte(before) == 32)) | ((gap == 2) & (byte(before) == 44) & (byte(before + 1) == 32))
    kind[capital & same & inside] = NAME
    kind[(first >= 48) & (first <= 57)] = NUMBER
    after_number = np.concatenate([[False], kind[:-1] == NUMBER]) & same
    kind[after_number & (kind == LITERAL) & np.isin(value, _unit_values())] = UNIT
    of_text = W.mix(value + W.mix(text.astype(np.uint64)))
    leads = capital & (kind == LITERAL)
    leads[leads] = np.isin(of_text[leads], of_text[kind == NAME])
    return value, kind, text, leads, counts


def templates(words: tuple, form: int = TYPED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens of a batch's words, their slot values (0 for words), and the tokens before each text.

    In the plain form the tokens are the lower-cased words, and a name is one like any other. In the form with names
    at the start of sentences only texts that have such names have tokens.
    """
    value, kind, text, leads, counts = words
    if form == PLAIN:
        return value, np.where((kind == NUMBER) | (kind == UNIT), value, 0), counts
    if form == LED:
        led = np.zeros(len(counts) - 1, bool)
        led[text[leads]] = True
        kind = np.where(leads, NAME, kind)[led[text]]
        counts = np.concatenate([[0], np.cumsum(np.where(led, np.diff(counts), 0))])
        value, text = value[led[text]], text[led[text]]
    n = len(value)
    if not n:
        return value, value, counts
    same = np.concatenate([[False], text[1:] == text[:-1]])
    goes_on = same & ((kind == NUMBER) | (kind == NAME)) & np.concatenate([[False], kind[1:] == kind[:-1]])
    if form == LED:  # a name at the start of a sentence doesn't go on with the name before it
        goes_on &= ~leads[np.isin(words[2], text)]
    head = np.flatnonzero(~goes_on)
    run = np.arange(n) - head[np.cumsum(~goes_on) - 1]
    slot = np.add.reduceat(W.mix(value + run.astype(np.uint64)), head)
    kind, value = kind[head], value[head]
    slot[kind == LITERAL] = 0
    value = np.where(kind == LITERAL, value, _TYPED[kind])
    return value, slot, np.searchsorted(head, counts)


def _windows(sizes: list[int], bitmap: np.ndarray | None, shorter: bool):
    """Windows as rows: id, window, place in the text, size, windows of the text, slots (none in plain ones), form.

    ``sizes`` has what sizes are made of each text; ``shorter``: a text with fewer tokens is one window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.pieces(batch, "text"):
                words = tokens(part["text"])
                for form in (TYPED, PLAIN, LED):
                    value, slot, counts = templates(words, form)
                    word = np.concatenate([[0], np.cumsum(slot == 0)])
                    per_text = np.diff(counts)
                    for size in sizes:
                        window, at, text = W.windows(value, counts, size)
                        window = W.mix(window + np.uint64(form)) if form else window
                        length = np.minimum(size, per_text[text])
                        keep = (2 * (word[at + length] - word[at]) >= length) & (shorter | (length == size))
                        if bitmap is not None:
                            bit = window & np.uint64((1 << BITMAP_BITS) - 1)
                            keep &= (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
                        made = np.bincount(text[keep], minlength=len(per_text))
                        window, at, text, length = window[keep], at[keep], text[keep], length[keep]
                        slots = np.zeros_like(length) if form == PLAIN else length
                        ends = np.concatenate([[0], np.cumsum(slots)])
                        inner = np.repeat(at - ends[:-1], slots) + np.arange(ends[-1])
                        yield pa.record_batch(
                            {
                                "id": part["id"].take(pa.array(text)),
                                "window": pa.array(window.view(np.int64)),
                                "at": pa.array(at - counts[text]),
                                "size": pa.array(length.astype(np.int32)),
                                "of": pa.array(made[text].astype(np.int32)),
                                "slots": pa.ListArray.from_arrays(
                                    pa.array(ends, pa.int32()), pa.array(slot[inner].view(np.int64))
                                ),
                                "form": pa.array(np.full(len(at), form, np.int32)),
                            }
                        )

    return run


_SCHEMA = "id long, window long, at long, size int, of int, slots array<long>, form int"


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")
    )


def _bitmap(items: DataFrame) -> np.ndarray:
    """Bits of the benchmark's windows: 2 MB, of which at most 262,144 words come to the driver."""
    bit = F.col("window").bitwiseAND((1 << BITMAP_BITS) - 1)
    words = (
        items.select(F.shiftright(bit, 6).alias("word"), bit.bitwiseAND(63).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    item: str = "item_id",
    text: str = "text",
    share: float = SHARE,
    run: int = RUN,
) -> DataFrame:
    """A row for each document and item it holds: ``key``, ``item``, n_windows, coverage, exact.

    ``exact`` is true if no slot has another value than the item's.
    """
    shared_folder(docs.sparkSession)
    items = cut_lineage(_rows(benchmark, item, text).mapInArrow(_windows([WINDOW], None, True), _SCHEMA))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most WINDOW numbers
    bitmap = _bitmap(items)
    found = _rows(docs, key, text).mapInArrow(_windows(sizes, bitmap, False), _SCHEMA)
    items = items.select(
        "window", "size", "form", F.col("id").alias("item"), F.col("at").alias("item_at"), F.col("of").alias("item_of"), F.col("slots").alias("item_slots")
    )
    matched = cut_lineage(
        found.select("id", "window", "size", "form", "at", "slots")
        .join(items.hint("merge"), ["window", "size", "form"])
        .withColumn("apart", F.col("at") - F.col("item_at"))
    )
    where = ["id", "item", "form", "apart"]
    slots = matched.select(*where, F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).filter("s.slots <> 0")
    slots = slots.select(*where, F.col("s.item_slots").alias("a"), F.col("s.slots").alias("b")).distinct()
    wrong = (
        slots.groupBy(*where)
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("x"), F.countDistinct("b").alias("y"))
        .filter("n <> x OR n <> y")
    )
    changed = slots.filter("a <> b").select("id", "item").distinct().withColumn("changed", F.lit(True))
    # a window with the item's own values counts in any alignment; a plain one has no slots
    own = F.col("slots") == F.col("item_slots")
    counted = matched.join(wrong.select(*where, F.lit(True).alias("bad")), where, "left").filter(F.col("bad").isNull() | own)
    places = counted.groupBy("id", "item", "form", "item_at").agg(F.max("item_of").alias("item_of"))
    total = places.groupBy("id", "item", "form").agg(F.count(F.lit(1)).alias("n_windows"), F.max("item_of").alias("item_of"))
    # of templates and plain windows, those that cover more, among the ones that report
    most = F.max(F.struct((F.col("n_windows") / F.col("item_of")).alias("share"), "n_windows", "item_of")).alias("most")
    return (
        total.filter((F.col("n_windows") >= share * F.col("item_of")) | (F.col("n_windows") >= run))
        .groupBy("id", "item")
        .agg(most)
        .select("id", "item", "most.n_windows", "most.item_of")
        .join(changed, ["id", "item"], "left")
        .select(
            F.col("id").alias(key),
            F.col("item").alias(item),
            "n_windows",
            (F.col("n_windows") / F.col("item_of")).alias("coverage"),
            F.col("changed").isNull().alias("exact"),
        )
    )
