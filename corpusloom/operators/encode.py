"""Encoding texts to token ids and decoding them."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import SPECIAL_TOKENS, UNK
from corpusloom.functions.text import RAW_BYTES, SHOWN_BYTES, encodable_words, read_bytes
from corpusloom.operators.merging import LONGEST, Ranks, lists, merge


#: Words of a batch that are looked up or segmented at once, which bounds what a task holds beside its batch.
WORDS_AT_ONCE = 1 << 18


def _per_word(ids_of: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
    """Arrow UDF from words to ids that spells each distinct word of a stretch of a batch once.

    ``ids_of`` gives the ids of words one after the other, and where each word's begin. Beside the batch, which Spark
    bounds in rows and bytes, there are its ids once and one stretch.
    """

    @F.arrow_udf("array<int>")
    def encode(batch):
        word_ends = np.concatenate(([0], np.cumsum(pc.list_value_length(batch).to_numpy(zero_copy_only=False))))
        words, made = batch.flatten(), array("i")
        ends = np.zeros(len(word_ends), np.int32)
        for at in range(0, len(words), WORDS_AT_ONCE):
            coded = words.slice(at, WORDS_AT_ONCE).dictionary_encode()
            ids, begins = ids_of(coded.dictionary)
            places = coded.indices.to_numpy()
            counts = np.diff(begins)[places]
            before = np.concatenate(([0], np.cumsum(counts)))
            # the rows that end in this stretch
            low, high = np.searchsorted(word_ends, [at, at + len(places)], side="right")
            ends[low:high] = len(made) + before[word_ends[low:high] - at]
            # each word's ids, from where they begin
            inside = np.arange(before[-1]) - np.repeat(before[:-1], counts)
            made.frombytes(ids[np.repeat(begins[:-1][places], counts) + inside].astype(np.int32, copy=False).view(np.uint8))
        return lists(np.frombuffer(made, np.int32), ends)

    return encode


#: A longer word is known by its digest, so a vocabulary's bytes are bounded by its rows.
WORD_BYTES = 64


def _word_key(word: Column) -> Column:
    return F.when(F.octet_length(word) <= WORD_BYTES, word).otherwise(F.concat(F.lit("\0"), F.sha2(word, 256)))


def _slot(word: Column, n_slots: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(n_slots)).cast("int")


def id_table(vocab: DataFrame) -> tuple[Column, int]:
    """Maps from words to ids, one per slot, as one array through a scalar subquery; and the number of slots.

    A word's slot is its hash, and there are as many slots as words, so a lookup compares a word or two however
    large the vocabulary is. Passes the driver: as many rows as the vocabulary's settings allow, and at most 65 bytes
    of a word and its id in each, however long its words are.
    """
    n_slots, token = max(vocab.count(), 1), F.col("token")
    rows = vocab.filter(token.isNotNull()).select(_slot(token, n_slots).alias("slot"), _word_key(token).alias("key"), "id")
    slots: list[dict[str, int]] = [{} for _ in range(n_slots)]
    for slot, key, at in zip(*rows.toArrow().to_pydict().values(), strict=True):
        slots[slot][key] = at
    maps = pa.array([[list(slot.items()) for slot in slots]], pa.list_(pa.map_(pa.string(), pa.int32())))
    return vocab.sparkSession.createDataFrame(pa.table({"ids": maps})).scalar(), n_slots


def word_encoder(vocab: DataFrame):
    """Adds ids of a word-level vocabulary to a frame, whatever the vocabulary's size.

    Words are looked up row by row by Spark's own expressions, so no row goes to a Python worker.
    """
    table, n_slots = id_table(vocab)

    def encode(df: DataFrame, words: dict[str, Column]) -> DataFrame:
        # one table for each, beside its words: both are used once, so the optimizer puts them in place and no row
        # carries the table
        def ids_of(i):
            def look_up(word):
                found = F.try_element_at(F.get(F.col(f"__table_{i}"), _slot(word, n_slots)), _word_key(word))
                return F.coalesce(found, F.lit(UNK))

            # always so, but not known to be: the optimizer would copy the whole lookup into each filter on ids
            return F.when(F.spark_partition_id() >= 0, F.transform(f"__words_{i}", look_up))

        used = {f"__words_{i}": column for i, column in enumerate(words.values())}
        used |= {f"__table_{i}": table for i in range(len(words))}
        return df.withColumns(used).withColumns({name: ids_of(i) for i, name in enumerate(words)}).drop(*used)

    return encode


def bpe_encoder(
    char_ids: dict[str, int],
    merges: list[tuple[int, int, int]],
    byte_level: bool,
    specials: Sequence[str] = SPECIAL_TOKENS,
):
    """Adds token ids to a frame by an Arrow UDF. The distinct words of a stretch are segmented together, long ones alone.

    Byte-level words come in plain spelling and are spelled in bytes here, once each.
    Driver-side input is the vocabulary and merge list, bounded by the vocabulary size.
    """
    # a pair learned twice counts at its later place
    rank_of = {(left, right): (rank, new) for rank, (left, right, new) in enumerate(merges)}
    special_ids = {token: i for i, token in enumerate(specials)}
    unknown = UNK
    ranks: list[Ranks] = []
    shown = {b: chr(b) for b in range(256)} | dict(zip(map(ord, RAW_BYTES), SHOWN_BYTES))
    byte_ids = [char_ids.get(shown[b], unknown) for b in range(256)]

    def segment(syms: list[int]) -> list[int]:
        import heapq

        after = list(range(1, len(syms))) + [-1]
        before = list(range(-1, len(syms) - 1))
        queue = []

        def offer(i):
            j = after[i]
            if j >= 0 and (syms[i], syms[j]) in rank_of:
                queue.append((rank_of[syms[i], syms[j]][0], i, syms[i], syms[j]))
                return True
            return False

        for i in range(len(syms) - 1):
            offer(i)
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            # skip entries whose symbols have been merged since
            if syms[i] != left or j < 0 or syms[j] != right:
                continue
            syms[i] = rank_of[left, right][1]
            syms[j] = -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            for k in (before[i], i):
                if k >= 0 and offer(k):
                    heapq.heappush(queue, queue.pop())
        return [s for s in syms if s >= 0]

    def spelled(words) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of words one after the other, and where each word begins."""
        if byte_level:
            large = words.cast(pa.large_binary())
            off = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
            data = np.frombuffer(large.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
            return np.array(byte_ids, np.int32)[data], off - off[0]
        off = np.concatenate(([0], np.cumsum(pc.utf8_length(words).to_numpy())))
        points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
        distinct, place = np.unique(points, return_inverse=True)
        return np.array([char_ids.get(chr(c), unknown) for c in distinct], np.int32)[place], off

    def ids_of(words):
        if not ranks:
            ranks.append(Ranks(rank_of, in_order=False))
        syms, off = spelled(words)
        sizes = np.diff(off)
        alone = {int(i): segment(syms[off[i] : off[i + 1]].tolist()) for i in np.flatnonzero(sizes > LONGEST)}
        marks = pc.index_in(words, value_set=pa.array(specials, words.type)).to_pylist() if len(specials) else []
        alone |= {i: [special_ids[specials[k]]] for i, k in enumerate(marks) if k is not None}
        if not alone:
            return merge(syms, off, ranks[0])[:2]
        others = np.ones(len(sizes), bool)
        others[list(alone)] = False
        sizes[~others] = 0
        ids, begins, _ = merge(syms[np.repeat(others, np.diff(off))], np.concatenate(([0], np.cumsum(sizes))), ranks[0])
        # the others' ids, and after them those of the words that were done alone, in the words' order
        counts = np.diff(begins)
        which = np.concatenate([np.repeat(np.arange(len(counts)), counts), *[np.full(len(x), i) for i, x in alone.items()]])
        ids = np.concatenate([ids, *[np.array(x, np.int32) for x in alone.values()]])
        ends = np.cumsum(np.bincount(which, minlength=len(words)))
        return ids[np.argsort(which, kind="stable")], np.concatenate(([0], ends))

    spell = _per_word(ids_of)
    return lambda df, words: df.withColumns({name: spell(column) for name, column in words.items()})


def encode_texts(
    df: DataFrame,
    encoder,
    texts: dict[str, str],
    pre_tokenizer: str = "byte-level",
    normalize: bool = True,
) -> DataFrame:
    """Add one id array per entry of ``texts``. Row-local: no shuffle, whatever the word skew."""
    words = {
        name: encodable_words(F.col(source), pre_tokenizer, normalize, spelled=False)
        for name, source in texts.items()
    }
    return encoder(df, words)


def token_array(vocab: DataFrame) -> Column:
    """The vocabulary's tokens by id as one array, through a scalar subquery."""
    entries = F.sort_array(F.collect_list(F.struct("id", "token")))
    return vocab.agg(entries["token"].alias("tokens")).scalar()


def decode(df: DataFrame, vocab: DataFrame, ids: str, byte_level: bool, out: str = "text") -> DataFrame:
    """Tokens of ``ids`` in text order without specials, joined by blanks or as decoded bytes.

    An id is a place in the token array, so decoding is a row-local array access.
    """
    kept = F.filter(ids, lambda i: i >= len(SPECIAL_TOKENS))
    tokens = F.transform(kept, lambda i: F.get(F.col("__tokens"), i))
    joined = F.array_join(tokens, "" if byte_level else " ")
    return (
        df.withColumn("__tokens", token_array(vocab))
        .withColumn(out, read_bytes(joined) if byte_level else joined)
        .drop("__tokens")
    )
