"""Ranked lexical search by the Best Position Algorithm, exact, for a table of items against all documents.

A document's score for an item is the sum of its terms' impacts (a whole-number form of BM25), so each term of
an item is a list of documents by falling impact. The algorithm reads the lists from the top side by side. A
document met in one list is looked up in all others at once (direct access), which gives its whole score *and* its
places there. A list's best position is the end of the run of places seen without a gap, however they were
seen, so it is at least as deep as the last place read. What has not been seen at all scores at most the sum of
the impacts that follow the best positions. When that falls strictly below the k-th score, no other document can
enter, nor tie with a smaller id, and reading ends.

How it is spread: documents are counted first (N, L and the document frequencies of the items' terms) and their
counts of the items' terms written, narrow. Then every task goes through its documents in blocks with impact lists
of their own, keeps the k best of each item so far, and lets them end the reading of the blocks that follow. So the
list of a term that a third of all documents hold is spread over all tasks, nothing grows with a list, and only k
rows per item and task are shuffled. Items come in groups of bounded size, which is what a task gets of them; each
group is another pass.

Rows: null text has no terms; a document without terms is no document of the statistics. Repeated rows of documents
are documents each; equal scores with equal ids keep any order. A null id of a document comes after all others.
Repeated rows of an item are one row; an item_id with several texts is one item with the terms of all; a null
item_id is an item. Items without terms, and an empty table on either side, give no rows. A text of any length is
counted whole, as one row. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as Win

from corpusloom.llm.components import stored
from corpusloom.operators.order import HASHED, sum_before

#: Bytes of item texts in a group, which every task holds; one item is never divided.
GROUP_BYTES = 1 << 20
#: Cells of a block's table of direct accesses (terms x documents), and the documents of a block.
CELLS, MOST_DOCS, LEAST_DOCS = 1 << 23, 4096, 64
#: Places read of each list before the first look at the bound; doubled after each look.
FIRST_READ = 8

_LAST = 2**63 - 1
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# beyond ASCII every byte of a character is a byte of a term
_TERM_BYTES = re.compile(_TERM.encode())


def terms(text: bytes) -> list[bytes]:
    return _TERM_BYTES.findall(text.lower())


@dataclass(frozen=True)
class Queries:
    """Items of a group: ids, the vocabulary, and per item its terms (by number) and their repeats."""

    ids: list
    vocabulary: list[bytes]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``group, item, term, n``: terms of the items with their repeats, items dealt into bounded groups."""
    rows = items.select(F.col(item).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    sized = rows.groupBy("item").agg(F.sum(F.octet_length("text")).alias("bytes"))
    sized = sized.withColumn("place", F.shiftrightunsigned(F.xxhash64("item"), 4))
    dealt = sum_before(sized, "place", "bytes", ties=["item"], shifts=HASHED)
    dealt = dealt.select("item", F.floor(F.col("before") / GROUP_BYTES).alias("group"))
    lower = F.translate("text", _CAPITALS, _CAPITALS.lower())
    found = rows.select("item", F.explode(F.regexp_extract_all(lower, F.lit(_TERM), 0)).alias("term"))
    counted = found.groupBy("item", "term").agg(F.count(F.lit(1)).alias("n"))
    dealt = dealt.withColumnRenamed("item", "of")
    return counted.join(dealt, F.col("item").eqNullSafe(F.col("of"))).select("group", "item", "term", "n")


def queries(rows: list) -> Queries:
    """One group's rows as arrays."""
    vocabulary = sorted({r.term.encode() for r in rows})
    number = {t: i for i, t in enumerate(vocabulary)}
    by_item: dict = {}
    for r in rows:
        by_item.setdefault(r.item, []).append((number[r.term.encode()], r.n))
    found = [np.array(sorted(x), np.int64).T for x in by_item.values()]
    return Queries(list(by_item), vocabulary, [x[0] for x in found], [x[1] for x in found])


def counts(docs: DataFrame, vocabulary: list[bytes], key: str, text: str) -> DataFrame:
    """``doc_id, n, terms, times`` for each document with a term: all its terms with repeats, and the
    vocabulary's numbers and repeats in it. Row-local."""
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    narrow = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("doc_id"),
                         F.col(text).cast("binary").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()),
                        ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = known.value
        for batch in batches:
            sizes, held, times = [], [], []
            for value in batch.column("text"):
                found = terms(value.as_py() or b"")
                sizes.append(len(found))
                mine = [(numbers[t], n) for t, n in Counter(found).items() if t in numbers]
                held.append([i for i, _ in mine])
                times.append([n for _, n in mine])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(held, schema.field(2).type),
                 pa.array(times, schema.field(3).type)], schema=schema)

    found = narrow.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>")
    return stored(found.filter("n > 0"), "terms")


class Block:
    """Impact lists of a block of documents, and the table for direct accesses."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], np.append(impact[order], 0)
        self.bounds = np.searchsorted(term[order], np.arange(n_terms + 1))
        #: where a document stands in a term's list; the last place of all, of impact 0, if it doesn't
        self.place = np.full((n_terms, n_docs), len(order), np.int32)
        self.place[term[order], self.doc] = np.arange(len(order))
        self.n_docs = n_docs

    def best(self, terms: np.ndarray, repeats: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents of the block that may be among the ``k`` best, their scores, and the places read.

        ``floor`` is the k-th score found elsewhere (0 if there are fewer); documents below it are no matter.
        """
        start, end = self.bounds[terms], self.bounds[terms + 1]
        terms, repeats, start, end = (x[end > start] for x in (terms, repeats, start, end))
        shift = np.concatenate([[0], np.cumsum(end - start)])
        unseen = np.ones(shift[-1] + 1, bool)  # of all lists' places, one list after the other
        met = np.zeros(self.n_docs, bool)
        docs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        position, read, step, kth = start.copy(), start.copy(), FIRST_READ, floor
        while True:
            following = np.where(position < end, self.impact[np.minimum(position, len(self.impact) - 1)], 0)
            bound = int((following * repeats).sum())
            if bound <= 0 or bound < kth:
                break
            until = np.minimum(np.maximum(read, position) + step, end)
            places = np.concatenate([np.arange(a, b) for a, b in zip(np.maximum(read, position), until)])
            read, step = until, step * 2
            fresh = np.unique(self.doc[places])
            fresh = fresh[~met[fresh]]
            met[fresh] = True
            found = self.place[terms][:, fresh]
            score = (self.impact[found] * repeats[:, None]).sum(0)
            held = found < len(self.doc)
            unseen[(found + (shift[:-1] - start)[:, None])[held]] = False
            docs.append(fresh)
            scores.append(score)
            # the end of the run of seen places in each list
            gaps = np.flatnonzero(unseen)
            gap = gaps[np.searchsorted(gaps, position - start + shift[:-1])]
            position = np.minimum(gap - shift[:-1] + start, end)
            if sum(map(len, scores)) >= k:
                every = np.concatenate(scores)
                kth = max(floor, int(np.partition(every, -k)[-k]))
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        keep = (scores > 0) & (scores >= kth)
        return docs[keep], scores[keep], int((read - start).sum())


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def _blocks(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list, np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        held = part.column("terms")
        lengths = np.diff(held.offsets.to_numpy())
        yield (part.column("doc_id").to_numpy(), np.repeat(np.arange(len(lengths)), lengths),
               part.column("n").to_pylist(), held.flatten().to_numpy().astype(np.int64),
               part.column("times").flatten().to_numpy())


def search(counted: DataFrame, asked: Queries, k: int) -> DataFrame:
    """``item, doc_id, score``: of each task the ``k`` best documents of each item."""
    totals = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    n_all, l_all = totals.n, totals.l
    # at most one row per term of the group
    df = np.zeros(len(asked.vocabulary), np.int64)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r.term] = r["count"]
    sent = counted.sparkSession.sparkContext.broadcast((asked, weights(df, n_all)))
    size = max(LEAST_DOCS, min(MOST_DOCS, CELLS // max(len(asked.vocabulary), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = sent.value
        best: list[list[tuple[int, int]]] = [[] for _ in asked.ids]
        for batch in batches:
            for ids, doc, n, term, times in _blocks(batch, size):
                length = np.array([25 + (75 * x * n_all) // l_all for x in n], np.int64)
                impact = weight[term] * ((10**9 * times) // (1000 * times + 8 * length[doc]))
                block = Block(doc, term, impact, len(ids), len(asked.vocabulary))
                for i, (own, repeats) in enumerate(zip(asked.terms, asked.repeats)):
                    floor = -best[i][-1][0] if len(best[i]) == k else 0
                    found, scores, _ = block.best(own, repeats, k, floor)
                    if len(found):
                        more = list(zip((-scores).tolist(), ids[found].tolist()))
                        best[i] = sorted(best[i] + more)[:k]
        rows = [(asked.ids[i], doc, -score) for i, found in enumerate(best) for score, doc in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["item", "doc_id", "score"]
        )

    return counted.mapInArrow(run, "item long, doc_id long, score long")


def rank(
    docs: DataFrame, items: DataFrame, k: int = 10,
    key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with a score above 0.

    Ids of both tables are whole numbers.
    """
    spark = docs.sparkSession
    wanted = stored(item_terms(items.withColumn(item, F.col(item).cast("long")), item, item_text), "items")
    groups = [r.group for r in wanted.select("group").distinct().orderBy("group").collect()]
    parts = []
    for group in groups:
        asked = queries(wanted.filter(F.col("group") == group).select("item", "term", "n").collect())
        counted = counts(docs, asked.vocabulary, key, text)
        if not counted.isEmpty():
            parts.append(search(counted, asked, k))
    if not parts:
        parts = [spark.createDataFrame([], "item long, doc_id long, score long")]
    order = Win.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select(
        F.col("item").alias(item), "rank", F.nullif("doc_id", F.lit(_LAST)).alias(key), "score"
    )
