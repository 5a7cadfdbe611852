"""Quality rules judged by host: failures are counted per host, rates shrunk, verdicts joined back.

One document that fails a rule says little; a host most of whose documents fail says a lot about the rest of
them too. So each rule's failures are summed up per host. A host with few documents has an unreliable rate, which
is drawn towards the mean of all hosts: the rates are taken for draws from a beta distribution, whose spread is
estimated from the counts of all hosts by moments (weights proportional to the documents), and a host's rate is
the posterior mean. A host is rejected if one rule's rate exceeds ``most``; its documents go with it.

Texts are measured row by row and never shuffled. What is shuffled are counts, summed up per task, and the narrow
measures if the table of hosts is too large to be broadcast; a hot host is then a skewed join, which Spark splits.

Rows: null text has no words; null hosts are one host; ids are passed on as they are, so null and repeated ids
are no matter; equal rows are counted each, as every row is a document; no other column is read, so extra ones may
have any name. A text that is a single very long word, or long beyond a batch, is measured alone. An empty table
gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import words as W
from corpusloom.llm.components import stored

#: Words of a window, for repeated passages.
WINDOW = 8

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Settings:
    """Limits of the rules (a document fails beyond them) and of a host's rates."""

    least_words: int = 20
    repeated_percent: int = 30
    symbols_percent: int = 10
    dup_lines_percent: int = 30
    least_word_chars: int = 2
    #: A host is rejected if its shrunk rate of failures of one rule exceeds this.
    most: float = 0.5
    #: The prior weighs as much as so many documents at least: with few failures or hosts its spread is a guess,
    #: and a host of one or two documents must not be judged by them alone.
    least_weight: float = 10.0


def rules(settings: Settings) -> dict[str, Column]:
    """The rules by name, as conditions under which a measured document fails.

    ``base`` decides on a document by itself as well; the others only count for its host.
    """
    n = F.col("n_words")
    return {
        "base": (n < settings.least_words) | (100 * F.col("n_repeat_words") > settings.repeated_percent * n),
        "symbols": 100 * F.col("n_symbols") > settings.symbols_percent * n,
        "lines": 100 * F.col("n_dup_lines") > settings.dup_lines_percent * F.col("n_lines"),
        "letters": F.col("word_chars") < settings.least_word_chars * n,
    }


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[off])


def repeated_words(values: np.ndarray, counts: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Words of each text inside windows that occur twice or more in it, the first occurrence included."""
    windows, first, text = W.windows(values, counts, size)
    whole = counts[1:][text] - first >= size
    windows, first, text = windows[whole], first[whole], text[whole]
    order = np.lexsort((windows, text))
    again = (windows[order][1:] == windows[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= again
    twice[:-1] |= again
    starts = first[order[twice]]
    edges = np.zeros(len(values) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return _sums(np.cumsum(edges)[:-1] > 0, counts)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts the rules look at, for each text of a batch."""
    data, off = W.utf8(texts)
    starts, ends, counts = W.spans(data, off, _IS_WORD)
    values = W.fingerprints(data, starts, ends, _IS_WORD)
    lines, dup_lines = np.zeros((2, len(off) - 1), np.int64)
    for i in range(len(off) - 1):
        times = Counter(data[off[i] : off[i + 1]].tobytes().split(b"\n"))
        filled = [n for line, n in times.items() if line.strip()]
        lines[i] = sum(filled)
        dup_lines[i] = lines[i] - len(filled)
    first_bytes = _IS_WORD[data] & ((data & 0xC0) != 0x80)
    return {
        "n_words": np.diff(counts),
        "word_chars": _sums(first_bytes, off),
        "n_symbols": _sums(_IS_SYMBOL[data], off),
        "n_lines": lines,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeated_words(values, counts),
    }


def measures(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """``key``, ``host`` and the counts of every row; row-local."""
    narrow = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    schema = f"key {kinds['key']}, host {kinds['host']}, " + ", ".join(f"{c} long" for c in _COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.pieces(batch, "text"):
                found = measure(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("host"), *(pa.array(found[c]) for c in _COUNTS)],
                    names=["key", "host", *_COUNTS],
                )

    return narrow.mapInArrow(run, schema)


def host_rates(measured: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``host, rule, n, failed, rate``: per host and rule the documents, failures and the shrunk rate.

    With K hosts, N documents, overall rate p and S = sum of n (rate - p)^2, the share of the variance that lies
    between hosts is (S / p(1-p) - (K-1)) / (N - sum(n^2)/N - (K-1)). The beta prior has the mean p and the weight
    of (1 - share) / share documents, ``least_weight`` at least; without spread the rate is p.
    """
    flags = rules(settings)
    failed = [F.sum(flag.cast("long")).alias(name) for name, flag in flags.items()]
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *failed)
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("failed")) for r in flags]))
    # one row per host and rule from here on
    hosts = hosts.select("host", "n", each.alias("x")).select("host", "n", "x.rule", "x.failed")
    n, x = F.col("n").cast("double"), F.col("failed").cast("double")
    widest = F.lit(1 / (1 + settings.least_weight))
    prior = (
        hosts.groupBy("rule")
        .agg(
            F.count(F.lit(1)).alias("k"), F.sum(n).alias("all"), F.sum(x).alias("bad"),
            F.sum(n * n).alias("squares"), F.sum(x * x / n).alias("spread"),
        )
        .withColumn("p", F.col("bad") / F.col("all"))
        .withColumn(
            "share",
            F.try_divide(
                F.try_divide(F.col("spread") - F.col("bad") * F.col("p"), F.col("p") * (1 - F.col("p")))
                - (F.col("k") - 1),
                F.col("all") - F.col("squares") / F.col("all") - (F.col("k") - 1),
            ),
        )
        .select("rule", "p", F.greatest(F.lit(0.0), F.least(widest, F.coalesce("share", F.lit(0.0)))).alias("share"))
    )
    # four rows on the right
    weight = F.try_divide(n * F.col("share"), n * F.col("share") + 1 - F.col("share"))
    rate = F.col("p") + weight * (x / n - F.col("p"))
    return hosts.join(F.broadcast(prior), "rule").select("host", "rule", "n", "failed", rate.alias("rate"))


def host_verdicts(measured: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``host, host_kept, worst_rule, worst_rate``."""
    worst = F.max(F.struct("rate", "rule"))
    return (
        host_rates(measured, settings).groupBy("host").agg(worst.alias("worst"))
        .select("host", (F.col("worst.rate") <= settings.most).alias("host_kept"),
                F.col("worst.rule").alias("worst_rule"), F.col("worst.rate").alias("worst_rate"))
    )


def judge(
    docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", host: str = "source", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``key, host``, counts, ``base_failed``, the host's verdict and ``kept``."""
    measured = stored(measures(docs, key, host, text), "measures")
    verdicts = host_verdicts(measured, settings).withColumnRenamed("host", "of")
    judged = measured.join(verdicts, F.col("host").eqNullSafe(F.col("of")), "left")
    base = rules(settings)["base"]
    return judged.select(
        F.col("key").alias(key), F.col("host"), *_COUNTS, base.alias("base_failed"),
        "host_kept", "worst_rule", "worst_rate", (~base & F.col("host_kept")).alias("kept"),
    )
