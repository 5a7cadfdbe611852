"""Naive-Bayes support vectors: indicators of n-grams, scaled by log-count ratios, in a linear hinge loss.

Features are the byte n-grams of one to four bytes, hashed into a fixed number of bins; a text has a bin
or hasn't. The model is fitted on the first ``rows`` labelled texts in the order of a hash of their ids,
so the sample is bounded by a parameter and doesn't depend on the partitions. Every text is scored, as a
whole, in one pass without a shuffle.

Null text is the empty text. Labels other than 0 and 1, and labels of ids without a text, don't count; an
id with several labels has the largest. With no labels of both kinds every score is the share of label 1
among those there are, or 0.5 without any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from corpusloom.llm import words as W


@dataclass(frozen=True)
class Settings:
    rows: int = 6000
    bits: int = 18
    orders: int = 4
    cost: float = 1.0
    smoothing: float = 1.0
    epochs: int = 15
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """Weight of each bin in the sum and in its square, and the curve from margins to scores."""

    settings: Settings
    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, bins: np.ndarray) -> float:
        margin = self.bias + self.weight[bins].sum() / max(np.sqrt(self.square[bins].sum()), 1e-9)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35))))


def bins_of(data: np.ndarray, settings: Settings, last: np.ndarray) -> np.ndarray:
    """The distinct bins of one text's n-grams. ``last`` is a work array of one number per bin."""
    found = []
    for at in range(0, len(data), W.PIECE):
        part = data[at : at + W.PIECE + settings.orders - 1]
        value = np.zeros(len(part), np.uint32)
        for n in range(1, min(settings.orders, len(part)) + 1):
            value = value[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :] + np.uint32(n)
            spread = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            spread = (spread ^ (spread >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            found.append(_distinct(spread >> np.uint32(32 - settings.bits), last))
    return _distinct(np.concatenate(found) if found else np.zeros(0, np.uint32), last)


def _distinct(bins: np.ndarray, last: np.ndarray) -> np.ndarray:
    place = np.arange(len(bins), dtype=np.int32)
    last[bins] = place
    return bins[last[bins] == place]


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    for part in W.pieces(batch, column):
        data, off = W.utf8(part.column(column))
        for a, b in zip(off[:-1], off[1:], strict=True):
            yield data[a:b]


def labelled_ids(labels: DataFrame, label: str, rows: int, key: str = "doc_id", seed: int = 7) -> DataFrame:
    """Columns id and label of at most ``rows`` labelled ids."""
    return (
        labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("id"))
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.lit(seed), "id"), "id")
        .limit(rows)
    )


def labelled(docs: DataFrame, labels: DataFrame, label: str, settings: Settings, key="doc_id", text="text") -> DataFrame:
    """The texts and labels of the sample. Its ids are bounded in number, so they are broadcast."""
    chosen = labelled_ids(labels, label, settings.rows, key, settings.seed)
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("id", "text", "label")


def fit(sample: DataFrame, settings: Settings) -> Model | float:
    """The model of a bounded sample with the columns id, text and label, or a constant score."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.empty(1 << settings.bits, np.int32)
        for batch in batches:
            for part in W.pieces(batch, "text"):
                bins = [bins_of(x, settings, last).astype(np.int32).tobytes() for x in _texts(part, "text")]
                yield pa.record_batch({"id": part["id"], "label": part["label"], "bins": pa.array(bins, pa.binary())})

    schema = StructType(
        [sample.schema["id"], StructField("label", IntegerType()), StructField("bins", BinaryType())]
    )
    rows = sample.mapInArrow(features, schema).toArrow().sort_by([("id", "ascending")])
    y = np.where(rows["label"].to_numpy() == 1, 1.0, -1.0)
    x = [np.frombuffer(b.as_py(), np.int32) for b in rows["bins"]]
    if not len(y) or abs(y.sum()) == len(y):
        return float((y > 0).mean()) if len(y) else 0.5
    ratio = _log_count_ratios(x, y, settings)
    rng = np.random.default_rng(settings.seed)
    held = rng.random(len(y)) < 0.25
    held &= (np.bincount((y[~held] > 0).astype(int), minlength=2).min() > 0) & (len(y) >= 40)
    fitted = np.flatnonzero(~held)
    weight, bias = _dual_descent(x, y, ratio, fitted, settings, rng)
    model = Model(settings, weight * ratio, ratio**2, bias, 1.0, 0.0)
    held = np.flatnonzero(held) if held.any() else fitted
    margins = np.array([_margin(model, x[i]) for i in held])
    slope, shift = _curve(margins, y[held] > 0)
    every = np.arange(len(y))
    weight, bias = _dual_descent(x, y, ratio, every, settings, rng)
    return Model(settings, (weight * ratio).astype(np.float32), (ratio**2).astype(np.float32), bias, slope, shift)


def _margin(model: Model, bins: np.ndarray) -> float:
    return model.bias + model.weight[bins].sum() / max(np.sqrt(model.square[bins].sum()), 1e-9)


def _log_count_ratios(x: list[np.ndarray], y: np.ndarray, settings: Settings) -> np.ndarray:
    counts = np.full((2, 1 << settings.bits), settings.smoothing)
    for bins, label in zip(x, y, strict=True):
        counts[int(label > 0), bins] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def _dual_descent(x, y, ratio, rows, settings: Settings, rng) -> tuple[np.ndarray, float]:
    """Dual coordinate descent of the hinge loss; each text's scaled indicators have length one."""
    weight, bias = np.zeros(len(ratio)), 0.0
    # lengths only: the scaled values of all texts would fill the driver
    length = {i: max(np.sqrt((ratio[x[i]] ** 2).sum()), 1e-9) for i in rows}
    share = {s: settings.cost * len(rows) / (2 * max(1, (y[rows] == s).sum())) for s in (1.0, -1.0)}
    alpha = np.zeros(len(y))
    for _ in range(settings.epochs):
        for i in rng.permutation(rows):
            values = ratio[x[i]] / length[i]
            slope = y[i] * (weight[x[i]] @ values + bias) - 1
            new = min(max(alpha[i] - slope / 2, 0.0), share[y[i]])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weight[x[i]] += step * values
                bias += step
                alpha[i] = new
    return weight, bias


def _curve(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to the probability of label 1."""
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        w = p * (1 - p) + 1e-9
        gradient = np.array([((p - target) * margins).sum(), (p - target).sum()])
        hessian = np.array([[(w * margins**2).sum(), (w * margins).sum()], [(w * margins).sum(), w.sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(hessian + 1e-6 * np.eye(2), gradient)
    return float(max(a, 1e-3)), float(b)


def score(docs: DataFrame, model: Model | float, text: str = "text", to: str = "score") -> DataFrame:
    """Adds the score of each whole text, between 0 and 1; a column of the name ``to`` is replaced."""
    if isinstance(model, float):
        return docs.withColumn(to, F.lit(model))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def scores(column: pa.Array) -> pa.Array:
        own = shared.value
        last = np.empty(1 << own.settings.bits, np.int32)
        batch = pa.record_batch({"text": column})
        return pa.array([own.score(bins_of(x, own.settings, last)) for x in _texts(batch, "text")], pa.float64())

    return docs.withColumn(to, scores(F.col(text).cast("string")))


def remainder(key: str, of: int):
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(of))
