"""Splits, samples and heads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.order import POSITION_BITS, shuffle_key, source_index, unit_hash


def split(
    df: DataFrame, key: str, test_ratio: float = 0.2, eval_ratio: float = 0.5, seed: int = 42
) -> DataFrame:
    """Add ``split``: the held-out share is divided between test and validation by ``eval_ratio``."""
    u = unit_hash(F.col(key), seed)
    held_out = 1.0 - test_ratio
    first_test = held_out + test_ratio * eval_ratio
    return df.withColumn(
        "split",
        F.when(u < held_out, "train").when(u < first_test, "test").otherwise("validation"),
    )


# A histogram has 2^14 cells, and the cell of the cut-off is narrowed until so many keys are left.
CELL_BITS, FEW = 14, 4096


def sample_bound(keys: DataFrame, key: str, n: int, seed: int = 42) -> tuple | None:
    """Shuffle position and key of the last of the first ``n`` keys; None if there are no more than ``n``.

    Keys are counted by cells of their position (one row per cell and task is shuffled), and the cell
    that holds the n-th is divided again. Only the few keys of the last cell are ordered.
    """
    placed = keys.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), shuffle_key(F.col(key), seed).alias("pos"))
    shift, inside, before = POSITION_BITS, placed, 0
    while True:
        shift = max(shift - CELL_BITS, 0)
        cells = inside.groupBy(F.shiftright("pos", shift).alias("cell")).count().collect()
        for cell, count in sorted(map(tuple, cells)):
            if before + count >= n:
                break
            before += count
        else:
            return None
        inside = placed.filter(F.shiftright("pos", shift) == cell)
        if count <= FEW or not shift:
            last = inside.orderBy("pos", "key").limit(n - before).agg(F.max(F.struct("pos", "key")).alias("last"))
            return tuple(last.first().last)


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` rows of a reproducible random order (all rows, if there are fewer).

    The cut-off is found first; rows are then chosen by a filter of the scan, and only the chosen ones
    are put in order. ``key`` is unique, not null.
    """
    if n <= 0:
        return df.limit(0)
    bound = sample_bound(df, key, n, seed)
    chosen = df.filter(F.col(key).isNotNull()).withColumn("__pos", shuffle_key(F.col(key), seed))
    if bound is not None:
        pos, last = bound
        chosen = chosen.filter((F.col("__pos") < pos) | ((F.col("__pos") == pos) & (F.col(key) <= F.lit(last))))
    return chosen.orderBy("__pos", key).select(*df.columns)


def head(records: DataFrame, n: int = 2500, order: tuple[str, str] = ("src", "rec_id")) -> DataFrame:
    """The first ``n`` records in stored order, by numbers of the bare keys, so whole rows never meet in one task."""
    first = source_index(records, *order).filter(F.col("row_index") < n)
    whole = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    kept = first.select(whole.alias("__key"), "row_index")
    joined = records.withColumn("__key", whole).join(kept, "__key")
    return joined.orderBy("row_index").select(*records.columns)


def drop_empty(df: DataFrame, text: str = "text") -> DataFrame:
    """Leave out null and empty texts; blanks count as text."""
    return df.filter(F.col(text).isNotNull() & (F.col(text) != ""))
