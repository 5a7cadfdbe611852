"""Batches of sequences: shuffled or in stored order, padded to the batch maximum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.config import PAD, StageSettings
from corpusloom.functions.permutation import permuted
from corpusloom.functions.sequences import pad_right
from corpusloom.operators.order import (
    POSITION_BITS,
    shuffle_key,
    shuffled_index,
    source_index,
    stored_index,
    sum_before,
)


def _number(df: DataFrame, index: DataFrame, key: tuple[str, ...], size: int) -> DataFrame:
    """The index is numbered on bare keys; the sequences meet it by one join. A null key is a key
    like any other, a repeated one is an error: it would multiply rows."""
    whole = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)])
    rows = F.count(F.lit(1)).over(W.partitionBy("__key"))
    index = index.select(whole.alias("__key"), "row_index").withColumn(
        "row_index",
        F.when(rows > 1, F.raise_error(F.lit("a batch key is not unique")).cast("long")).otherwise(
            F.col("row_index")
        ),
    )
    return df.withColumn("__key", whole).join(index, "__key").select(
        *df.columns,
        F.floor(F.col("row_index") / size).alias("batch_id"),
        (F.col("row_index") % size).cast("int").alias("row_in_batch"),
    )


def batch_train(
    df: DataFrame, key: str, size: int = 8, seed: int = 42, keys: DataFrame | None = None
) -> DataFrame:
    """Batches in a reproducible random order; the short last batch is kept.

    ``key`` is unique. ``keys`` may hold the same keys in a frame that is cheaper to scan than
    ``df``, such as the table that ``df`` was encoded from.
    """
    return _number(df, shuffled_index(df if keys is None else keys, key, seed), (key,), size)


def batch_epoch(
    df: DataFrame, index: str, n: int, size: int = 8, seed: int = 42, epoch: int = 0
) -> DataFrame:
    """Batches in the random order of one epoch, for rows numbered 0..n-1 once (by ``stored_index``).

    The order is arithmetic on the number, so an epoch neither sorts nor joins, and any epoch can be
    made without those before it.
    """
    return df.withColumn("__place", permuted(F.col(index), n, seed, epoch)).select(
        *df.columns,
        F.floor(F.col("__place") / size).alias("batch_id"),
        (F.col("__place") % size).cast("int").alias("row_in_batch"),
    )


# Lengths of a class; and the bits of the shuffle position that order rows inside one.
CLASS_WIDTH, CLASS_BITS = 64, 44


def length_plan(
    lengths: DataFrame, key: str, length: str = "n_tokens", size: int = 8, seed: int = 42, width: int = CLASS_WIDTH
) -> DataFrame:
    """``key, batch_id, row_in_batch, longest``: batches of like length, from keys and lengths only.

    Rows are numbered by length class and, inside a class, in random order, by running counts over cells
    of both; consecutive rows make a batch. The batches come in a random order of their own, so lengths
    don't rise through an epoch. Null lengths count as 0.
    """
    position = F.shiftleft(F.floor(F.coalesce(F.col(length), F.lit(0)) / width).cast("long"), CLASS_BITS) + F.shiftright(
        shuffle_key(F.col(key), seed), POSITION_BITS - CLASS_BITS
    )
    narrow = lengths.select(key, F.coalesce(F.col(length), F.lit(0)).alias("__n"), position.alias("__pos"))
    numbered = sum_before(narrow.withColumn("__one", F.lit(1)), "__pos", "__one", "__i", ties=[key], shifts=(CLASS_BITS - 10,))
    batched = numbered.select(key, "__n", F.floor(F.col("__i") / size).alias("__batch"), (F.col("__i") % size).cast("int").alias("row_in_batch"))
    longest = batched.groupBy("__batch").agg(F.max("__n").alias("longest"))
    n_batches = -(-lengths.count() // size)
    return batched.join(longest, "__batch").select(
        key, permuted(F.col("__batch"), n_batches, seed).alias("batch_id"), "row_in_batch", "longest"
    )


def pad_by_plan(sequences: DataFrame, plan: DataFrame, key: str, padding: dict[str, int]) -> DataFrame:
    """Sequences with their place in a :func:`length_plan`, padded to their batch's longest.

    The arrays move once, to their place; how far to pad them is known by then.
    """
    joined = sequences.join(plan, key)
    return joined.withColumns({name: pad_right(F.col(name), F.col("longest"), value) for name, value in padding.items()})


def padding_waste(plan: DataFrame, lengths: DataFrame, key: str, length: str = "n_tokens") -> DataFrame:
    """One row: tokens, cells of the padded batches, and the share of cells that is padding."""
    joined = plan.join(lengths.select(key, F.coalesce(F.col(length), F.lit(0)).alias("__n")), key)
    return joined.agg(F.sum("__n").alias("n_tokens"), F.sum("longest").alias("n_cells")).withColumn(
        "waste", 1 - F.try_divide("n_tokens", "n_cells")
    )


def batch_eval(df: DataFrame, key: str, size: int = 4, keys: DataFrame | None = None) -> DataFrame:
    """Batches in stored order; the short last batch is kept."""
    return _number(df, stored_index(df if keys is None else keys, key), (key,), size)


def batch_eval_records(
    df: DataFrame, size: int = 4, keys: DataFrame | None = None, source: str = "src", key: str = "rec_id"
) -> DataFrame:
    """Batches of records in stored order, one source after another; the short last batch is kept."""
    index = source_index(df if keys is None else keys, source, key)
    return _number(df, index, (source, key), size)


def pad(batches: DataFrame, padding: dict[str, int], ruler: str = "input_ids") -> DataFrame:
    """Pad array columns on the right to the longest ``ruler`` of their batch.

    The window holds one batch. It also leaves the rows of a batch together in one partition.
    """
    longest = F.max(F.size(ruler)).over(W.partitionBy("batch_id"))
    measured = batches.withColumn("__longest", longest)
    return measured.withColumns(
        {name: pad_right(F.col(name), F.col("__longest"), value) for name, value in padding.items()}
    ).drop("__longest")


def pad_corpus(batches: DataFrame) -> DataFrame:
    return pad(batches, {"input_ids": PAD})


def pad_sft(batches: DataFrame, ignore_index: int = -100) -> DataFrame:
    return pad(batches, {"input_ids": PAD, "labels": ignore_index})


def step_budget(rows: DataFrame, stage: StageSettings, start_epoch: int = 0) -> DataFrame:
    """One row: batches per epoch, training steps left, warm-up steps."""
    steps = F.col("n_batches") * max(stage.epochs - start_epoch, 0)
    return (
        rows.agg(F.ceil(F.count(F.lit(1)) / stage.batch_size).alias("n_batches"))
        .withColumn("n_steps", steps)
        .withColumn("n_warmup", F.floor(F.lit(stage.warmup_share) * F.col("n_steps")))
    )
