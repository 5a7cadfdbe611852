"""Corpus texts to padded pre-training batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import PRETRAINING, StageSettings
from corpusloom.functions import sequences as seq
from corpusloom.operators.batching import batch_eval, batch_train, pad_corpus
from corpusloom.tokenizer import Tokenizer


def corpus_sequences(
    df: DataFrame, tokenizer: Tokenizer, key: str, text: str = "text",
    stage: StageSettings = PRETRAINING,
) -> DataFrame:
    """``key, input_ids``: encoded, framed and truncated."""
    framed = tokenizer.encode(df, [key], {"ids": text}).withColumn(
        "ids", seq.frame_corpus(F.col("ids"))
    )
    return framed.select(key, seq.truncate(F.col("ids"), stage.max_length).alias("input_ids"))


def train_batches(
    sequences: DataFrame, key: str, stage: StageSettings = PRETRAINING, seed: int = 42,
    keys: DataFrame | None = None,
) -> DataFrame:
    return pad_corpus(batch_train(sequences, key, stage.batch_size, seed, keys))


def eval_batches(
    sequences: DataFrame, key: str, stage: StageSettings = PRETRAINING,
    keys: DataFrame | None = None,
) -> DataFrame:
    return pad_corpus(batch_eval(sequences, key, stage.eval_batch_size, keys))


def model_inputs(batches: DataFrame, stage: StageSettings = PRETRAINING) -> DataFrame:
    """Padding mask and next-token labels of padded batches."""
    return batches.withColumns(
        {
            "mask": seq.padding_mask(F.col("input_ids")),
            "labels": seq.shift_labels_pretrain(F.col("input_ids"), stage.ignore_index),
        }
    )


def prepare(
    train: DataFrame, validation: DataFrame, tokenizer: Tokenizer, folder: str, key: str = "doc_id",
    text: str = "text", stage: StageSettings = PRETRAINING, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Encode both splits once, store the sequences, and return their padded batches.

    Every epoch starts from the stored sequences; row numbering reads their key column only.
    """
    spark = train.sparkSession
    made = []
    for name, df in (("train", train), ("val", validation)):
        path = f"{folder}/pretrain_{name}"
        corpus_sequences(df, tokenizer, key, text, stage).write.mode("overwrite").parquet(path)
        made.append(spark.read.parquet(path))
    return train_batches(made[0], key, stage, seed), eval_batches(made[1], key, stage)
