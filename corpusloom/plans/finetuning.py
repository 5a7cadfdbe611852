"""Instruction records to padded fine-tuning batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import FINETUNING, StageSettings
from corpusloom.functions import sequences as seq
from corpusloom.functions.text import default_text
from corpusloom.operators.batching import batch_eval_records, batch_train, pad_sft
from corpusloom.operators.records import FIELDS
from corpusloom.tokenizer import Tokenizer

KEY = ("src", "rec_id")


def encode_records(records: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``src, rec_id`` and the four fields as id arrays, encoded in one pass."""
    return tokenizer.encode(records, KEY, {f"{f}_ids": f for f in FIELDS})


def sft_sequences(encoded: DataFrame, stage: StageSettings = FINETUNING) -> DataFrame:
    """``src, rec_id, input_ids, labels``: untruncated prompt, story and masked labels."""
    prompt = F.col("__prompt")
    return encoded.withColumn(
        "__prompt",
        seq.build_prompt(F.col("features_ids"), F.col("words_ids"), F.col("summary_ids")),
    ).select(
        *KEY,
        F.size(prompt).alias("prompt_len"),
        seq.build_sft(prompt, F.col("story_ids")).alias("input_ids"),
        seq.sft_labels(prompt, F.col("story_ids"), stage.ignore_index).alias("labels"),
    )


def truncate_sft(sequences: DataFrame, max_length: int = 512) -> DataFrame:
    """Cut ids and labels alike; the cut labels end in EOS too."""
    whole = F.col("input_ids")
    return sequences.select(
        *[c for c in sequences.columns if c not in ("input_ids", "labels")],
        seq.truncate(whole, max_length).alias("input_ids"),
        seq.truncate(F.col("labels"), max_length, length_of=whole).alias("labels"),
    )


def unequal_lengths(sequences: DataFrame) -> DataFrame:
    """Rows whose ids and labels differ in length; there must be none."""
    return sequences.filter(F.size("input_ids") != F.size("labels"))


def require_equal_lengths(sequences: DataFrame) -> DataFrame:
    """The same rows; running them fails on the first row of unequal lengths."""
    equal = F.size("input_ids") == F.size("labels")
    return sequences.filter(F.assert_true(equal, "input_ids and labels differ in length").isNull())


def sft_dataset(
    records: DataFrame, tokenizer: Tokenizer, stage: StageSettings = FINETUNING
) -> DataFrame:
    filled = records.withColumns({f: default_text(F.col(f)) for f in FIELDS})
    sequences = sft_sequences(encode_records(filled, tokenizer), stage)
    return require_equal_lengths(truncate_sft(sequences, stage.max_length))


def train_batches(
    sequences: DataFrame, stage: StageSettings = FINETUNING, seed: int = 42,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Shuffled padded batches; the shuffle key is ``src:rec_id``, so any number of sources fits."""

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("rec_key", F.concat_ws(":", "src", F.col("rec_id").cast("string")))

    batches = batch_train(
        keyed(sequences), "rec_key", stage.batch_size, seed, None if keys is None else keyed(keys)
    )
    return pad_sft(batches.drop("rec_key"), stage.ignore_index)


def eval_batches(
    sequences: DataFrame, stage: StageSettings = FINETUNING, keys: DataFrame | None = None
) -> DataFrame:
    """Padded batches in stored order, one source after another."""
    batches = batch_eval_records(sequences, stage.eval_batch_size, keys)
    return pad_sft(batches, stage.ignore_index)


def prepare(
    train: DataFrame, validation: DataFrame, tokenizer: Tokenizer, folder: str,
    stage: StageSettings = FINETUNING, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Encode the records of both splits once, store the sequences, return their padded batches.

    Every epoch starts from the stored sequences; row numbering reads their key columns only.
    """
    spark = train.sparkSession
    made = []
    for name, records in (("train", train), ("val", validation)):
        path = f"{folder}/sft_sequences_{name}"
        sft_dataset(records, tokenizer, stage).write.mode("overwrite").parquet(path)
        made.append(spark.read.parquet(path))
    return train_batches(made[0], stage, seed), eval_batches(made[1], stage)
