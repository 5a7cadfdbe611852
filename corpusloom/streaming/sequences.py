"""The row-local part of corpus preparation, on a stream of new documents.

Encoding, framing and truncation look at one row only, so the same plan runs on a streaming
frame without state. Batching needs the whole order and stays a batch job on what this writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpusloom.config import PRETRAINING, StageSettings
from corpusloom.plans.pretraining import corpus_sequences
from corpusloom.tokenizer import Tokenizer


def write_sequences(
    documents: DataFrame, tokenizer: Tokenizer, out: str, checkpoint: str, key: str = "doc_id",
    text: str = "text", stage: StageSettings = PRETRAINING,
) -> StreamingQuery:
    """Encode all documents that have arrived to parquet under ``out``, exactly once, then stop."""
    sequences = corpus_sequences(documents, tokenizer, key, text, stage)
    return (
        sequences.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
