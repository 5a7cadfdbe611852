"""Loss windows of a running log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOWS = "epoch string, window long, mean_loss double, perplexity double"


def stream_history(
    log: DataFrame, every: int, epoch: str = "epoch", step: str = "step", loss: str = "loss"
) -> DataFrame:
    """Mean loss and perplexity of each full window of ``every`` steps, as it fills up; counting restarts per epoch.

    State of an epoch is the open window's count and sum, so a window may begin in one micro-batch and end in a
    later one; one that stays short is never put out, as in the batch query. The log grows at its end: inside a
    micro-batch steps may have any order, but one that belongs before an earlier micro-batch is an error. A null
    epoch is one like any other.
    """

    def roll(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window, count, total, last = state.get if state.exists else (0, 0, 0.0, None)
        arrived = pd.concat(list(frames)).sort_values("step")
        if last is not None and len(arrived) and arrived["step"].iloc[0] < last:
            raise ValueError(f"step {arrived['step'].iloc[0]} comes after step {last}")
        rows = []
        for value in arrived["loss"]:
            count, total = count + 1, total + value
            if count == every:
                rows.append((*key, window, total / every))
                window, count, total = window + 1, 0, 0.0
        state.update((window, count, float(total), int(arrived["step"].iloc[-1])))
        yield pd.DataFrame(rows, columns=["epoch", "window", "mean_loss"])

    narrow = log.select(
        F.col(epoch).cast("string").alias("epoch"), F.col(step).cast("long").alias("step"),
        F.col(loss).cast("double").alias("loss"),
    )
    rolled = narrow.groupBy("epoch").applyInPandasWithState(
        roll, "epoch string, window long, mean_loss double", "window long, count long, total double, last long",
        "append", GroupStateTimeout.NoTimeout,
    )
    return rolled.withColumn("perplexity", F.exp("mean_loss"))


def write_history(log: DataFrame, every: int, out: str, checkpoint: str, **columns: str) -> StreamingQuery:
    """Write the windows filled by all that has arrived to parquet under ``out``, exactly once, then stop."""
    return (
        stream_history(log, every, **columns).writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
