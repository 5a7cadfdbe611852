"""Connected components of a graph given as pairs, without collecting nodes or links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import scratch_path


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read again.

    In a loop a written table is better than a checkpoint, whose plan keeps what is known of the columns,
    which grows with every turn.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node it is connected with, from the columns ``a`` and ``b``.

    Each round gives a node the smallest label among its neighbours and then that label's own label, so
    chains shorten by more than half. Labels are summed up per task before they are shuffled, and a node
    with very many links is only a long run of narrow rows, which a skewed join can split.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.filter("a <> b"), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("seen")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("seen").alias("seen"))
        )
        closer = stored(labels.join(near, "node").select("node", F.least("label", "seen").alias("to"), "label"))
        jump = closer.select(F.col("node").alias("to"), F.col("to").alias("further"))
        after = closer.join(jump, "to").select("node", F.least("to", "further").alias("label"), F.col("label").alias("was"))
        after = stored(after)
        if after.filter("label <> was").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
