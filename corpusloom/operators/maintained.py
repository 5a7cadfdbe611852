"""Word counts that follow a changing corpus, and the vocabularies made from them.

The counts of a corpus are the sum of the counts of its documents, so documents that come or go are counted alone,
with a plus or a minus, and added to the stored counts. Documents counted before are not read again. Each change
makes a new version of the count table; two writers can't both build on one version, so no change is lost.
"""

from __future__ import annotations

from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import TokenizerSettings
from corpusloom.operators.vocab import word_counts
from corpusloom.sources import snapshots

COUNT_SCHEMA = "word string, n long"


def count_changes(
    added: DataFrame | None, removed: DataFrame | None, settings: TokenizerSettings, text: str = "text"
) -> DataFrame:
    """``word, n``: by how much the words of documents that come and go change the counts; 0 is left out."""
    parts = []
    for docs, sign in ((added, 1), (removed, -1)):
        if docs is not None:
            counts = word_counts(docs, text, settings.pre_tokenizer, settings.normalize_whitespace)
            parts.append(counts.select("word", (F.col("n") * sign).alias("n")))
    if not parts:
        raise ValueError("neither added nor removed documents")
    return _summed(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter("n <> 0")


def _kind(settings: TokenizerSettings) -> TokenizerSettings:
    """What the counts depend on; the sizes of a vocabulary are chosen later."""
    fixed = TokenizerSettings()
    return replace(settings, strategy=fixed.strategy, vocab_size=fixed.vocab_size, min_frequency=fixed.min_frequency)


def update_counts(
    spark: SparkSession, root: str, settings: TokenizerSettings, added: DataFrame | None = None,
    removed: DataFrame | None = None, text: str = "text", after: int | None = None,
) -> int:
    """Store the counts after a change as a new version under ``root``, and return its number.

    ``after`` is the version the change belongs to, if it isn't the newest: repeating a change that has been made
    is then a ``Conflict`` instead of a change made twice. Removing what was never added is an error.
    """
    version, _ = snapshots.current(spark, root)
    if after is not None and after != version:
        raise snapshots.Conflict(f"{root} is at version {version}, not {after}")
    changes = count_changes(added, removed, settings, text)
    counts = _summed(stored_counts(spark, root, settings, version).unionByName(changes)) if version else changes
    checked = F.when(F.col("n") > 0, F.col("n")).otherwise(
        F.raise_error(F.concat(F.lit("more removed than added: "), F.col("word"))).cast("long")
    )

    def write(folder: str) -> None:
        counts.select("word", checked.alias("n")).write.parquet(f"{folder}/counts")
        spark.createDataFrame([asdict(_kind(settings))]).write.parquet(f"{folder}/settings")

    return snapshots.publish(spark, root, write, version)


def stored_counts(
    spark: SparkSession, root: str, settings: TokenizerSettings, version: int | None = None
) -> DataFrame:
    """``word, n`` of the newest version, or of an earlier one; the settings must split words alike."""
    _, folder = snapshots.current(spark, root, version)
    if folder is None:
        raise FileNotFoundError(f"no counts at {root}")
    made = TokenizerSettings(**spark.read.parquet(f"{folder}/settings").first().asDict())
    if made != _kind(settings):
        raise ValueError(f"these words were split otherwise: {made}")
    return spark.read.schema(COUNT_SCHEMA).parquet(f"{folder}/counts")
