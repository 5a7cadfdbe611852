"""Exact dedup with the known texts in the keyed state of a stream.

Arrivals are fingerprinted with SQL functions and go through a streaming aggregate, whose state lies on
disk (RocksDB), is committed to the shared folder after each batch and never expires. Per digest it keeps
the stable identifier that stays (the largest), the number of rows, and where the text of that identifier
is (the locator). Later arrivals go into the same folder and meet the digests of all earlier ones.

Copies are summed up by each task before they are shuffled, so a text with a third of all rows is no hot
key. A digest decides nothing alone: the rows are also grouped by their full bytes, and where a digest
stands for several texts the bytes decide.

Null text is the empty text. Rows that repeat both id and text are one document and share its decision;
a null id counts as the smallest. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import string
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import scratch_path, shared_folder

#: Settings of the state for the time in which the stream runs. The memory is that of one executor; space
#: on disk is not reserved ahead, as each partition has a store of its own.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: str) -> Column:
    """The text with A-Z in lower case, and only these. ASCII texts take the quick way."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    ascii_only = F.octet_length(whole) == F.char_length(whole)
    return F.when(ascii_only, F.lower(whole)).otherwise(
        F.translate(whole, string.ascii_uppercase, string.ascii_lowercase)
    )


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """Digest, identifier and locator (the file it was read from, empty if none) of each row."""
    return docs.select(
        F.col(key).alias("id"),
        digest(normalised(text)).alias("digest"),
        F.input_file_name().alias("locator"),
    )


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def absorb(arrivals: DataFrame, state: str) -> None:
    """Takes a stream of fingerprints into the state at the folder ``state``, up to what is there now."""
    spark = arrivals.sparkSession
    keyed = arrivals.groupBy("digest").agg(
        F.max(F.struct("id", "locator")).alias("stays"), F.count(F.lit(1)).alias("n")
    )
    with _settings(spark, STATE):
        run = (
            keyed.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()


def known(spark: SparkSession, state: str) -> DataFrame:
    """What the state holds: digest, the id that stays, its locator, and the number of rows."""
    store = spark.read.format("statestore").load(state)
    stays, n = store.schema["value"].dataType.names
    return store.select(
        "key.digest",
        F.col(f"value.{stays}.id").alias("keep_id"),
        F.col(f"value.{stays}.locator").alias("locator"),
        F.col(f"value.{n}").alias("group_size"),
    )


def exact_dedup(
    docs: DataFrame, state: str | None = None, key: str = "doc_id", text: str = "text", digest=sha256
) -> DataFrame:
    """A decision for each row: ``key``, keep_id, group_size, kept, text_sha256.

    ``state`` is a new folder or that of an earlier call with the same session settings, whose texts then
    count as well; by default a new one in the shared folder.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    state = state or scratch_path(spark, "digests")
    arrivals = f"{state}-arrivals/{uuid.uuid4().hex}"
    fingerprints(docs, key, text, digest).write.parquet(arrivals)
    stored = spark.read.parquet(arrivals)
    # the stream remembers which files it has read, so it goes on with what is new
    absorb(spark.readStream.schema(stored.schema).parquet(f"{state}-arrivals/*"), state)

    digests = known(spark, state)
    decided = _decisions(stored, digests, ["digest"])
    mixed = _mixed_digests(docs, key, text, digest)
    if not mixed.isEmpty():
        decided = _decisions(stored, digests.join(mixed, "digest", "left_anti"), ["digest"]).unionByName(
            _by_bytes(docs, mixed, key, text, digest)
        )
    return decided.withColumnRenamed("id", key)


def _decisions(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """Every row with the decision of its group; a hot group's rows can be split between tasks."""
    return rows.join(groups.drop("locator"), on).select(
        "id",
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def _texts(docs: DataFrame, key: str, text: str, digest) -> DataFrame:
    """Each distinct text with its digest, compared byte by byte in the aggregate."""
    return (
        docs.select(F.col(key).alias("id"), normalised(text).alias("whole"))
        .groupBy("whole")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .withColumn("digest", digest(F.col("whole")))
    )


def _mixed_digests(docs: DataFrame, key: str, text: str, digest) -> DataFrame:
    """Digests that stand for more than one text."""
    texts = _texts(docs, key, text, digest)
    return texts.groupBy("digest").count().filter("count > 1").select("digest").checkpoint()


def _by_bytes(docs: DataFrame, mixed: DataFrame, key: str, text: str, digest) -> DataFrame:
    """Decisions by the full text for the rows whose digest isn't enough."""
    rows = docs.select(F.col(key).alias("id"), normalised(text).alias("whole"))
    rows = rows.withColumn("digest", digest(F.col("whole"))).join(mixed, "digest", "left_semi")
    groups = _texts(docs, key, text, digest).join(mixed, "digest", "left_semi").withColumn("locator", F.lit(None))
    return _decisions(rows, groups.drop("digest"), ["whole"])
