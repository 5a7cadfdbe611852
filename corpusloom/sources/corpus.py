"""Reading corpora, line streams and instruction records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.operators.records import FIELDS, make_records
from corpusloom.session import drop_mark, path_exists
from corpusloom.sources import snapshots

RECORD_SCHEMA = "src string, rec_id long, " + ", ".join(f"{f} string" for f in FIELDS)


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer splits than the cluster has cores; larger scans stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_corpus(
    spark: SparkSession, path: str, split: str | None = None, file_format: str = "parquet"
) -> DataFrame:
    """One row per document. ``split`` is pushed to the scan as a filter on the split column."""
    df = spark.read.format(file_format).load(path)
    return df if split is None else df.filter(F.col("split") == split)


def write_corpus(df: DataFrame, path: str, key: str, files: int | None = None) -> None:
    """Write a corpus with a split column so that readers skip what they don't ask for.

    Splits are folders, and inside one the files (and their row groups) hold ranges of ``key``, so a filter on
    the split lists no other files and one on the key reads few row groups. A split of any size is spread over
    several files. ``key`` has an order.
    """
    ranged = df.repartitionByRange(files, "split", key) if files else df.repartitionByRange("split", key)
    ranged.sortWithinPartitions("split", key).write.partitionBy("split").parquet(path)


def read_instruct_lines(
    spark: SparkSession, path: str, file_format: str = "parquet", src: str = "src",
    per_file: bool = False,
) -> DataFrame:
    """Ordered lines (src, line_no, text) from a table that has them, or from text files.

    Text files are one stream in the order of their names, so a record may go on in the next file;
    ``per_file`` makes each a stream of its own.
    """
    if file_format == "text":
        return _lines_of_files(spark, path, per_file)
    df = spark.read.format(file_format).load(path)
    return df.select(F.col(src).cast("string").alias("src"), F.col("line_no").cast("long"), "text")


#: Room for a file of 4 TB in a line number; the file's place is above it.
FILE_BITS = 42


def _lines_of_files(spark: SparkSession, path: str, per_file: bool) -> DataFrame:
    """Lines of text files. ``line_no`` is the split's byte offset plus the place in the split.

    A split has at most as many lines as bytes, so these numbers rise within a file; they have
    gaps, which the record parser does not mind. The window sees one file split at a time. The order
    of the files is a table of one row per file.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("src"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__read"),
        F.col("value").alias("text"),
    )
    place = F.row_number().over(W.partitionBy("src", "__start").orderBy("__read")) - 1
    placed = lines.select("src", (F.col("__start") + place).alias("line_no"), "text")
    if per_file:
        return placed
    names = spark.read.text(path).select(F.col("_metadata.file_path").alias("src")).distinct()
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("src")).cast("long") - 1
    files = names.select("src", F.shiftleft(rank, FILE_BITS).alias("__file"))
    return placed.join(files, "src").select(
        F.lit(path).alias("src"), (F.col("__file") + F.col("line_no")).alias("line_no"), "text"
    )


def save_records(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def load_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD_SCHEMA).json(path)


def get_or_make_records(
    train_lines: DataFrame, validation_lines: DataFrame, folder: str
) -> tuple[DataFrame, DataFrame]:
    """Saved records of both splits, or both made anew if either is missing."""
    spark = train_lines.sparkSession
    paths = [f"{folder}/sft_train", f"{folder}/sft_val"]
    if not all(path_exists(spark, f"{p}/_SUCCESS") for p in paths):
        # both marks go first, so a pair that is only half new never counts as whole
        for path in paths:
            drop_mark(spark, path)
        for lines, path in zip((train_lines, validation_lines), paths):
            save_records(make_records(lines), path)
    return load_records(spark, paths[0]), load_records(spark, paths[1])


def publish_records(
    train_lines: DataFrame, validation_lines: DataFrame, root: str, force: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Published records of both splits, or both made anew and published together if there are none.

    Unlike separate folders, several readers and writers may be at work at once: each reads the pair of one
    version, and of two writers of the first version the later one takes what the other has published.
    """
    spark = train_lines.sparkSession
    version, _ = snapshots.current(spark, root)
    if force or not version:

        def write(folder: str) -> None:
            for lines, name in ((train_lines, "sft_train"), (validation_lines, "sft_val")):
                save_records(make_records(lines), f"{folder}/{name}")

        try:
            version = snapshots.publish(spark, root, write, version)
        except snapshots.Conflict:
            if force:
                raise
            version = None
    _, folder = snapshots.current(spark, root, version)
    return load_records(spark, f"{folder}/sft_train"), load_records(spark, f"{folder}/sft_val")
