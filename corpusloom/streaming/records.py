"""Instruction records from a stream of lines that arrive in any order.

Lines are classified row by row, as in the batch parser. What depends on order is kept between micro-batches in two
tables beside the checkpoint: the lines that wait (for their turn, or for their record's end mark), and a row per
source with its turn and the records it has given. A micro-batch adds its lines, finds how far each source's turn
gets, and gives the lines up to the last end mark that has had its turn to the batch parser's operators. So the
stream gives the records of the batch parser, whatever the micro-batches were, and a restarted query goes on with
these tables.

No source meets in one task: turns and record numbers are sums over cells of line numbers. What waits is written
anew by each micro-batch, so a trigger costs its own lines and those that have overtaken a line still on its way.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.order import sum_before
from corpusloom.operators.records import FIELDS, assemble_records, assign_records, classify_lines
from corpusloom.session import move_files, path_exists, remove

RECORDS = "src string, rec_id long, features string, words string, summary string, story string, late boolean"
LINES = "src string, line_no long, kind string, payload string"
SOURCES = "src string, turn long, seen long, rec_id long"


def _kept(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table at ``path``, in place of what an attempt before may have left there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _turns(lines: DataFrame, sources: DataFrame, horizon: int | None) -> DataFrame:
    """``src, turn`` of the sources that get on: past the next numbers without a gap, or past all a horizon back."""
    ahead = lines.join(sources, "src").filter("line_no >= turn")
    if horizon is None:
        numbered = sum_before(ahead.select("src", "line_no", "turn", F.lit(1).alias("one")), "line_no", "one", part=["src"])
        in_turn = numbered.filter(F.col("line_no") - F.col("turn") == F.col("before"))
    else:
        in_turn = ahead.filter(F.col("line_no") <= F.col("seen") - horizon)
    return in_turn.groupBy("src").agg((F.max("line_no") + 1).alias("turn"))


def _advance(
    spark: SparkSession, arrived: DataFrame, known: DataFrame, waiting: DataFrame, folder: str, horizon: int | None
) -> DataFrame:
    """The records that the arrived lines complete, and late lines; what is to be kept goes to ``folder``."""
    # the rows of a source are many, so the tables of sources are written: Spark knows their size, and broadcasts them
    turn = F.coalesce("turn", F.lit(0))
    placed = arrived.join(known.select("src", "turn"), "src", "left").withColumn("in_time", F.col("line_no") >= turn)
    # of equal numbers the one that waits counts; of those that come together, one
    fresh = placed.filter("in_time").groupBy("src", "line_no").agg(F.min(F.struct("kind", "payload")).alias("line"))
    fresh = fresh.join(waiting.select("src", "line_no"), ["src", "line_no"], "left_anti")
    fresh = _kept(fresh.select("src", "line_no", "line.kind", "line.payload"), f"{folder}/fresh")
    lines = waiting.unionByName(fresh)

    seen = lines.groupBy("src").agg(F.max("line_no").alias("last"))
    sources = known.join(seen, "src", "full").select(
        "src", turn.alias("turn"), F.greatest("seen", "last").alias("seen"), F.coalesce("rec_id", F.lit(0)).alias("rec_id")
    )
    sources = _kept(sources, f"{folder}/seen")
    moved = _turns(lines, sources, horizon).withColumnRenamed("turn", "moved")
    sources = sources.join(moved, "src", "left").withColumn("turn", F.coalesce("moved", "turn")).drop("moved")
    sources = _kept(sources, f"{folder}/turns")

    due = lines.join(sources.select("src", "turn"), "src").filter("kind = 'end' AND line_no < turn")
    ends = due.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("end"))
    ends = _kept(sources.join(ends, "src").select("src", "rec_id", "n", "end"), f"{folder}/ends")
    sources.join(ends.select("src", "n"), "src", "left").select(
        "src", "turn", "seen", (F.col("rec_id") + F.coalesce("n", F.lit(0))).alias("rec_id")
    ).write.mode("overwrite").parquet(f"{folder}/sources")

    cut = lines.join(ends.select("src", "end"), "src", "left")
    cut.filter("end IS NULL OR line_no > end").drop("end").write.mode("overwrite").parquet(f"{folder}/waiting")
    records = assemble_records(assign_records(cut.filter("line_no <= end").drop("end")))
    records = records.join(ends.select("src", F.col("rec_id").alias("first")), "src").select(
        "src", (F.col("rec_id") + F.col("first")).alias("rec_id"), *FIELDS, F.lit(False).alias("late")
    )
    # without a horizon a number whose turn is over is one that came before
    late = placed.filter("line_no IS NULL" if horizon is None else "in_time IS NULL OR NOT in_time")
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("rec_id", "long"), *((f, "string") for f in FIELDS[:-1]))]
    return records.unionByName(late.select("src", *nothing, F.col("payload").alias("story"), F.lit(True).alias("late")))


def _assemble(spark: SparkSession, out: str, checkpoint: str, horizon: int | None, batch: DataFrame, number: int) -> None:
    """One micro-batch, once: what is made is marked by its success file, moved to ``out``, and never made again."""
    before, folder = (f"{checkpoint}/assembly/{n}" for n in (number - 1, number))
    made = f"{out}/_made/{number}"
    if not path_exists(spark, f"{made}/_SUCCESS"):
        arrived = classify_lines(batch).select(F.coalesce("src", F.lit("")).alias("src"), "line_no", "kind", "payload")
        arrived.write.mode("overwrite").parquet(f"{folder}/arrived")
        arrived = spark.read.schema(LINES).parquet(f"{folder}/arrived")
        known, waiting = (
            spark.read.schema(schema).parquet(f"{before}/{name}") if number else spark.createDataFrame([], schema)
            for name, schema in (("sources", SOURCES), ("waiting", LINES))
        )
        _advance(spark, arrived, known, waiting, folder, horizon).write.mode("overwrite").parquet(made)
    move_files(spark, made, out, f"batch-{number}-")
    for done in (before, f"{out}/_made/{number - 1}"):
        remove(spark, done)
    for step in ("arrived", "fresh", "seen", "turns", "ends"):
        remove(spark, f"{folder}/{step}")


def write_records(lines: DataFrame, out: str, checkpoint: str, horizon: int | None = None) -> StreamingQuery:
    """Write the records that all lines arrived so far complete to parquet under ``out``, exactly once, then stop.

    ``lines`` is a streaming frame ``src, line_no, text``. Without ``horizon`` the lines of a source are numbered
    0, 1, 2, .. and each waits for all before it; a number that comes again is ignored. With one, numbers may have
    gaps, and a line has its turn when a line ``horizon`` or more beyond it has come; one that comes after its turn
    can't be placed any more and is put out as it is, with ``late`` set, its text as the story and no number. Lines
    without a number are late, too.
    """
    return (
        lines.writeStream.foreachBatch(partial(_assemble, lines.sparkSession, out, checkpoint, horizon))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
