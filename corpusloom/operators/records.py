"""Instruction records from an ordered stream of lines (src, line_no, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.text import default_text, python_strip
from corpusloom.operators.order import sum_before

# Line markers of the instruction stream.
FIELD_MARKS = (("features", "Features:"), ("words", "Words:"), ("summary", "Summary:"))
STORY_MARK = "Story:"
END_MARK = "<|endoftext|>"

FIELDS = ("features", "words", "summary", "story")


def classify_lines(lines: DataFrame) -> DataFrame:
    """Add ``kind`` (features, words, summary, reset, end, text) and the line's ``payload``."""
    stripped = lines.withColumn("payload", python_strip(default_text(F.col("text"))))
    line = F.col("payload")
    kind = F
    payload = F
    for name, mark in FIELD_MARKS:
        hit = line.startswith(mark)
        kind = kind.when(hit, name)
        # one character after the mark is skipped, whatever it is
        payload = payload.when(hit, F.substring(line, len(mark) + 2, 2147483647))
    kind = kind.when(line == STORY_MARK, "reset").when(line == END_MARK, "end").otherwise("text")
    return stripped.withColumn("kind", kind).withColumn(
        "payload", payload.when(F.col("kind") == "text", line).otherwise("")
    )


def assign_records(classified: DataFrame) -> DataFrame:
    """Add ``rec_id``, the number of end marks before the line, and ``n_records`` of its source."""
    flagged = classified.withColumns(
        {
            # lines without a source form one stream
            "src": F.coalesce("src", F.lit("")),
            "__end": (F.col("kind") == "end").cast("long"),
        }
    )
    return sum_before(
        flagged, "line_no", "__end", "rec_id", part=["src"], total="n_records"
    ).drop("__end")


def assemble_records(assigned: DataFrame) -> DataFrame:
    """One row per ended record: the last field of each kind, and the text after the last reset."""
    # the tail after a source's last end mark is no record; it is dropped before it is collected
    ended = assigned.filter(F.col("rec_id") < F.col("n_records"))
    # so is text before the last reset; the window is keyed like the aggregate, which reuses its order
    reset = F.max(F.when(F.col("kind") == "reset", F.col("line_no")))
    ended = ended.withColumn("__reset", reset.over(W.partitionBy("src", "rec_id"))).filter(
        (F.col("kind") != "text") | F.col("__reset").isNull() | (F.col("line_no") > F.col("__reset"))
    )
    line = F.struct("line_no", "payload")

    def last_of(kind: str):
        found = F.max(F.when(F.col("kind") == kind, line))
        return F.coalesce(found["payload"], F.lit("")).alias(kind)

    grouped = ended.groupBy("src", "rec_id").agg(
        *[last_of(name) for name, _ in FIELD_MARKS],
        F.collect_list(F.when(F.col("kind") == "text", line)).alias("__lines"),
    )
    return grouped.select(
        "src", "rec_id", "features", "words", "summary",
        python_strip(F.array_join(F.sort_array("__lines")["payload"], " ")).alias("story"),
    )


def make_records(lines: DataFrame) -> DataFrame:
    return assemble_records(assign_records(classify_lines(lines)))
