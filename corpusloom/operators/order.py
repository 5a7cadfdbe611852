"""Global order without a single partition: running sums over cells of an integer position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# A cell of unique integer positions holds at most 2^20 rows, and 2^22 cells remain on top.
DENSE = (20, 22)
# A 60-bit hash is spread evenly over its 2^20 top cells, however the keys are distributed.
HASHED = (40,)


POSITION_BITS = 60


def shuffle_key(key: Column, seed: int) -> Column:
    """60 bits of the MD5 of ``seed:key`` as a whole number."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 32 bits of the same digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _cell(position: str, shift: int) -> Column:
    # never null, so no two branches of the plan differ by an inferred null filter and the totals
    # are scanned once
    return F.coalesce(F.shiftright(position, shift), F.lit(0))


def sum_before(
    df: DataFrame,
    position: str,
    value: str,
    out: str = "before",
    part: Sequence[str] = (),
    ties: Sequence[str] = (),
    total: str | None = None,
    shifts: Sequence[int] = DENSE,
) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the same ``part``, as column ``out``.

    Positions are cut into cells of 2^shift; a window runs inside each cell only, and the cells'
    totals go through the same operator one level up. A hot ``part`` is thereby spread over its
    cells, and the rows themselves are shuffled once: the totals join on the window's own keys.
    A null part is a part like any other. ``total`` names a column for the sum over the whole part.
    """
    part = list(part)

    def running(*within: str) -> Column:
        w = W.partitionBy(*(within or [F.lit(0)])).orderBy(position, *ties)
        return F.coalesce(F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    if not shifts:
        # top level: one row per remaining cell
        if total:
            df = df.withColumn(total, F.sum(value).over(W.partitionBy(*(part or [F.lit(0)]))))
        return df.withColumn(out, running(*part))

    # one struct holds part and cell: it is never null itself, so the join keeps null parts, and it
    # is the key of the window, the totals and the join, so the rows are shuffled once
    key, cell, base = (f"__{name}{len(shifts)}" for name in ("key", "cell", "base"))
    fields = [F.col(p).alias(f"p{i}") for i, p in enumerate(part)]
    celled = df.withColumn(key, F.struct(*fields, _cell(position, shifts[0]).alias("cell")))
    totals = celled.groupBy(key).agg(F.sum(value).alias("__sum"))
    totals = totals.select(
        key, "__sum", F.col(f"{key}.cell").alias(cell),
        *[F.col(f"{key}.p{i}").alias(p) for i, p in enumerate(part)],
    )
    bases = sum_before(totals, cell, "__sum", base, part, total=total, shifts=shifts[1:])
    return (
        celled.withColumn(out, running(key))
        .join(bases.select(key, base, *([total] if total else [])), key)
        .withColumn(out, F.col(out) + F.col(base))
        .drop(key, base)
    )


def shuffled_index(keys: DataFrame, key: str, seed: int = 42, out: str = "row_index") -> DataFrame:
    """``key`` and its place, from 0, in a reproducible random order."""
    placed = keys.select(key).withColumns(
        {"__pos": shuffle_key(F.col(key), seed), "__one": F.lit(1)}
    )
    return sum_before(placed, "__pos", "__one", out, ties=[key], shifts=HASHED).select(key, out)


def source_index(keys: DataFrame, source: str, key: str, out: str = "row_index") -> DataFrame:
    """``source``, ``key`` and their place, from 0: sources in order, ``key`` within each."""
    counted = keys.select(source, key).withColumn("__one", F.lit(1))
    inside = sum_before(counted, key, "__one", "__in", part=[source], total="__rows")
    # one row per source from here on
    sizes = inside.groupBy(F.struct(F.col(source).alias("source")).alias("__of")).agg(
        F.max("__rows").alias("__rows")
    )
    earlier = W.partitionBy(F.lit(0)).orderBy("__of").rowsBetween(W.unboundedPreceding, -1)
    first = sizes.select("__of", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__first"))
    return (
        inside.withColumn("__of", F.struct(F.col(source).alias("source")))
        .join(first, "__of")
        .select(source, key, (F.col("__first") + F.col("__in")).alias(out))
    )


def stored_index(keys: DataFrame, key: str, out: str = "row_index") -> DataFrame:
    """``key`` and its place, from 0, in the order of the unique whole number ``key``."""
    counted = keys.select(key).withColumn("__one", F.lit(1))
    return sum_before(counted, key, "__one", out).select(key, out)
