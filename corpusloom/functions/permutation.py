"""A keyed permutation of 0..n-1 as row-local arithmetic: every key is another order, and none needs a sort."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.scores import let

ROUNDS = 4
#: Of the numbers from n on, which are walked through, there are fewer than the root of n and so fewer than this
#: for small n; for large n each further step is needed once in a root of n.
WALK = 64


def sides(n: int) -> tuple[int, int]:
    """The smallest rectangle of nearly equal sides with ``n`` cells at least."""
    a = max(math.isqrt(max(n, 1) - 1) + 1, 1)
    return a, max(-(-n // a), 1)


def _shift(seed: str, turn: Column, side: str, value: Column) -> Column:
    text = F.concat_ws(":", F.lit(seed), turn.cast("string"), F.lit(side), value.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _once(x: Column, n: int, seed: str) -> Column:
    """A Feistel network over the rectangle: each half is moved along by a hash of the other, which can be undone."""
    a, b = sides(n)

    def step(acc: Column, turn: Column) -> Column:
        left = (acc["l"] + _shift(seed, turn, "l", acc["r"]) % a) % a
        return let(left, lambda l: F.struct(l.alias("l"), ((acc["r"] + _shift(seed, turn, "r", l) % b) % b).alias("r")))

    start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))
    turns = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(turns, start, step, lambda acc: acc["l"] * b + acc["r"])


def permuted(index: Column, n: int, seed: int = 42, epoch: int = 0) -> Column:
    """The place of the row with number ``index`` (0..n-1) in the order of this seed and epoch.

    What the network puts beyond n - 1 goes through it again until it falls below: still a permutation.
    """
    key = f"{seed}:{epoch}"
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), _once(index.cast("long"), n, key),
        lambda acc, _: F.when(acc < n, acc).otherwise(_once(acc, n, key)),
    )
    return let(walked, lambda p: F.when(p < n, p).otherwise(F.raise_error(F.lit("walked too far")).cast("long")))
