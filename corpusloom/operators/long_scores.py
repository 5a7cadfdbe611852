"""Candidate scores as a long table (context, candidate, score), where no context has to fit one row or task.

The column functions of ``functions.scores`` hold a context in one array. Here a context may hold any share of all
rows: what is computed per context are aggregates that merge in any order, each combined in the tasks first, and
ranks and running sums go by cells of the score. Candidates of a context are distinct whole numbers. Null scores
count as minus infinity; those candidates have probability 0 and come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.operators.order import sum_before

# Scores of one scale differ by less than this, so the sum of their exponentials stays far from the
# ends of a double, whatever the scores are.
SCALE = 64.0
# Parts that a context's best candidates are first looked for in.
SEGMENTS = 64
# Log-probabilities in steps of 2^-40 down to -1023: cells of 2^-10, and cells of 1 above them.
STEP, LOWEST, CELLS = 40, 1023.0, (30, 10)

_NEVER = float("-inf")


def long_scores(df: DataFrame, ctx: str, cand: str, score: Column, temperature: float = 1.0) -> DataFrame:
    """``ctx, cand, score`` of the columns named, scores divided by the temperature."""
    scaled = F.coalesce(score.cast("double"), F.lit(_NEVER)) / F.lit(float(temperature))
    return df.select(F.col(ctx).alias("ctx"), F.col(cand).cast("long").alias("cand"), scaled.alias("score"))


def context_sums(long: DataFrame) -> DataFrame:
    """``ctx, log_sum_exp, n, total``: the normaliser, candidates and sum of scores per context.

    The state of a log-sum-exp is a scale and a sum of exponentials relative to it. Scales are multiples of a fixed
    number, so states of one scale add up and need no common maximum first: each task sends one row per context and
    scale, most contexts have one or two scales, and these are merged by lowering them to the largest.
    """
    finite = F.col("score") > _NEVER
    scale = F.when(finite, F.floor(F.col("score") / SCALE))
    states = long.groupBy("ctx", scale.alias("scale")).agg(
        F.sum(F.when(finite, F.exp(F.col("score") - scale * SCALE)).otherwise(0.0)).alias("exps"),
        F.count(F.lit(1)).alias("n"),
        F.sum("score").alias("total"),
    )
    merged = states.groupBy("ctx").agg(
        F.max("scale").alias("top"),
        F.collect_list(F.when(F.col("scale").isNotNull(), F.struct("scale", "exps"))).alias("states"),
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
    )
    exps = F.aggregate(
        "states", F.lit(0.0), lambda acc, s: acc + s["exps"] * F.exp((s["scale"] - F.col("top")) * SCALE)
    )
    normaliser = F.coalesce(F.col("top") * SCALE + F.ln(exps), F.lit(_NEVER))
    return merged.select("ctx", normaliser.alias("log_sum_exp"), "n", "total")


def softmax(long: DataFrame, out: str = "prob") -> DataFrame:
    """Add each candidate's probability in its context.

    No side of the join is forced: a few contexts are broadcast, many are merged, and Spark splits a hot one.
    """
    sums = context_sums(long).select(F.col("ctx").alias("of"), "log_sum_exp")
    joined = long.join(sums, F.col("ctx").eqNullSafe(F.col("of")))
    prob = F.when(F.col("score") > _NEVER, F.exp(F.col("score") - F.col("log_sum_exp"))).otherwise(0.0)
    return joined.select("ctx", "cand", "score", prob.alias(out))


def top_k(long: DataFrame, k: int) -> DataFrame:
    """The ``k`` best candidates of each context (ties: smaller number), and their ``rank`` from 1; 0 keeps all.

    Segments of a context are cut to ``k`` each before they meet, so the last window sees ``SEGMENTS`` times ``k``
    rows of a context at most.
    """
    if k <= 0:
        return ranked(long).select("ctx", "cand", "score", "rank")
    order = [F.desc("score"), F.asc("cand")]
    segment = F.pmod(F.xxhash64("cand"), F.lit(SEGMENTS))
    inside = F.row_number().over(W.partitionBy("ctx", "segment").orderBy(*order))
    cut = long.withColumn("segment", segment).withColumn("rank", inside).filter(F.col("rank") <= k)
    place = F.row_number().over(W.partitionBy("ctx").orderBy(*order))
    return cut.withColumn("rank", place).filter(F.col("rank") <= k).select(
        "ctx", "cand", "score", F.col("rank").cast("long").alias("rank")
    )


def ranked(long: DataFrame) -> DataFrame:
    """Add ``prob``, ``rank`` (from 1, best first, ties by candidate) and ``before``, the probability ranked earlier.

    Equal scores of a context are one row of a smaller table, whose running counts and sums go by cells of the
    log-probability; a candidate's place among its equals goes by cells of its number. So neither a large context
    nor one large tie has to pass through one task.
    """
    sums = context_sums(long).select(F.col("ctx").alias("of"), "log_sum_exp")
    steps = long.groupBy("ctx", "score").agg(F.count(F.lit(1)).alias("equals"))
    steps = steps.join(sums, F.col("ctx").eqNullSafe(F.col("of")))
    below = F.when(F.col("score") > _NEVER, F.col("log_sum_exp") - F.col("score")).otherwise(LOWEST)
    prob = F.when(F.col("score") > _NEVER, F.exp(-below)).otherwise(0.0)
    steps = steps.select(
        "ctx", "score", "equals", prob.alias("prob"), (-F.col("score")).alias("worse"),
        F.floor(F.greatest(F.lit(0.0), F.least(below, F.lit(LOWEST))) * float(1 << STEP)).alias("depth"),
        (prob * F.col("equals")).alias("mass"),
    )
    for value, out in (("equals", "better"), ("mass", "before")):
        steps = sum_before(steps, "depth", value, out, ["ctx"], ["worse"], shifts=CELLS)
    steps = steps.select(F.struct("ctx", "score").alias("step"), "prob", "better", "before")
    # a place among equals: the key is a struct, so null contexts are kept
    rows = long.withColumns({"step": F.struct("ctx", "score"), "one": F.lit(1)})
    rows = sum_before(rows, "cand", "one", "same", ["step"]).join(steps, "step")
    return rows.select(
        "ctx", "cand", "score", "prob", (F.col("better") + F.col("same") + 1).alias("rank"),
        (F.col("before") + F.col("same") * F.col("prob")).alias("before"),
    )


def top_p(long: DataFrame, p: float) -> DataFrame:
    """The nucleus of each context: candidates with a probability of at most ``p`` ranked earlier, one at least."""
    placed = ranked(long)
    if p > 0:
        placed = placed.filter((F.col("before") <= p) | (F.col("rank") == 1))
    return placed.select("ctx", "cand", "score", "rank")


def draw(long: DataFrame, seed: int = 42) -> DataFrame:
    """``ctx, cand``: one reproducible categorical draw per context, by its candidates' log p plus Gumbel noise.

    The largest of a context is a maximum like any other: one row per context and task is shuffled.
    """
    text = F.concat_ws(":", F.lit(str(seed)), F.col("ctx").cast("string"), F.col("cand").cast("string"))
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
    noisy = F.col("score") - F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))
    best = F.max(F.struct(noisy.alias("value"), (-F.col("cand")).alias("neg")))
    return long.groupBy("ctx").agg(best.alias("best")).select("ctx", (-F.col("best.neg")).alias("cand"))


def cross_entropy(
    long: DataFrame, labels: DataFrame, ignore_index: int = -100, smoothing: float = 0.0, aux: float = 0.0
) -> DataFrame:
    """One row: contexts counted, smoothed mean loss over them, and the loss with the auxiliary term.

    ``labels`` has ``ctx, label``. A label that is null, or no candidate of its context, is an error, unless it is
    ``ignore_index``. Contexts without a label are not counted.
    """
    used = labels.filter(F.col("label").isNull() | (F.col("label") != ignore_index))
    used = used.select(F.struct("ctx").alias("of"), F.col("label").cast("long").alias("label"))
    sums = context_sums(long).select(F.struct("ctx").alias("of"), "log_sum_exp", "n", "total")
    chosen = long.select(F.struct("ctx").alias("of"), F.col("cand").alias("label"), F.col("score").alias("chosen"))
    joined = used.join(sums, "of", "left").join(chosen, ["of", "label"], "left")
    picked = F.when(F.col("chosen").isNotNull(), F.col("log_sum_exp") - F.col("chosen")).otherwise(
        F.raise_error(F.lit("a label is no candidate")).cast("double")
    )
    uniform = F.col("log_sum_exp") - F.col("total") / F.col("n")
    each = picked if smoothing == 0 else (1.0 - smoothing) * picked + smoothing * uniform
    return joined.agg(F.count(F.lit(1)).alias("n"), F.avg(each).alias("loss")).withColumn(
        "total_loss", F.col("loss") + F.lit(aux)
    )
