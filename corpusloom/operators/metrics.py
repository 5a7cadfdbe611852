"""Roll-ups of loss logs, cross-entropy of score rows, and routing load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scores import array_sum, log_sum_exp, ranked, softmax, top_k
from corpusloom.operators.order import sum_before


def windowed_history(
    log: DataFrame, every: int, epoch: str = "epoch", step: str = "step", loss: str = "loss"
) -> DataFrame:
    """Mean loss and perplexity per full window of ``every`` steps; counting restarts per epoch.

    Steps are numbered by the cell-wise running count, so one epoch may hold any share of the log.
    """
    numbered = sum_before(
        log.select(
            F.col(epoch).alias("epoch"), F.col(step).alias("step"), F.col(loss).alias("loss")
        ).withColumn("__one", F.lit(1)),
        "step", "__one", "__i", part=["epoch"],
    )
    return (
        numbered.groupBy("epoch", F.floor(F.col("__i") / every).alias("window"))
        .agg(F.count(F.lit(1)).alias("__n"), F.avg("loss").alias("mean_loss"))
        .filter(F.col("__n") == every)
        .select("epoch", "window", "mean_loss", F.exp("mean_loss").alias("perplexity"))
    )


def epoch_summary(log: DataFrame, epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """Mean of the batch losses per epoch, and its exponential."""
    return (
        log.groupBy(F.col(epoch).alias("epoch"))
        .agg(F.avg(loss).alias("mean_loss"))
        .withColumn("perplexity", F.exp("mean_loss"))
    )


def cross_entropy(
    df: DataFrame,
    scores: str = "scores",
    label: str = "label",
    ignore_index: int = -100,
    smoothing: float = 0.0,
    aux: float = 0.0,
) -> DataFrame:
    """One row: rows counted, smoothed mean loss over them, and the loss with the auxiliary term.

    A label that is null or no class is an error, unless it is ``ignore_index``.
    """
    used = df.filter(F.col(label).isNull() | (F.col(label) != ignore_index))
    valid = F.col(label).isNotNull() & (F.col(label) >= 0) & (F.col(label) < F.size(scores))
    norm = log_sum_exp(F.col(scores))
    picked = F.when(valid, norm - F.get(scores, F.col(label))).otherwise(
        F.raise_error(F.lit("a label is no class")).cast("double")
    )
    # mean over classes of (norm - score)
    uniform = norm - array_sum(F.col(scores)) / F.size(scores)
    each = (1.0 - smoothing) * picked + smoothing * uniform
    return used.agg(F.count(F.lit(1)).alias("n"), F.avg(each).alias("loss")).withColumn(
        "total_loss", F.col("loss") + F.lit(aux)
    )


def route(df: DataFrame, k: int, scores: str = "scores", out: str = "routed") -> DataFrame:
    """Add the ``k`` best categories with weights that are a soft-max over those ``k``."""
    best = F.col("__best")
    weights = softmax(best["score"])
    return (
        df.withColumn("__best", top_k(ranked(F.col(scores)), k))
        .withColumn(
            out,
            F.arrays_zip(best["cand"].alias("cand"), weights.alias("weight")),
        )
        .drop("__best")
    )


def route_load(df: DataFrame, k: int, categories: int, scores: str = "scores") -> DataFrame:
    """Per category its share of all assignments, with the balance term and the worst share.

    The balance term weighs shares by a uniform target, so it is 1 whatever the shares are;
    ``worst`` (largest share times the number of categories) is what shows an imbalance. Without
    assignments all shares are 0, and so are both.
    """
    spark = df.sparkSession
    chosen = top_k(ranked(F.col(scores)), k)["cand"]
    counts = (
        df.select(F.explode_outer(chosen).alias("cand"))
        .filter(F.col("cand").isNotNull())
        .groupBy("cand")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # one row per category from here on
    every = spark.range(categories).select(F.col("id").cast("int").alias("cand"))
    shares = (
        every.join(counts, "cand", "left")
        .agg(F.collect_list(F.struct("cand", F.coalesce("n", F.lit(0)).alias("n"))).alias("c"))
        .withColumn("__total", F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
        .withColumn("c", F.transform("c", lambda x: F.struct(
            x["cand"].alias("cand"),
            F.when(F.col("__total") > 0, F.try_divide(x["n"], F.col("__total"))).otherwise(0.0).alias("share"))))
    )
    balance = categories * array_sum(
        F.transform(F.col("c.share"), lambda s: s / F.lit(float(categories)))
    )
    return shares.select(
        F.explode("c").alias("x"),
        balance.alias("balance"),
        (F.array_max("c.share") * categories).alias("worst"),
    ).select("x.cand", "x.share", "balance", "worst")
