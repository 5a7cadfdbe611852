"""Column functions over one context's candidate scores, held as ``array<double>``.

A context is one row, so soft-max, ranking and running sums need neither a shuffle nor a window.
Filtered candidates are ``array<struct<cand:int, score:double>>`` ordered by score, best first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once; a lambda would recompute it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def scale(scores: Column, temperature: float) -> Column:
    return F.transform(scores, lambda s: s.cast("double") / F.lit(float(temperature)))


def _exps(scores: Column) -> Column:
    return let(F.array_max(scores), lambda top: F.transform(scores, lambda s: F.exp(s - top)))


def softmax(scores: Column) -> Column:
    return let(
        _exps(scores),
        lambda exps: let(
            array_sum(exps), lambda total: F.transform(exps, lambda e: e / total)
        ),
    )


def log_sum_exp(scores: Column) -> Column:
    return F.array_max(scores) + F.ln(array_sum(_exps(scores)))


def ranked(scores: Column) -> Column:
    """Candidates by score descending, ties by candidate number."""
    keyed = F.transform(
        scores, lambda s, i: F.struct((-s).alias("neg"), i.alias("cand"))
    )
    return F.transform(
        F.sort_array(keyed),
        lambda e: F.struct(e["cand"].alias("cand"), (-e["neg"]).alias("score")),
    )


def top_k(candidates: Column, k: int) -> Column:
    """First ``k`` of ranked candidates; 0 keeps all."""
    return F.slice(candidates, 1, k) if k > 0 else candidates


def nucleus_size(probabilities: Column, p: float) -> Column:
    """How many leading probabilities have a sum of at most ``p`` before them (at least one)."""
    start = F.struct(F.lit(0.0).alias("before"), F.lit(0).alias("kept"))
    walked = F.aggregate(
        probabilities,
        start,
        lambda acc, x: F.struct(
            (acc["before"] + x).alias("before"),
            F.when((acc["before"] <= p) | (acc["kept"] == 0), acc["kept"] + 1)
            .otherwise(acc["kept"])
            .alias("kept"),
        ),
    )
    return walked["kept"]


def top_p(candidates: Column, p: float) -> Column:
    """Nucleus of ranked candidates, on their renormalised scores; 0 keeps all."""
    if p <= 0:
        return candidates
    return F.slice(candidates, F.lit(1), nucleus_size(softmax(candidates["score"]), p))


def draw(candidates: Column, context: Column, seed: int) -> Column:
    """One reproducible categorical draw: the arg-max of log p plus Gumbel noise from a hash."""

    def noise(cand: Column) -> Column:
        text = F.concat_ws(":", F.lit(str(seed)), context.cast("string"), cand.cast("string"))
        h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
        return -F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))

    # the soft-max normaliser is the same for all candidates, so raw scores order alike
    best = F.array_max(
        F.transform(
            candidates,
            lambda e: F.struct(
                (e["score"] + noise(e["cand"])).alias("value"), (-e["cand"]).alias("neg")
            ),
        )
    )
    return -best["neg"]
