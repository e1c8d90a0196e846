"""Domains of a contact matrix by a Poisson model: counts around exp(b1 + b2 + d1 * d2), b a bias and d a position on the axis between two kinds of domains.

The model's sums go over all pairs, seen or not. exp(d1 * d2) is the series of (d1 * d2) ** k / k!, so that an element's sum over all others is made of the sums
of exp(b) * d ** k over all elements, ``TERMS`` numbers; contacts come in by a join. No pair is listed that was not seen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Terms of the series, and the largest size of d: d1 * d2 is at most 4, and what is left of the series under 1e-9 of it.
TERMS, LARGEST = 28, 2.0


def _powers(sums: list[float], first: int) -> Column:
    """Sum over k of d ** k / k! * sums[k + first]: an element's sum of exp(b2 + d1 * d2) * d2 ** first over all others, and itself."""
    total = F.lit(0.0)
    for k in range(TERMS - 1, -1, -1):
        total = F.lit(sums[k + first] / math.factorial(k)) + F.col("d") * total
    return total


def _sums(state: DataFrame) -> list[float]:
    terms = [F.sum(F.exp("b") * F.pow("d", F.lit(float(k)))) for k in range(TERMS + 3)]
    return [x or 0.0 for x in state.agg(*terms).first()]


def fit_domains(matrix: DataFrame, start: DataFrame, steps: int = 50, rate: float = 0.5, least_gain: float = 1e-6) -> tuple[DataFrame, list[float]]:
    """((id, b, d), log-likelihoods without constants): from ``start`` (id, value) as d, clipped to ``LARGEST``, and biases by the elements' totals.

    ``matrix`` (id1, id2, n) has each unordered pair once and counts for both orders; the model's sums hold each element with itself too. A step moves
    each element's b and d by its own slope over its own curvature, times ``rate``, halved until the likelihood has risen; steps end with a gain under ``least_gain`` of it.
    """
    off = matrix.where("id1 <> id2")
    ends = off.select(F.col("id1").alias("id"), F.col("id2").alias("other"), F.col("n").cast("double").alias("n")).unionByName(off.select(F.col("id2").alias("id"), F.col("id1").alias("other"), F.col("n").cast("double").alias("n")))
    ends = written(ends.unionByName(matrix.where("id1 = id2").select(F.col("id1").alias("id"), F.col("id1").alias("other"), F.col("n").cast("double").alias("n"))), "domain-ends")
    totals = ends.groupBy("id").agg(F.sum("n").alias("t"))
    overall = totals.agg(F.sum("t")).first()[0]
    clip = lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c))
    if not overall:
        return matrix.sparkSession.createDataFrame([], "id long, b double, d double"), []
    begin = totals.join(start.select("id", F.col("value").cast("double").alias("_v")), "id", "left")
    state = written(begin.select("id", F.log(F.col("t") / math.sqrt(overall)).alias("b"), clip(F.coalesce("_v", F.lit(0.0))).alias("d"), "t"), "domains")

    def met(now: DataFrame) -> DataFrame:
        """(id, b, d, t, s): with s, the sum of n * d over an element's contacts."""
        seen = ends.join(now.select(F.col("id").alias("other"), F.col("d").alias("_d")), "other").groupBy("id").agg(F.sum(F.col("n") * F.col("_d")).alias("s"))
        return now.join(seen, "id")

    def likelihood(with_seen: DataFrame, sums: list[float]) -> float:
        one = 2 * F.col("t") * F.col("b") + F.col("s") * F.col("d") - F.exp("b") * _powers(sums, 0)
        return with_seen.agg(F.sum(one)).first()[0]

    sums, here = _sums(state), written(met(state), "domains")
    trace = [likelihood(here, sums)]
    for _ in range(steps):
        e = F.exp("b")
        slopes = here.select(
            "id", "b", "d", "t", ((F.col("t") - e * _powers(sums, 0)) / (e * _powers(sums, 0))).alias("gb"), ((F.col("s") - e * _powers(sums, 1)) / (e * _powers(sums, 2))).alias("gd")
        )
        moved, size, better = written(slopes, "domain-slopes"), rate, None
        for _ in range(20):
            tried = moved.select("id", (F.col("b") + size * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("gb")))).alias("b"), clip(F.col("d") + size * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("gd")))).alias("d"), "t")
            there = written(met(tried), "domains")
            new = _sums(there)
            now = likelihood(there, new)
            if now > trace[-1]:
                better = (there, new, now)
                break
            size /= 2
        if better is None:
            break
        here, sums, now = better
        trace.append(now)
        if trace[-1] - trace[-2] < least_gain * abs(trace[-2]):
            break
    return here.select("id", "b", "d"), trace
