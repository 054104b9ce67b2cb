"""Paired significance and retrieval metrics as columns over one-row aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(0.0)


def precision_recall(tp: Column, fp: Column, fn: Column, tn: Column | None = None) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    out = [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]
    return out + ([ratio(tp + tn, tp + fp + fn + tn).alias("accuracy")] if tn is not None else [])


def mcnemar_chi2(only_a: Column, only_b: Column) -> Column:
    """With continuity correction; 0 without discordant pairs."""
    d = only_a + only_b
    return F.when(d > 0, F.pow(F.abs(only_a - only_b) - 1, F.lit(2)) / d).otherwise(0.0)


def exact_two_sided(only_a: Column, only_b: Column) -> Column:
    """Exact binomial p of discordant pairs: twice the lower tail, at most 1, by a running product of terms in logs."""
    n, k = (only_a + only_b).cast("double"), F.least(only_a, only_b).cast("int")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log(n - i + 1) - F.log(i.cast("double"))
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(terms, start, step)["sum"]))


def chi2_p(chi2: Column) -> Column:
    """Upper tail of one degree of freedom, erfc(sqrt(x / 2)), by a rational approximation good to 1.2e-7."""
    z = F.sqrt(chi2 / 2)
    t = 1 / (1 + 0.5 * z)
    # Chebyshev coefficients of the published erfc approximation.
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        poly = poly * t + c
    return t * F.exp(-z * z + poly)
