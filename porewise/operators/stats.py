"""Tests of two samples: moments and rank sums from Spark, closed forms on the few numbers left."""

from __future__ import annotations

from collections import Counter
from fractions import Fraction
from functools import lru_cache, reduce
from itertools import pairwise
from math import asinh, comb, copysign, erfc, exp, isnan, lcm, lgamma, log, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialize
from .selection import PIECES, exponent, piece


def skew_score(n: int, g1: float) -> float:
    """D'Agostino's transformed skewness."""
    y = g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) or 1.0
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = sqrt(2 * (b2 - 1)) - 1
    return asinh(y / sqrt(2 / (w2 - 1))) / sqrt(log(w2) / 2)


def kurtosis_score(n: int, excess: float) -> float:
    """Anscombe and Glynn's transformed kurtosis."""
    expected = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (excess + 3 - expected) / sqrt(variance)
    b = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b * (2 / b + sqrt(1 + 4 / (b * b)))
    d = 1 + x * sqrt(2 / (a - 4))
    root = copysign(abs((1 - 2 / a) / d) ** (1 / 3), d)
    return (1 - 2 / (9 * a) - root) / sqrt(2 / (9 * a))


def normal_p(n: int, g1: float, excess: float) -> float:
    """Omnibus test of normality; needs 8 values."""
    if n < 8:
        raise ValueError("fewer than 8 values")
    if isnan(g1) or isnan(excess):
        return float("nan")
    return exp(-(skew_score(n, g1) ** 2 + kurtosis_score(n, excess) ** 2) / 2)


def bartlett_p(n1: int, v1: float, n2: int, v2: float) -> float:
    """Equal variances of two samples."""
    if v1 <= 0 or v2 <= 0:
        return float("nan")
    d1, d2 = n1 - 1, n2 - 1
    pooled = (d1 * v1 + d2 * v2) / (d1 + d2)
    t = (d1 + d2) * log(pooled) - d1 * log(v1) - d2 * log(v2)
    t /= 1 + (1 / d1 + 1 / d2 - 1 / (d1 + d2)) / 3
    return erfc(sqrt(max(0.0, t) / 2))


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        term = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + term * d) or 1e-300)
        c = (1 + term / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_test_p(n1: int, m1: float, v1: float, n2: int, m2: float, v2: float) -> float:
    """Two-sided, pooled variance."""
    df = n1 + n2 - 2
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / df
    t2 = (m1 - m2) ** 2 / (pooled * (1 / n1 + 1 / n2))
    return beta_cdf(df / 2, 0.5, df / (df + t2))


@lru_cache
def _differences(m: int) -> tuple[int, list[list[int]]]:
    """A period and, for each remainder, the differences by which the number of partitions of at most s into parts up to m goes on.

    On each remainder of the period these numbers are a polynomial of degree m in s, so m + 1 of them tell all.
    """
    period = lcm(*range(1, m + 1))
    counts = [1] * (period * (m + 1))  # parts of 1, of "at most"
    for part in range(1, m + 1):
        for i in range(part, len(counts)):
            counts[i] += counts[i - part]
    out = []
    for r in range(period):
        values, first = counts[r::period], []
        while values:
            first.append(values[0])
            values = [b - a for a, b in pairwise(values)]
        out.append(first)
    return period, out


def _orders_up_to(m: int, n: int, u: int) -> int:
    """How many orders of samples of m and n values give a U of at most ``u``, exact at any size of n.

    U counts partitions into at most m parts of at most n: those into parts up to m, less what exceeds n
    by inclusion and exclusion over the sizes that do.
    """
    period, differences = _differences(m)
    terms = Counter({(0, 0): 1})
    for k in range(1, m + 1):
        terms.update({(c + 1, w + k): -v for (c, w), v in list(terms.items())})
    total = 0
    for (c, w), sign in terms.items():
        rest = u - c * n - w
        if rest >= 0:
            total += sign * sum(comb(rest // period, j) * d for j, d in enumerate(differences[rest % period]))
    return total


def mann_whitney_p(n1: int, n2: int, rank_sum: float, ties: int) -> float:
    """Two-sided; exact without ties where a sample has 8 values at most, else normal with corrections for ties and continuity."""
    u1 = rank_sum - n1 * (n1 + 1) / 2
    u = max(u1, n1 * n2 - u1)
    if min(n1, n2) <= 8 and ties == 0:
        m, n = sorted((n1, n2))
        return min(1.0, float(Fraction(2 * _orders_up_to(m, n, int(n1 * n2 - u)), comb(m + n, m))))
    n = n1 + n2
    variance = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
    if variance <= 0:
        return 1.0
    return min(1.0, erfc((u - n1 * n2 / 2 - 0.5) / sqrt(variance) / sqrt(2)))


def value_counts(rates: DataFrame) -> DataFrame:
    """(metric, grp, value, n): how often each value of (grp, metric, value) is there."""
    return rates.where("value is not null").groupBy("metric", "grp", "value").agg(F.count("*").alias("n"))


def moments(counted: DataFrame) -> DataFrame:
    """Of counted values: count, mean, sample variance, population skewness and excess kurtosis."""
    n, mean = F.col("n").cast("double"), F.sum(F.col("n") * F.col("value")) / F.sum("n")
    # one value alone is its mean, not what rounding makes of it: its variance is zero
    means = counted.groupBy("metric", "grp").agg(F.when(F.min("value") == F.max("value"), F.min("value")).otherwise(mean).alias("mean"))
    off = F.col("value") - F.col("mean")
    powers = counted.join(F.broadcast(means), ["metric", "grp"]).groupBy("metric", "grp", "mean")  # one row for each metric and group
    powers = powers.agg(F.sum("n").alias("n"), *(F.sum(reduce(lambda a, b: a * b, [off] * i, n)).alias(f"m{i}") for i in (2, 3, 4)))
    n, m2, m3, m4 = map(F.col, ("n", "m2", "m3", "m4"))
    return powers.select("metric", "grp", "n", "mean", F.try_divide(m2, n - 1).alias("variance"), F.try_divide(F.sqrt(n) * m3, F.pow(m2, 1.5)).alias("skewness"), (F.try_divide(n * m4, m2 * m2) - 3).alias("kurtosis"))


def rank_sums(rates: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(metric, pair, rank_sum of the first sample, ties = sum of t^3 - t) of (grp, metric, value), average ranks."""
    return ranked_counts(value_counts(rates), pairs)


def ranked_counts(counted: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """The same of counted values.

    Only counts go to the pairs of a group; ranks then come from counts in stretches of the value range
    and within each stretch, so that no metric is sorted in one task, whatever outliers it has.
    """
    pair = F.explode(F.array(*(F.struct(F.lit(i).alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(pairs)))).alias("p")
    rows = counted.select("metric", "grp", "value", "n", pair).where((F.col("grp") == F.col("p.a")) | (F.col("grp") == F.col("p.b")))
    counts = rows.groupBy("metric", F.col("p.pair").alias("pair"), "value").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("grp") == F.col("p.a"), F.col("n")).otherwise(0)).alias("first"))
    # by sign and binary exponent, then in pieces of what each exponent spans: an outlier has an exponent of its own
    counts = counts.withColumn("exponent", exponent(F.col("value")))
    span = counts.groupBy("metric", "pair", "exponent").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    placed = counts.join(F.broadcast(span), ["metric", "pair", "exponent"]).withColumn("stretch", F.col("exponent") * PIECES + piece(F.col("value"), F.col("low"), F.col("high")))
    sums = placed.groupBy("metric", "pair", "stretch").agg(F.sum("n").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("metric", "pair").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    begins = sums.select("metric", "pair", "stretch", F.coalesce(upto, F.lit(0)).alias("begin"))
    inside = F.sum("n").over(Window.partitionBy("metric", "pair", "stretch").orderBy("value").rowsBetween(Window.unboundedPreceding, -1))
    ranked = placed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(begins, ["metric", "pair", "stretch"])
    rank, n = F.col("begin") + F.col("inside") + (F.col("n") + 1) / 2, F.col("n").cast("double")  # cubes exceed a long
    return ranked.groupBy("metric", "pair").agg(F.sum(F.col("first") * rank).alias("rank_sum"), F.sum(n * n * n - n).alias("ties"))


def compare_groups(rates: DataFrame, with_counterpart: bool, alpha: float = 0.05) -> DataFrame:
    """(metric, first, second, p, test): t-test where both samples pass for normal with equal variances, else Mann-Whitney.

    ``test`` is ERROR where a sample is missing or too small to be tested for normality.
    """
    pairs = [(0, 1), (2, 3), (0, 2), (1, 3)] if with_counterpart else [(0, 1)]
    counted = materialize(value_counts(rates), "value-counts")
    m = {(r["metric"], r["grp"]): r for r in moments(counted).collect()}  # one row for each metric and group
    ranks = {(r["metric"], r["pair"]): r for r in ranked_counts(counted, pairs).collect()}
    out = []
    for metric in sorted({k for k, _ in m}):
        for i, (a, b) in enumerate(pairs):
            x, y = m.get((metric, a)), m.get((metric, b))
            try:
                if x is None or y is None:
                    raise ValueError("a sample is missing")
                number = lambda v: float("nan") if v is None else v
                normal = all(normal_p(s["n"], number(s["skewness"]), number(s["kurtosis"])) >= alpha for s in (x, y))
                if normal and bartlett_p(x["n"], x["variance"], y["n"], y["variance"]) >= alpha:
                    p, test = t_test_p(x["n"], x["mean"], x["variance"], y["n"], y["mean"], y["variance"]), "TT"
                else:
                    r = ranks[(metric, i)]
                    p, test = mann_whitney_p(x["n"], y["n"], r["rank_sum"], r["ties"]), "MWU"
            except ValueError:
                p, test = None, "ERROR"
            out.append((metric, a, b, p, test))
    return rates.sparkSession.createDataFrame(out, "metric string, first int, second int, p double, test string")
