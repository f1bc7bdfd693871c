"""Scalar functions that Spark lacks, as column expressions, and statistics of over-fitting."""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EULER = 0.5772156649015329


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def erf(x: Column | str) -> Column:
    """Error function: its power series near 0, a continued fraction of the complement beyond 3."""
    x = _col(x)
    steps = lambda n: F.sequence(F.lit(1), F.lit(n))
    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc: Column, n: Column) -> Column:
        term = -acc["term"] * x * x / n
        return F.struct(term.alias("term"), (acc["total"] + term / (2 * n + 1)).alias("total"))

    near = 2 / math.sqrt(math.pi) * x * F.aggregate(steps(60), one, add)["total"]
    fraction = F.aggregate(steps(40), F.lit(0.0), lambda acc, k: ((41 - k) / 2.0) / (F.abs(x) + acc))
    far = F.signum(x) * (1 - F.exp(-x * x) / math.sqrt(math.pi) / (F.abs(x) + fraction))
    return F.when(F.abs(x) < 3, near).when(F.abs(x) < 27, far).when(x.isNotNull(), F.signum(x))


def norm_cdf(x: Column | str) -> Column:
    return 0.5 * (1 + erf(_col(x) / math.sqrt(2)))


#: Coefficients of a published rational approximation of the normal quantile (numerators, denominators; centre, tail).
PPF = {
    "a": (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239),
    "b": (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0),
    "c": (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783),
    "d": (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0),
}


def norm_ppf(p: Column | str) -> Column:
    """Normal quantile; NULL outside (0, 1). An approximation to nine digits, then one step of Newton's method."""
    p = _col(p)

    def poly(name: str, x: Column) -> Column:
        out = F.lit(0.0)
        for k in PPF[name]:
            out = out * x + k
        return out

    q = p - 0.5
    tail = lambda s: poly("c", s) / poly("d", s)
    first = F.when(p < 0.02425, tail(F.sqrt(-2 * F.ln(p)))).when(p > 1 - 0.02425, -tail(F.sqrt(-2 * F.ln(1 - p)))).otherwise(poly("a", q * q) * q / poly("b", q * q))
    value = F.aggregate(F.array(first), F.lit(0.0), lambda acc, z: z - (norm_cdf(z) - p) * math.sqrt(2 * math.pi) * F.exp(z * z / 2))
    return F.when((p > 0) & (p < 1), value)


def expected_maximum(trials: int) -> float:
    """Expected largest of ``trials`` standard normal draws."""
    if trials < 2:
        return 0.0
    z = NormalDist().inv_cdf
    return (1 - EULER) * z(1 - 1 / trials) + EULER * z(1 - 1 / (trials * math.e))


def deflated_sharpe(sharpe: Column, n: Column, skew: Column, kurtosis: Column, trials: int, variant: str, variance: float = 0.0) -> Column:
    """Sharpe ratio made up for ``trials`` tries; five formulas that don't agree. ``kurtosis`` of a normal is 3.

    ``risk``: probability by a simplified bound, without the sample's size. ``annual``: of a yearly
    ratio, against sqrt(2 ln N). ``haircut``: the ratio less the expected maximum, no probability.
    ``exact``: probability of a total ratio, per observation. ``research``: probability with the
    variance of the trials' ratios.
    """
    s, shape = sharpe, 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe
    if variant == "risk":
        star = math.sqrt(0.5) * math.erfc(math.sqrt(1 / (2 * trials)))
        return F.when(shape > 0, norm_cdf((s - star) / F.sqrt(shape))).otherwise(0.0)
    if variant == "annual":
        root = math.sqrt(2 * math.log(trials)) if trials > 1 else 0.0
        best = root + (EULER / root if root else 0.0)
        spread = F.greatest(F.lit(1e-8), (1 + 0.5 * s * s - skew * s + (kurtosis - 3) / 4 * s * s) / (n - 1))
        return norm_cdf((s - best) / F.sqrt(spread))
    if variant == "haircut":
        return F.when(n <= 1, s).otherwise(s - F.sqrt(F.greatest(F.lit(1e-8), shape / (n - 1))) * expected_maximum(trials))
    if variant == "exact":
        each = s / F.sqrt(n)
        correction = F.greatest(F.lit(1e-8), 1 - skew * each + (kurtosis - 1) / 4 * each * each)
        return F.when((s <= 0) | (n <= 1) | s.isNull(), 0.0).otherwise(norm_cdf(each / F.sqrt(correction / n) - expected_maximum(trials)))
    if variant == "research":
        spread = (1 + 0.5 * s * s - skew * s + (kurtosis - 3) / 4 * s * s) / F.greatest(F.lit(1), n - 1)
        return F.when(spread > 0, norm_cdf((s - math.sqrt(variance) * expected_maximum(trials)) / F.sqrt(spread))).otherwise(0.0)
    raise ValueError(f"unknown variant {variant}")


def probability_of_overfitting(folds: DataFrame, count: int, least: int = 30) -> DataFrame:
    """Share of symmetric splits of the folds in which the winner inside is below the median outside: one row, ``pbo``.

    Needs ``genome, fold, sharpe, trades`` with folds from 0 to ``count - 1``; NULL if a fold of any
    genome has fewer than ``least`` trades, 0.5 for fewer than two folds. Every choice of half the
    folds (rounded down) is a split; of equal winners the smallest genome counts.
    """
    if count < 2:
        return folds.sparkSession.createDataFrame([(0.5,)], "pbo double")
    splits = [list(c) for c in itertools.combinations(range(count), count // 2)]
    each = folds.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.array(*map(F.lit, c)).alias("c")) for i, c in enumerate(splits)])))
    inside = F.array_contains(F.col("_s.c"), F.col("fold"))
    per = each.groupBy(F.col("_s.i").alias("_i"), "genome").agg(F.avg(F.when(inside, F.col("sharpe"))).alias("a"), F.avg(F.when(~inside, F.col("sharpe"))).alias("b"), F.min("trades").alias("t"))
    lost = per.groupBy("_i").agg(F.max_by("b", F.struct("a", -F.col("genome"))).alias("w"), F.percentile("b", F.lit(0.5)).alias("m"), F.min("t").alias("t"))
    return lost.agg(F.when(F.min("t") >= least, F.avg((F.col("w") < F.col("m")).cast("double"))).alias("pbo"))


def tail_overfitting(sharpe: Column, best: Column, n: Column) -> Column:
    """A second "probability of over-fitting": just the normal tail of the ratio above the expected maximum."""
    return 1 - norm_cdf((sharpe - best) / F.greatest(F.lit(1e-6), F.sqrt(1 / n)))
