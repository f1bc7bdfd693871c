"""Forecast services as column expressions: ranges, paths, quality, reliability, decisions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Multiples of volatility and floors for the quantiles of favourable and adverse moves.
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
MFE = (0.35, 0.55, 0.85, 1.25, 1.75)
MAE = (0.40, 0.65, 1.10, 1.55, 2.20)
FLOORS = (0.001, 0.002, 0.004, 0.007, 0.010)


def range_forecast(rows: DataFrame, price: str = "close", vol: str = "vol_24") -> DataFrame:
    """Five favourable and five adverse quantiles as multiples of volatility (at least 0.5 %) with floors, and price bands."""
    v = F.greatest(F.lit(0.005), F.coalesce(F.col(vol), F.lit(0.0)))
    out = rows
    for q, up, down, least in zip(QUANTILES, MFE, MAE, FLOORS, strict=True):
        n = round(q * 100)
        out = out.withColumn(f"mfe_p{n}", F.greatest(F.lit(least), up * v)).withColumn(f"mae_p{n}", F.greatest(F.lit(least), down * v))
        out = out.withColumn(f"upper_p{n}", F.col(price) * (1 + F.col(f"mfe_p{n}"))).withColumn(f"lower_p{n}", F.col(price) * (1 - F.col(f"mae_p{n}")))
    return out


def non_crossing(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Running maximum across quantile columns."""
    out, done = rows, None
    for c in columns:
        done = F.col(c) if done is None else F.greatest(done, F.col(c))
        out = out.withColumn(f"{c}_sorted", done)
    return out


def path(rows: DataFrame, steps: int = 24) -> DataFrame:
    """A row a step: the centre drifts linearly to the median move of the direction, the bands widen with the root of time.

    Needs the columns of ``range_forecast`` and ``direction, uncertainty``.
    """
    out = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    part, root, p = F.col("step") / float(steps), F.sqrt(F.col("step") / float(steps)), F.col("close")
    centre = p * (1 + F.when(F.col("direction") == "BULLISH", F.col("mfe_p50")).when(F.col("direction") == "BEARISH", -F.col("mae_p50")).otherwise(0.0) * part)
    return out.withColumn("projected", centre).withColumn("band_high", p * (1 + F.col("mfe_p90") * root)).withColumn("band_low", p * (1 - F.col("mae_p90") * root)).withColumn("spread", F.col("uncertainty") * root)


def uncertainty(low: Column, high: Column, middle: Column, score: Column, degraded: Column) -> tuple[Column, Column, Column]:
    """Relative width of the favourable quantiles, its confidence tier, and the coverage to expect in percent."""
    relative = F.greatest(F.lit(1e-6), high - low) / F.greatest(F.lit(1e-6), middle)
    bad, fair = degraded | (score < 0.70) | (relative >= 2.50), (relative >= 1.80) | (score < 0.90)
    tier = F.when(bad, "LOW_CONFIDENCE").when(fair, "MODERATE").otherwise("HIGH")
    return relative, tier, F.when(bad, 88.67 * F.greatest(F.lit(0.5), score)).when(fair, 88.67 * 0.95).otherwise(88.67)


def tradeability(mfe: Column, mae: Column, tier: Column, cost: float = 0.0016) -> tuple[Column, Column]:
    """Utility of the median moves in percent, and its category."""
    raw = mfe - 1.5 * mae - cost
    return raw * 100, F.when((tier == "LOW_CONFIDENCE") | (raw < -0.0050), "LOW").when(raw < 0.0020, "MEDIUM").otherwise("HIGH")


def direction_overlay(mfe: Column, mae: Column, p: Column, tier: Column, bullish: float = 1.40, bearish: float = 0.70) -> tuple[Column, Column]:
    """Asymmetry of the median moves; a direction only if it and the probability agree."""
    asymmetry = mfe / (mae + 1e-6)
    state = F.when(tier == "LOW_CONFIDENCE", "LOW_CONFIDENCE").when((asymmetry >= bullish) & (p >= 0.65), "BULLISH").when((asymmetry <= bearish) & (p <= 0.35), "BEARISH").otherwise("NO_DIRECTIONAL_EDGE")
    return asymmetry, state


def decision(p: Column, risk: Column) -> Column:
    """Long or short beyond the thresholds, which are wider under event risk; else flat."""
    hi, lo = F.when(risk, 0.58).otherwise(0.54), F.when(risk, 0.42).otherwise(0.46)
    return F.when(p > hi, "LONG").when(p < lo, "SHORT").otherwise("FLAT")


def quality_gate(price: Column, vol: Column, rsi: Column) -> Column:
    """INVALID without a price or without both features, DEGRADED without one of them, else VALID."""
    gone = lambda x: x.isNull() | F.isnan(x)
    return F.when(gone(price) | (price <= 0) | (gone(vol) & gone(rsi)), "INVALID").when(gone(vol) | gone(rsi), "DEGRADED").otherwise("VALID")


def complete_forecast(rows: DataFrame, price: str = "close", vol: str = "vol_24", rsi: str = "rsi_14", p: str = "p") -> DataFrame:
    """Ranges with quality, uncertainty, direction and tradeability, as one service call gives them."""
    out = range_forecast(rows, price, vol).withColumn("quality", quality_gate(F.col(price), F.col(vol), F.col(rsi)))
    degraded = F.col("quality") != "VALID"
    relative, tier, coverage = uncertainty(F.col("mfe_p10"), F.col("mfe_p90"), F.col("mfe_p50"), F.when(degraded, 0.85).otherwise(1.0), degraded)
    out = out.withColumn("uncertainty", relative).withColumn("confidence", tier).withColumn("expected_coverage", coverage)
    asymmetry, state = direction_overlay(F.col("mfe_p50"), F.col("mae_p50"), F.col(p), F.col("confidence"))
    score, category = tradeability(F.col("mfe_p50"), F.col("mae_p50"), F.col("confidence"))
    return out.withColumn("asymmetry", asymmetry).withColumn("direction", state).withColumn("tradeability", score).withColumn("tradeability_category", category)


def conformal_radius(residuals: DataFrame, column: str, by: list[str], alpha: float = 0.1) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest absolute residual per group; the largest if n is too small."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by)
    k = residuals.where(F.col(column).isNotNull()).withColumn("_a", F.abs(column)).withColumn("_k", F.row_number().over(w.orderBy("_a"))).withColumn("_n", F.count("*").over(w))
    at = F.least(F.ceil((F.col("_n") + 1) * (1 - alpha) - 1e-9), F.col("_n"))
    return k.groupBy(*by).agg(F.max(F.when(F.col("_k") == at, F.col("_a"))).alias("radius"), F.max("_n").alias("n"))


def reliability_score(coverage: Column, error: Column, psi: Column, healthy: Column, blocks: Column) -> tuple[Column, Column]:
    """Score of 100 from coverage (%), error (%), drift, health and independent blocks; and its tier."""
    c = F.greatest(F.lit(0.0), 100 - F.abs(coverage - 90) * 15)
    e = F.greatest(F.lit(0.0), 100 - error / 0.50 * 40)
    d = F.when(psi < 0.05, 100.0).when(psi < 0.10, 80.0).otherwise(40.0)
    s = F.when(blocks >= 30, 100.0).otherwise(blocks / 30 * 80)
    score = 0.25 * c + 0.25 * e + 0.20 * d + 0.15 * F.when(healthy, 100.0).otherwise(20.0) + 0.15 * s
    tier = F.when((score >= 85) & (blocks >= 30), "VERY_HIGH").when(score >= 75, "HIGH").when(score >= 60, "MODERATE").when(score >= 40, "LOW").otherwise("INSUFFICIENT")
    return score, tier


def harmonic(*factors: Column) -> Column:
    """Harmonic mean of factors, each at least 1e-4: the weakest counts most."""
    total = sum((1 / F.greatest(f, F.lit(1e-4)) for f in factors), F.lit(0.0))
    return len(factors) / total


def blended(probabilities: list[Column], weights: list[Column]) -> Column:
    """Soft blend of expert forecasts; equal weights if all are zero."""
    total = sum(weights, F.lit(0.0))
    mixed = sum((p * w for p, w in zip(probabilities, weights, strict=True)), F.lit(0.0))
    return F.coalesce(F.try_divide(mixed, F.nullif(total, F.lit(0.0))), sum(probabilities, F.lit(0.0)) / len(probabilities))


def data_reliability(values: list[Column], degraded: Column, latency_ms: Column | None = None) -> Column:
    """Share of values that are there and finite, less for degraded sources and slow feeds."""
    share = sum((F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), 1.0).otherwise(0.0) for v in values), F.lit(0.0)) / len(values)
    slow = F.lit(1.0) if latency_ms is None else F.when(latency_ms > 1000, F.greatest(F.lit(0.5), 1 - (latency_ms - 1000) / 4000)).otherwise(1.0)
    return F.least(F.greatest(share * F.when(degraded, 0.70).otherwise(1.0) * slow, F.lit(0.0)), F.lit(1.0))


def regime_certainty(probabilities: list[Column]) -> Column:
    """One less the entropy of the regime probabilities as a share of its maximum."""
    total = sum(probabilities, F.lit(0.0))
    shares = [F.try_divide(p, F.nullif(total, F.lit(0.0))) for p in probabilities]
    entropy = -sum((F.when(q > 0, q * F.ln(q)).otherwise(0.0) for q in shares), F.lit(0.0))
    return F.coalesce(F.least(F.greatest(1 - entropy / math.log(len(probabilities)), F.lit(0.0)), F.lit(1.0)), F.lit(0.5))


def model_agreement(probabilities: list[Column], certainty: Column) -> Column:
    """One less twice the models' spread; models that all idle at a half say no more than the regime does."""
    n = len(probabilities)
    mean = sum(probabilities, F.lit(0.0)) / n
    spread = F.sqrt(sum(((p - mean) * (p - mean) for p in probabilities), F.lit(0.0)) / n)
    return F.least(F.greatest(F.when(F.abs(mean - 0.5) < 0.01, 0.5 + 0.5 * certainty).otherwise(1 - 2 * spread), F.lit(0.0)), F.lit(1.0))


def volatility_calm(vol: Column) -> Column:
    """1 in calm markets, 0 from a daily volatility of 5 % on."""
    return F.when(vol.isNull() | F.isnan(vol), 0.5).otherwise(1 - F.least(F.greatest((vol - 0.005) / 0.045, F.lit(0.0)), F.lit(1.0)))


def range_quality(contained: Column, error: Column, delta: Column, width: Column, valid: Column) -> tuple[Column, Column]:
    """Health of recent ranges, all in percent: score from 10 to 100, and its status."""
    score = 100 - F.when(contained < 70, 30).when(contained < 80, 15).otherwise(0) - F.when(error > 0.80, 20).when(error > 0.55, 10).otherwise(0) - F.when(delta > 0.05, 15).otherwise(0) - F.when(width > 8, 10).otherwise(0)
    score = F.when(valid, F.greatest(score.cast("double"), F.lit(10.0))).otherwise(45.0)
    return score, F.when(~valid, "DEGRADED").when(score >= 85, "EXCELLENT").when(score >= 70, "GOOD").when(score >= 55, "WATCH").otherwise("DEGRADED")


def opportunity(rows: DataFrame, least_long: float = 0.54, most_short: float = 0.46, least_profit: float = 1.5, least_quality: float = 70) -> DataFrame:
    """Score of 100 of each signal, whether it qualifies, and its tier.

    Needs ``direction`` (LONG or SHORT), ``p, price, take, stop, expected`` (a return) and ``quality``
    (0 to 100). 35 points for conviction and for profit, 15 for reward over risk and for quality.
    """
    side = F.when(F.col("direction") == "LONG", 1.0).when(F.col("direction") == "SHORT", -1.0)
    profit, risk = side * (F.col("take") - F.col("price")) / F.col("price") * 100, side * (F.col("price") - F.col("stop")) / F.col("price") * 100
    out = rows.where(side.isNotNull() & (F.col("price") > 0) & (F.col("take") > 0) & (F.col("stop") > 0))
    out = out.withColumn("reward_risk", F.round(profit / F.greatest(F.lit(0.01), risk), 2)).withColumn("profit_pct", F.greatest(profit, F.abs("expected") * 100))
    points = lambda most, x: F.least(F.lit(most), F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("int"))
    out = out.withColumn("score", points(35, F.abs(F.col("p") - 0.5) * 2 * 70) + points(35, F.col("profit_pct") * 12) + points(15, F.col("reward_risk") * 5) + points(15, F.col("quality") / 100 * 15))
    sure = ((F.col("direction") == "LONG") & (F.col("p") >= least_long)) | ((F.col("direction") == "SHORT") & (F.col("p") <= most_short))
    core = sure & (F.col("profit_pct") >= least_profit) & (F.col("reward_risk") >= 1.5) & (F.col("quality") >= least_quality)
    tier = F.when((F.col("score") >= 85) & (F.col("profit_pct") >= 2.5), "ULTRA_HIGH_PROFIT").when(F.col("score") >= 75, "HIGH_CONVICTION").otherwise("PRIME_SETUP")
    return out.withColumn("qualifies", core | (F.col("score") >= 75)).withColumn("tier", tier)


def ensemble_decision(p: Column, regime: Column) -> Column:
    return F.when(regime.isin("RANGING", "HIGH_VOLATILITY"), "SKIP").when(p > 0.53, "LONG").when(p < 0.47, "SHORT").otherwise("SKIP")


def consensus(decisions: list[Column]) -> Column:
    """How many strategies agree: HIGH from three in four, MEDIUM from half, else LOW."""
    most = F.greatest(*[sum((F.when(d == x, 1).otherwise(0) for d in decisions), F.lit(0)) for x in ("LONG", "SHORT", "SKIP")]) / len(decisions)
    return F.when(most >= 0.75, "HIGH").when(most >= 0.50, "MEDIUM").otherwise("LOW")


def accuracy_record(rows: DataFrame) -> DataFrame:
    """Errors, coverage, Winkler score and loss of a resolved range forecast.

    Needs ``price, actual_high, actual_low, mfe_p50, mae_p50, mfe_p90, mae_p90``.
    """
    p = F.col("price")
    out = rows.withColumn("actual_mfe", F.greatest(F.lit(0.0), (F.col("actual_high") - p) / (p + 1e-6))).withColumn("actual_mae", F.greatest(F.lit(0.0), (p - F.col("actual_low")) / (p + 1e-6)))
    out = out.withColumn("mfe_error", F.abs(F.col("actual_mfe") - F.col("mfe_p50"))).withColumn("mae_error", F.abs(F.col("actual_mae") - F.col("mae_p50")))
    out = out.withColumn("high_covered", F.col("actual_mfe") <= F.col("mfe_p90")).withColumn("low_covered", F.col("actual_mae") <= F.col("mae_p90")).withColumn("path_contained", F.col("high_covered") & F.col("low_covered"))
    width = F.col("mfe_p90") + F.col("mae_p90")
    missed = F.greatest(F.lit(0.0), F.col("actual_mfe") - F.col("mfe_p90")) + F.greatest(F.lit(0.0), F.col("actual_mae") - F.col("mae_p90"))
    return out.withColumn("width_pct", width * 100).withColumn("winkler", (2 * width + 20 * missed) * 100).withColumn("quantile_loss", 0.5 * (F.col("mfe_error") + F.col("mae_error")))


#: Adverse against favourable excursion at the median and in the tail, and the cost that a trade must earn.
ADVERSE_MEDIAN, ADVERSE_TAIL, FRICTION = 1.32, 1.90, 0.0014


def risk_envelope(rows: DataFrame) -> DataFrame:
    """Envelope of prices and a decision from ``p10, p50, p90`` and ``mean`` of favourable excursions and a ``price``."""
    p50, p90, price = F.col("p50"), F.col("p90"), F.col("price")
    down50, down90 = ADVERSE_MEDIAN * p50, ADVERSE_TAIL * p90
    return rows.withColumns({
        "upside_median": p50, "downside_median": down50, "upside_tail": p90, "downside_tail": down90, "range_width": p90 + down90, "uncertainty": (p90 - F.col("p10")) / (F.col("mean") + 1e-6), "upper_level": price * (1 + p90), "lower_level": price * (1 - down90),
        "symmetry": F.when(down90 > p90, "SKEWED_ADVERSE").otherwise("SYMMETRIC"), "decision": F.when(p50 - down50 > FRICTION, "TRADE").otherwise("ABSTAIN"),
    })
