"""Stress scenarios, sizing and leverage comparisons, circuit breakers, model selection and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import deflated_sharpe
from .backtest import economics


def sanitised(x: Column) -> Column:
    """NaN becomes 0, infinities 1 and -1; NULL counts as NaN."""
    return F.when(x.isNull() | F.isnan(x), 0.0).when(x == float("inf"), 1.0).when(x == float("-inf"), -1.0).otherwise(x)


#: Scenario, number of last steps it touches (0: all), and what it does to a feature: set to, or add to.
SCENARIOS = {
    "FLASH_CRASH": (10, {"volume": ("set", 4.5), "atr": ("set", 0.085), "depth": ("set", -0.85), "spread": ("set", 0.012), "funding": ("set", -0.0015), "sentiment": ("set", -0.80), "ema_20": ("add", -0.18), "ema_50": ("add", -0.12)}),
    "LOW_LIQUIDITY": (0, {"volume": ("set", 0.10), "depth": ("set", 0.0), "spread": ("set", 0.025), "atr": ("set", 0.008)}),
    "HIGH_VOLATILITY": (0, {"atr": ("set", 0.075), "volume": ("set", 2.80), "fear_greed": ("set", 85.0), "ema_20": ("wave", 0.12), "ema_50": ("wave", -0.06)}),
    "NEWS_SHOCK": (15, {"sentiment": ("set", -0.98), "funding": ("set", -0.0025), "open_interest": ("add", -0.35), "ema_20": ("add", -0.09), "atr": ("set", 0.055)}),
    "FUNDING_SPIKE": (0, {"funding": ("set", 0.0025), "open_interest": ("add", 0.65), "ema_20": ("add", 0.04), "depth": ("set", -0.40)}),
}


def stressed(steps: DataFrame, back: str, forth: str, features: list[str]) -> DataFrame:
    """Every row under each scenario; ``back`` counts steps from the newest (0), ``forth`` from the oldest."""
    out = steps.withColumn("scenario", F.explode(F.array(*map(F.lit, SCENARIOS))))
    for f in features:
        x = F.col(f)
        for name, (last, changes) in SCENARIOS.items():
            if f in changes:
                how, v = changes[f]
                new = F.lit(v) if how == "set" else F.col(f) + v if how == "add" else F.col(f) + v * F.sin(F.col(forth) * 0.8)
                x = F.when((F.col("scenario") == name) & (F.lit(True) if last == 0 else F.col(back) < last), new).otherwise(x)
        out = out.withColumn(f"_{f}", x)
    return out.select(*[c for c in steps.columns if c not in features], "scenario", *[F.col(f"_{f}").alias(f) for f in features])


def circuit_breakers(rows: DataFrame, masks: dict[str, Column], net: str, by: list[str], order: list[str]) -> DataFrame:
    """Economics of a strategy while each breaker is not tripped; ``masks`` says where it is. A row is in every variant that lets it through."""
    kept = F.filter(F.array(*[F.when(~F.coalesce(m, F.lit(False)), F.lit(name)) for name, m in masks.items()]), lambda x: x.isNotNull())
    return economics(rows.withColumn("variant", F.explode(kept)), net, [*by, "variant"], order)


def leverage_sweep(rows: DataFrame, weight: str, ret: str, by: list[str], order: list[str], levels: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0, 1.25, 1.5), cost: float = 0.0014) -> DataFrame:
    each = rows.withColumn("leverage", F.explode(F.array(*map(F.lit, levels))))
    w = F.col(weight) * F.col("leverage")
    return economics(each.withColumn("_net", w * F.col(ret) - w * cost), "_net", [*by, "leverage"], order)


def sizing_schemes(vol: Column, ratio: Column) -> dict[str, Column]:
    """Fixed exposure, inverse volatility, and reward over risk."""
    clip = lambda x, lo, hi: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
    return {"fixed": F.lit(1.0), "inverse_vol": clip(0.015 / (vol + 1e-6), 0.2, 2.0), "risk_adjusted": clip(ratio - 0.5, 0.0, 2.0)}


def leaderboard(models: DataFrame, trials: int) -> DataFrame:
    """Models by their deflated Sharpe ratio: ``model, sharpe, n, skew, kurtosis`` give ``dsr`` and ``place`` (a row a model)."""
    rows = models.withColumn("dsr", deflated_sharpe(F.col("sharpe"), F.col("n"), F.col("skew"), F.col("kurtosis"), trials, "haircut"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("dsr"), "model")))


def promotion_gate(dsr: Column, p_value: Column, drawdown: Column, drawdown_now: Column, brier: Column, brier_now: Column) -> Column:
    """All four: deflated Sharpe from 0.95, a paired p-value below 0.05, at most half a point more drawdown, no worse Brier score."""
    return (dsr >= 0.95) & (p_value < 0.05) & (drawdown <= drawdown_now + 0.5) & (brier <= brier_now)


def kendall_tau(ranks: DataFrame, by: list[str], item: str, x: str, y: str) -> DataFrame:
    """Kendall's tau-b of two rankings of a few items (features of a model), by pairs of items; 1 where a ranking is constant."""
    other = ranks.select(*by, F.col(item).alias("_i"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    pairs = ranks.join(other, by).where(F.col(item) < F.col("_i"))
    a, b = F.signum(F.col(x) - F.col("_x")), F.signum(F.col(y) - F.col("_y"))
    root = F.sqrt(F.sum(F.abs(a)) * F.sum(F.abs(b)))
    return pairs.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(a * b), F.nullif(root, F.lit(0.0))), F.lit(1.0)).alias("tau"))


def top_features(weights: DataFrame, by: list[str], steps: str, feature: str, weight: str, last: int = 20, k: int = 5) -> DataFrame:
    """The ``k`` features of largest mean weight over the last steps, with their places."""
    newest = weights.withColumn("_k", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc(steps)))).where(F.col("_k") <= last)
    mean = newest.groupBy(*by, feature).agg(F.avg(weight).alias("mean_weight"))
    return mean.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("mean_weight"), feature))).where(F.col("place") <= k)


def top_two(logits: list[Column]) -> Column:
    """The two strongest experts, ``first`` and ``second``, and the softmax ``weight`` of the first of them (an earlier one wins a tie)."""
    pairs = F.sort_array(F.array(*[F.struct(x.cast("double").alias("x"), F.lit(-i).alias("i")) for i, x in enumerate(logits)]), asc=False)
    return F.struct((-pairs[0]["i"]).alias("first"), (-pairs[1]["i"]).alias("second"), (1 / (1 + F.exp(pairs[1]["x"] - pairs[0]["x"]))).alias("weight"))


def replayed(stored: DataFrame, recomputed: DataFrame, key: list[str], values: list[str], tolerance: float = 1e-5) -> DataFrame:
    """Stored forecasts that a recomputation does not reproduce, with the largest difference; also those on one side only."""
    a, b = stored.select(*key, *[F.col(v).alias(f"_s_{v}") for v in values], F.lit(True).alias("_s")), recomputed.select(*key, *[F.col(v).alias(f"_r_{v}") for v in values], F.lit(True).alias("_r"))
    both = a.join(b, key, "full")
    gap = F.greatest(*[F.coalesce(F.abs(F.col(f"_s_{v}") - F.col(f"_r_{v}")), F.lit(0.0)) for v in values], F.lit(0.0))
    why = F.when(F.col("_s").isNull(), "NOT_STORED").when(F.col("_r").isNull(), "NOT_REPRODUCED").when(gap > tolerance, "MISMATCH").otherwise("REPRODUCED")
    return both.select(*key, why.alias("status"), gap.alias("gap"))


def residual_factor(rows: DataFrame, factor: str, x1: str, x2: str, train: Column, by: list[str], ridge: float = 1.0) -> DataFrame:
    """``rows`` with ``residual``: the factor less its ridge regression on two features, fitted where ``train`` holds.

    The normal equations of centred features are sums, so the fit is one aggregation a group.
    """
    m = lambda c: F.avg(F.when(train, F.col(c)))
    n, p = F.count(F.when(train, F.col(factor))), lambda a, b: F.sum(F.when(train, F.col(a) * F.col(b)))
    fit = rows.dropna(subset=[factor, x1, x2]).groupBy(*by).agg(
        n.alias("_n"), m(factor).alias("_mf"), m(x1).alias("_m1"), m(x2).alias("_m2"), p(x1, x1).alias("_11"), p(x2, x2).alias("_22"), p(x1, x2).alias("_12"), p(x1, factor).alias("_1f"), p(x2, factor).alias("_2f")
    )
    c = lambda ab, u, v: F.col(ab) - F.col("_n") * F.col(u) * F.col(v)
    a11, a22, a12, b1, b2 = c("_11", "_m1", "_m1") + ridge, c("_22", "_m2", "_m2") + ridge, c("_12", "_m1", "_m2"), c("_1f", "_m1", "_mf"), c("_2f", "_m2", "_mf")
    det = a11 * a22 - a12 * a12
    fit = fit.select(*by, "_mf", "_m1", "_m2", ((b1 * a22 - b2 * a12) / det).alias("_w1"), ((b2 * a11 - b1 * a12) / det).alias("_w2"))
    guess = F.col("_mf") + F.col("_w1") * (F.col(x1) - F.col("_m1")) + F.col("_w2") * (F.col(x2) - F.col("_m2"))
    return rows.dropna(subset=[factor, x1, x2]).join(F.broadcast(fit), by).withColumn("fitted", guess).withColumn("residual", F.col(factor) - guess).drop("_mf", "_m1", "_m2", "_w1", "_w2")  # a row a series
