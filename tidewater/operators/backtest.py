"""Back-tests, sizing, risk and costs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import BARS, Key, clip, lag


def positions(rows: DataFrame, scheme: str = "fixed", p: str = "p", vol: str = "vol", target: float = 0.02) -> Column:
    """Position from a probability: fixed sign, volatility target, probability-scaled, or cost-aware."""
    side = F.when(F.col(p) > 0.54, 1.0).when(F.col(p) < 0.46, -1.0).otherwise(0.0)
    if scheme == "fixed":
        return side
    if scheme == "vol_target":
        return side * clip(F.try_divide(F.lit(target), F.nullif(F.col(vol), F.lit(0.0))), 0.0, 2.0)
    if scheme == "prob_scaled":
        return clip(2 * (F.col(p) - 0.5), -1.0, 1.0)
    if scheme == "cost_aware":
        return F.when(F.abs(F.col(p) - 0.5) * F.col(vol) > 0.001, side).otherwise(0.0)
    raise ValueError(f"unknown sizing scheme {scheme}")


def simulate(rows: DataFrame, position: str, ret: str, cost: Column | float, key: Key = BARS) -> DataFrame:
    """Yesterday's position earns today's return; changes of position cost. Adds pnl, equity, drawdown."""
    cost = cost if isinstance(cost, Column) else F.lit(cost)
    held = F.coalesce(lag(position, 1, key), F.lit(0.0))
    out = rows.withColumn("turnover", F.abs(F.coalesce(F.col(position), F.lit(0.0)) - held)).withColumn("pnl", held * F.coalesce(F.col(ret), F.lit(0.0)) - cost * F.col("turnover"))
    out = out.withColumn("equity", F.exp(F.sum(F.log1p(F.greatest(F.col("pnl"), F.lit(-0.999999)))).over(key.so_far())))
    top = F.greatest(F.max("equity").over(key.so_far()), F.lit(1.0))
    return out.withColumn("drawdown", 1 - F.col("equity") / top)


def summary(sim: DataFrame, by: list[str], per_year: float = 8760) -> DataFrame:
    dev = F.nullif(F.stddev_samp("pnl"), F.lit(0.0))
    return sim.groupBy(*by).agg(
        F.count("*").alias("bars"), F.sum("pnl").alias("total"), (F.try_divide(F.avg("pnl"), dev) * math.sqrt(per_year)).alias("sharpe"), F.max("drawdown").alias("max_drawdown"),
        F.sum("turnover").alias("turnover"), F.sum((F.col("turnover") > 0).cast("long")).alias("trades"),
    )


def risk_metrics(rows: DataFrame, r: str, by: list[str], order: list[str], per_year: float = 8760, confidence: float = 0.95) -> DataFrame:
    """Sharpe, Sortino, drawdown, Calmar, historical VaR and CVaR, profit factor, win rate, expectancy."""
    key = Key(tuple(by), tuple(order))
    e = rows.withColumn("_e", F.exp(F.sum(F.log1p(F.greatest(F.col(r), F.lit(-0.999999)))).over(key.so_far())))
    e = e.withColumn("_d", 1 - F.col("_e") / F.greatest(F.max("_e").over(key.so_far()), F.lit(1.0)))
    # the k-th worst return by rank, so no series is collected into one array
    w = Window.partitionBy(*by)
    e = e.withColumn("_k", F.row_number().over(w.orderBy(r, *order))).withColumn("_n", F.count("*").over(w))
    share = F.floor((1 - confidence) * F.col("_n"))
    e = e.withColumn("_at", F.col("_k") == share + 1).withColumn("_tail", F.col("_k") <= F.greatest(share, F.lit(1)))
    x, root = F.col(r), math.sqrt(per_year)
    up, down = F.sum(F.when(x > 0, x).otherwise(0.0)), -F.sum(F.when(x < 0, x).otherwise(0.0))
    low = F.nullif(F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), F.lit(2.0)))), F.lit(0.0))
    out = e.groupBy(*by).agg(
        (F.try_divide(F.avg(x), F.nullif(F.stddev_samp(x), F.lit(0.0))) * root).alias("sharpe"), (F.try_divide(F.avg(x), low) * root).alias("sortino"), F.max("_d").alias("max_drawdown"), (F.avg(x) * per_year).alias("_year"),
        (-F.max(F.when(F.col("_at"), x))).alias("var_95"), (-F.avg(F.when(F.col("_tail"), x))).alias("cvar_95"), F.try_divide(up, F.nullif(down, F.lit(0.0))).alias("profit_factor"),
        F.avg((x > 0).cast("double")).alias("win_rate"), F.avg(x).alias("expectancy"),
    )
    return out.withColumn("calmar", F.try_divide(F.col("_year"), F.nullif(F.col("max_drawdown"), F.lit(0.0)))).drop("_year")


#: Largest share of the portfolio by regime; other regimes take the default.
REGIME_CAP = {"TRENDING_BULL": 0.20, "TRENDING_BEAR": 0.18, "BREAKOUT": 0.15, "RANGING": 0.08, "HIGH_VOLATILITY": 0.05}
OTHER_CAP, LEAST_SHARE, MOST_SHARE, KELLY_PART = 0.10, 0.01, 0.20, 0.25


def execution_cost(size: Column, spread: Column, vpin: Column, base: float = 0.0002) -> Column:
    """Half the spread (at least 1 bp) plus square-root impact of the order's size, more where flow is toxic."""
    half, impact = F.greatest(F.lit(0.0001), spread / 2), base * F.sqrt(F.greatest(F.lit(1.0), size / 100_000))
    return (half + impact) * (1 + F.greatest(F.lit(0.0), (vpin - 0.5) * 2))


def dynamic_levels(price: Column, long: Column, atr: Column, regime: Column, take: float = 2.0, stop: float = 1.5) -> tuple[Column, Column]:
    """Take-profit and stop prices in units of ATR, wider under high volatility."""
    k = F.when(regime == "HIGH_VOLATILITY", 1.2).otherwise(1.0)
    side = F.when(long, 1.0).otherwise(-1.0)
    return F.greatest(F.lit(0.0), price + side * take * k * atr), F.greatest(F.lit(0.0), price - side * stop * k * atr)


def kelly(p: Column, win: Column, loss: Column) -> Column:
    """Kelly fraction (p b - q) / b with b = win / loss, within [-1, 1]; 0 without a gain or a loss."""
    b = F.try_divide(win, F.nullif(loss, F.lit(0.0)))
    raw = F.try_divide(p * b - (1 - p), F.nullif(b, F.lit(0.0)))
    return F.when((win <= 0) | (loss <= 0), 0.0).otherwise(clip(raw, -1.0, 1.0))


def position_share(fraction: Column, regime: Column) -> Column:
    """Share of the portfolio: a quarter of the Kelly fraction's size, within the regime's cap, from 1 to 20 %."""
    cap = F.lit(OTHER_CAP)
    for name, x in REGIME_CAP.items():
        cap = F.when(regime == name, x).otherwise(cap)
    return F.greatest(F.lit(LEAST_SHARE), F.least(F.abs(fraction * KELLY_PART), cap, F.lit(MOST_SHARE)))


def reference_size(mfe: Column, mae: Column, cost: float = 0.0016) -> Column:
    return clip(mfe / (mae + cost + 1e-6) - 0.5, 0.0, 1.0)


def economics(rows: DataFrame, net: str, by: list[str], order: list[str], per_year: float = 8766) -> DataFrame:
    """Count, mean, win rate, cost-adjusted Sharpe ratio and deepest drawdown of net returns per group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    e = rows.withColumn("_e", F.exp(F.sum(F.log1p(F.greatest(F.col(net), F.lit(-0.999999)))).over(w))).withColumn("_d", 1 - F.col("_e") / F.max("_e").over(w))
    return e.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(net).alias("mean_net"), F.avg((F.col(net) > 0).cast("double")).alias("win_rate"), (F.avg(net) / (F.stddev_pop(net) + 1e-6) * math.sqrt(per_year)).alias("sharpe"),
        F.max("_d").alias("max_drawdown"), F.stddev_pop(F.when(F.col(net) < 0, F.col(net))).alias("downside"),
    )
