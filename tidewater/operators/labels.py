"""Labels and excursions: everything here looks forward, nothing in ``indicators`` does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import BARS, Key, forward, lead, log_return, percent_share, rolling_std


def horizon_return(bars: DataFrame, h: int, key: Key = BARS) -> DataFrame:
    """Log return over the next ``h`` bars; NULL in the last ``h``."""
    return bars.withColumn(f"fwd_ret_{h}", F.ln(F.try_divide(lead("close", h, key), F.col("close"))))


def excursions(bars: DataFrame, h: int, key: Key = BARS) -> DataFrame:
    """Largest favourable and adverse moves over the next ``h`` bars, long and short (not mirror images), not below 0."""
    high, low, p = forward(F.max, "high", h, key), forward(F.min, "low", h, key), F.col("close")
    floor = lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))
    return (
        bars.withColumn("mfe_long", floor(F.try_divide(high, p) - 1)).withColumn("mae_long", floor(1 - F.try_divide(low, p)))
        .withColumn("mfe_short", floor(F.try_divide(p, low) - 1)).withColumn("mae_short", floor(F.try_divide(high, p) - 1))
    )


def triple_barrier(bars: DataFrame, h: int = 24, multiple: float = 2.0, key: Key = BARS, intrabar: bool = False) -> DataFrame:
    """First barrier touched within ``h`` bars: label 1, -1 or 0, touch time and log return.

    Width is ``multiple`` times the 24-bar volatility. Touches of the close: the width is scaled by
    0.7 + 0.6 x the volatility's rank share if the series has more than 50 volatilities. With
    ``intrabar``, touches of high and low, unscaled, with ``holding_bars`` and ``exit_reason``; both
    in one bar is ambiguous and has no label. Rows without a full horizon or without volatility
    give NULL.
    """
    out = bars.withColumn("_r", log_return("close", 1, key)).withColumn("_v", rolling_std("_r", 24, key))
    scale = F.lit(1.0) if intrabar else F.when(F.count("_v").over(key.whole()) > 50, 0.7 + 0.6 * F.coalesce(percent_share("_v", key.by), F.lit(0.5))).otherwise(1.0)
    out = out.withColumn("_w", F.col("_v") * multiple * scale)
    ahead = F.collect_list(F.struct(F.col("ts").alias("ts"), F.col("close").alias("c"), (F.col("high") if intrabar else F.col("close")).alias("hi"), (F.col("low") if intrabar else F.col("close")).alias("lo"))).over(key.after(h))
    out = out.withColumn("_a", F.transform(ahead, lambda x, i: F.struct(x["ts"].alias("ts"), x["c"].alias("c"), x["hi"].alias("hi"), x["lo"].alias("lo"), (i + 1).alias("n"))))
    up, down = F.col("close") * (1 + F.col("_w")), F.col("close") * (1 - F.col("_w"))
    hit = F.filter("_a", lambda x: (x["hi"] >= up) | (x["lo"] <= down))
    out = out.withColumn("_hit", F.get(hit, 0)).withColumn("_end", F.get("_a", h - 1)).withColumn("_up", up).withColumn("_down", down)
    valid = F.col("_end").isNotNull() & (F.col("_w") > 0)
    rose, fell = F.col("_hit.hi") >= F.col("_up"), F.col("_hit.lo") <= F.col("_down")
    label = F.when(F.col("_hit").isNull(), 0).when(rose & fell, None).when(rose, 1).otherwise(-1)
    at = F.coalesce(F.col("_hit"), F.col("_end"))
    out = out.withColumn("label", F.when(valid, label)).withColumn("t1", F.when(valid, at["ts"])).withColumn("ret", F.when(valid, F.ln(F.try_divide(at["c"], F.col("close")))))
    if intrabar:
        why = F.when(F.col("_hit").isNull(), "timeout").when(rose & fell, "ambiguous_dual_crossing").when(rose, "upper_barrier").otherwise("lower_barrier")
        out = out.withColumn("holding_bars", F.when(valid, at["n"])).withColumn("exit_reason", F.when(valid, why))
    return out.drop("_r", "_v", "_w", "_a", "_hit", "_end", "_up", "_down")


def meta_label(labelled: DataFrame, signal: str = "sma_ratio_20") -> DataFrame:
    """Primary side from the sign of ``signal``, whether the barrier label agrees, and the label as up or not; rows without a label go."""
    side = F.when(F.col(signal) > 0, 1).otherwise(-1)
    rows = labelled.where("label is not null").withColumn("primary_side", side)
    return rows.withColumn("meta_label", (F.col("label") == F.col("primary_side")).cast("int")).withColumn("binary_label", (F.col("label") == 1).cast("int"))


#: Cost hurdles in basis points.
HURDLES = (8, 10, 14, 20, 30, 50)


def hurdles(rows: DataFrame, move: str = "mfe_long", points: tuple[int, ...] = HURDLES) -> DataFrame:
    """A row per hurdle: does the move exceed it? ``hurdle_bps`` and ``exceeds``."""
    each = F.explode(F.array(*map(F.lit, points)))
    return rows.where(F.col(move).isNotNull()).withColumn("hurdle_bps", each).withColumn("exceeds", (F.col(move) > F.col("hurdle_bps") / 10_000).cast("int"))


def three_class(bars: DataFrame, h: int = 24, k: float = 0.5, key: Key = BARS) -> DataFrame:
    """Up, down or flat against k times volatility scaled to the horizon; unknown volatility counts 0.005."""
    out = horizon_return(bars.withColumn("_r", log_return("close", 1, key)), h, key)
    edge = k * F.coalesce(rolling_std("_r", 24, key), F.lit(0.005)) * (h / 24) ** 0.5
    r = F.col(f"fwd_ret_{h}")
    return out.withColumn("class", F.when(r.isNull(), None).when(r > edge, 1).when(r < -edge, -1).otherwise(0)).drop("_r")


def take_profit_stop(bars: DataFrame, up: float, down: float, h: int, key: Key = BARS) -> DataFrame:
    """Exit on high/low within ``h`` bars; in a bar that touches both, the profit counts."""
    ahead = F.collect_list(F.struct("high", "low", "close")).over(key.after(h))
    out = bars.withColumn("_a", ahead)
    p = F.col("close")
    hit = F.get(F.filter("_a", lambda x: (x["high"] >= p * (1 + up)) | (x["low"] <= p * (1 - down))), 0)
    out = out.withColumn("_h", hit)
    why = F.when(F.size("_a") < h, None).when(F.col("_h").isNull(), "TIME").when(F.col("_h.high") >= p * (1 + up), "TP").otherwise("SL")
    pnl = F.when(why == "TP", up).when(why == "SL", -down).when(why == "TIME", F.try_divide(F.get("_a", h - 1)["close"], p) - 1)
    return out.withColumn("exit_reason", why).withColumn("pnl", pnl).drop("_a", "_h")
