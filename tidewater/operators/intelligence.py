"""A market's structure, liquidity, momentum and volatility as of each bar, from what was known then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import BARS, Key, lag, log_return

#: Bars on each side of a swing, nearness of equal levels, wick against body.
REACH, SAME, WICK, LEAST_BODY = 3, 0.0015, 2.5, 10.0


def structure(bars: DataFrame, key: Key = BARS) -> DataFrame:
    """Label, strength, break and change of character from the last two swing highs and lows.

    A swing is known only ``REACH`` bars later. The value before it is kept at each swing, so the
    last two are carried forward by one window each.
    """
    centred, known = key.base().rowsBetween(-REACH, REACH), key.base().rowsBetween(Window.unboundedPreceding, -REACH)
    earlier = key.base().rowsBetween(Window.unboundedPreceding, -1)
    full = F.count("*").over(centred) == 2 * REACH + 1
    out, carry = bars, lambda c, w: F.last(F.col(c), ignorenulls=True).over(w)
    for name, source, best in (("h", "high", F.max), ("l", "low", F.min)):
        out = out.withColumn(f"_{name}", F.when(full & (F.col(source) == best(source).over(centred)), F.col(source)))
        out = out.withColumn(f"_{name}b", F.when(F.col(f"_{name}").isNotNull(), carry(f"_{name}", earlier)))
        out = out.withColumn(f"_{name}1", carry(f"_{name}", known)).withColumn(f"_{name}2", carry(f"_{name}b", known))
    c, h1, h2, l1, l2 = (F.col(x) for x in ("close", "_h1", "_h2", "_l1", "_l2"))
    no = F.lit(False)
    hh, lh, hl, ll = (F.coalesce(x, no) for x in (h1 > h2, h1 < h2, l1 > l2, l1 < l2))
    cases = [(hh & hl, "Bullish", 84), (lh & ll, "Bearish", 78), (hh, "Consolidating Bullish", 65), (lh, "Consolidating Bearish", 60)]
    label, strength = F.lit(None), F.lit(None)
    for when, name, value in reversed(cases):
        label, strength = F.when(when, name).otherwise(F.coalesce(label, F.lit("Ranging"))), F.when(when, value).otherwise(F.coalesce(strength, F.lit(52)))
    level = F.coalesce(h1, c)
    turned = (hh & F.coalesce(c < l1, no)) | (ll & F.coalesce(c > h1, no))
    return out.withColumns({
        "structure": label, "trend_strength": strength, "break_pct": F.try_divide(c - level, F.nullif(level, F.lit(0.0))) * 100, "change_of_character": turned, "last_swing_high": level, "last_swing_low": F.coalesce(l1, c),
    }).drop(*[f"_{a}{b}" for a in "hl" for b in ("", "b", "1", "2")])


def _near(values: Column) -> Column:
    """Position (from 1) of the first of the ascending values that the next one nearly equals; NULL if none."""
    pairs = F.sequence(F.lit(1), F.size(values) - 1)
    close = F.filter(pairs, lambda i: F.try_divide(F.abs(F.get(values, i) - F.get(values, i - 1)), F.get(values, i - 1)) < SAME)
    return F.when(F.size(values) > 1, F.get(close, F.lit(0)))


def liquidity(bars: DataFrame, key: Key = BARS) -> DataFrame:
    """Equal levels among the last 20 highs and lows, rejection by a long wick, risk and the level a sweep would aim at."""
    last = key.last(20)
    out = bars.withColumn("_hs", F.array_sort(F.collect_list("high").over(last))).withColumn("_ls", F.array_sort(F.collect_list("low").over(last)))
    out = out.withColumn("_hi", _near(F.col("_hs"))).withColumn("_li", _near(F.col("_ls")))
    o, c, h, lo = (F.col(x) for x in ("open", "close", "high", "low"))
    body = WICK * F.greatest(F.abs(c - o), F.lit(LEAST_BODY))
    upper, lower = h - F.greatest(c, o), F.least(c, o) - lo
    sweep = F.when(upper > body, "UPPER_WICK").when(lower > body, "LOWER_WICK").otherwise("NONE")
    highs, lows = F.col("_hi").isNotNull(), F.col("_li").isNotNull()
    return out.withColumns({
        "equal_highs": highs, "equal_lows": lows, "sweep": sweep, "risk": F.when(sweep != "NONE", "HIGH").when(highs | lows, "ELEVATED").otherwise("LOW"),
        "sweep_target": F.when(highs, F.get("_hs", F.col("_hi"))).when(lows, F.get("_ls", F.col("_li") - 1)).otherwise(c * 1.012),
    }).drop("_hs", "_ls", "_hi", "_li")


def momentum(bars: DataFrame, key: Key = BARS) -> DataFrame:
    """Strength from the 14-bar rate of change and the volume against its mean of 20, and the share of rising bars in the last ten."""
    roc = F.coalesce(F.try_divide(F.col("close") - lag("close", 14, key), F.nullif(lag("close", 14, key), F.lit(0.0))), F.lit(0.01))
    mean = F.avg("volume").over(key.last(20))
    out = bars.withColumn("_roc", roc).withColumn("volume_expansion", F.when(mean > 0, F.col("volume") / mean).otherwise(1.0))
    strength = F.greatest(F.lit(15.0), F.least(F.lit(95.0), 50 + F.col("_roc") * 500 + (F.col("volume_expansion") - 1) * 20)).cast("int")
    out = out.withColumn("momentum_strength", strength).withColumn("_up", F.coalesce((F.col("close") > lag("close", 1, key)).cast("int"), F.lit(0)))
    state = F.when(F.col("momentum_strength") >= 65, "Expanding").when(F.col("momentum_strength") <= 35, "Compressing").otherwise("Neutral")
    return out.withColumns({"momentum": state, "roc_14_pct": F.col("_roc") * 100, "persistence": (F.avg("_up").over(key.last(10)) * 100).cast("int")}).drop("_roc", "_up")


def volatility(bars: DataFrame, key: Key = BARS, days: int = 30) -> DataFrame:
    """Deviation of the last 24 returns, its percentile among those of the last ``days`` days, and the state it names."""
    out = bars.withColumn("_r", log_return("close", 1, key)).withColumn("_v", F.stddev_samp("_r").over(key.last(24))).withColumn("_k", F.count("_r").over(key.last(24)))
    # only deviations of 24 returns within the span count as history
    out = out.withColumn("_whole", F.when(F.col("_k") == 24, F.col("_v")))
    past = F.collect_list("_whole").over(key.last(days * 24 - 23))
    share = F.try_divide(F.size(F.filter(past, lambda v: v < F.col("_v"))) * 100.0, F.nullif(F.size(past), F.lit(0)))
    out = out.withColumn("_p", F.coalesce(share, F.lit(35.0)))
    steps = [(25, "Compression"), (60, "Quiet"), (85, "Expansion"), (95, "Exhaustion")]
    state = F.lit("Panic")
    for top, name in reversed(steps):
        state = F.when(F.col("_p") < top, name).otherwise(state)
    return out.withColumn("volatility_state", state).withColumn("volatility_percentile", F.col("_p").cast("int")).withColumn("realized_vol_24", F.col("_v")).drop("_r", "_v", "_k", "_whole", "_p")
