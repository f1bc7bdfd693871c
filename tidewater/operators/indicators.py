"""Technical indicators as column expressions over shared windows.

Every indicator has several published definitions (three average true ranges, three relative
strength indices); each keeps its own name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import numbered, row_blocks
from ..functions.windows import BARS, Ewm, Key, clip, ewms, expanding_quantiles, forward_fill, lag, log_return, pct_change, rolling, rolling_std, sma, span, zscore


def ratio(a, b) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def true_range(key: Key = BARS, high: str = "high", low: str = "low", close: str = "close") -> Column:
    before = lag(close, 1, key)
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before))


def technical(bars: DataFrame, key: Key = BARS) -> DataFrame:
    """Batch block: log returns 1/4/24, SMA ratios, volatility, volume z-score, RSI, MACD, ATR."""
    out = bars
    for k in (1, 4, 24):
        out = out.withColumn(f"ret_{k}", log_return("close", k, key))
    for k in (20, 50):
        out = out.withColumn(f"sma_ratio_{k}", F.try_divide(F.col("close"), sma("close", k, key)) - 1)
    out = out.withColumn("vol_24", rolling_std("ret_1", 24, key)).withColumn("volume_z", zscore("volume", 24, key))
    d = F.col("close") - lag("close", 1, key)
    out = out.withColumn("_up", clip(d, 0.0, math.inf)).withColumn("_down", clip(-d, 0.0, math.inf)).withColumn("_tr", true_range(key))
    out = ewms(out, [Ewm("_up", 1 / 14, "_gain", 14), Ewm("_down", 1 / 14, "_loss", 14), Ewm("_tr", 1 / 14, "atr_wilder", 14), Ewm("close", span(12), "_fast"), Ewm("close", span(26), "_slow")], key)
    out = out.withColumn("rsi_14", 100 - 100 / (1 + ratio(F.col("_gain"), F.col("_loss")))).withColumn("macd", F.col("_fast") - F.col("_slow"))
    out = ewms(out, [Ewm("macd", span(9), "macd_signal")], key).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    return out.drop("_up", "_down", "_tr", "_gain", "_loss", "_fast", "_slow")


def cache_block(bars: DataFrame, key: Key = BARS) -> DataFrame:
    """The same for a cache that must have no gaps: missing returns 0, RSI 50, volatility 0.015, ATR of 1 % of the close (a simple mean)."""
    out = technical(bars, key).withColumn("_tr", true_range(key)).withColumn("atr_simple", sma("_tr", 14, key)).drop("_tr")
    fills = {"ret_1": F.lit(0.0), "ret_4": F.lit(0.0), "ret_24": F.lit(0.0), "rsi_14": F.lit(50.0), "sma_ratio_20": F.lit(0.0), "sma_ratio_50": F.lit(0.0), "vol_24": F.lit(0.015), "atr_simple": 0.01 * F.col("close")}
    return out.withColumns({c: F.coalesce(F.col(c), v) for c, v in fills.items()})


def atr_span(bars: DataFrame, key: Key = BARS, k: int = 14) -> DataFrame:
    return ewms(bars.withColumn("_tr", true_range(key)), [Ewm("_tr", span(k), "atr_span")], key).drop("_tr")


def atr_simple(bars: DataFrame, key: Key = BARS, k: int = 14) -> DataFrame:
    return bars.withColumn("_tr", true_range(key)).withColumn("atr_simple", sma("_tr", k, key)).drop("_tr")


def bands(bars: DataFrame, key: Key = BARS, k: int = 20, width: float = 2.0) -> DataFrame:
    """Bollinger width and %B, population deviation."""
    mid, dev = sma("close", k, key), rolling_std("close", k, key, population=True)
    out = bars.withColumn("_mid", mid).withColumn("_dev", dev)
    out = out.withColumn("band_width", F.try_divide(2 * width * F.col("_dev"), F.col("_mid")))
    return out.withColumn("percent_b", ratio(F.col("close") - (F.col("_mid") - width * F.col("_dev")), 2 * width * F.col("_dev"))).drop("_mid", "_dev")


def live_block(bars: DataFrame, key: Key = BARS) -> DataFrame:
    """Live definitions: population deviations, VWAP ratio over 500 bars, ROC-10, OBV z, volatility times sqrt(24)."""
    out = bars.withColumn("_r", log_return("close", 1, key))
    out = out.withColumn("live_vol", rolling_std("_r", 24, key, population=True) * math.sqrt(24)).withColumn("live_volume_z", zscore("volume", 20, key, population=True))
    w = key.last(500)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    out = out.withColumn("vwap_ratio", F.try_divide(F.col("close"), ratio(F.sum(typical * F.col("volume")).over(w), F.sum("volume").over(w))) - 1)
    out = out.withColumn("roc_10", pct_change("close", 10, key))
    out = out.withColumn("_signed", F.coalesce(F.signum(F.col("close") - lag("close", 1, key)), F.lit(0.0)) * F.col("volume")).withColumn("obv", F.sum("_signed").over(key.so_far()))
    return bands(out.withColumn("obv_z", zscore("obv", 20, key, population=True)).drop("_signed", "_r"), key)


def live_momentum(bars: DataFrame, key: Key = BARS) -> DataFrame:
    """Live definitions that need exponential means: EMA ratios 20/50/200, RSI in [-1, 1], MACD as a share of the close, ATR share, DX and its spread."""
    d, c = F.col("close") - lag("close", 1, key), F.col("close")
    up, down = F.col("high") - lag("high", 1, key), lag("low", 1, key) - F.col("low")
    there = lag("close", 1, key).isNotNull()
    out = bars.withColumn("_n", F.row_number().over(key.base())).withColumn("_up", clip(d, 0.0, math.inf)).withColumn("_down", clip(-d, 0.0, math.inf)).withColumn("_tr", F.when(there, true_range(key)))
    out = out.withColumn("_p", F.when(there, F.when((up > down) & (up > 0), up).otherwise(0.0))).withColumn("_m", F.when(there, F.when((down > up) & (down > 0), down).otherwise(0.0)))
    emas = [Ewm("close", span(k), f"_e{k}") for k in (12, 20, 26, 50, 200)]
    out = ewms(out, [*emas, Ewm("_up", 1 / 14, "_g"), Ewm("_down", 1 / 14, "_l"), Ewm("_tr", span(14), "_a"), Ewm("_p", span(14), "_ps"), Ewm("_m", span(14), "_ms")], key)
    out = ewms(out.withColumn("_macd", F.col("_e12") - F.col("_e26")), [Ewm("_macd", span(9), "_sig")], key)
    for k in (20, 50, 200):
        out = out.withColumn(f"ema_ratio_{k}", ratio(c, F.col(f"_e{k}")) - 1)
    rsi = F.when(F.col("_n") >= 15, 100 - 100 / (1 + F.col("_g") / (F.col("_l") + 1e-8))).otherwise(50.0)
    pdi, mdi = 100 * F.col("_ps") / (F.col("_a") + 1e-8), 100 * F.col("_ms") / (F.col("_a") + 1e-8)
    out = out.withColumn("live_rsi", (rsi - 50) / 50).withColumn("live_macd", ratio(F.col("_macd"), c)).withColumn("live_macd_signal", ratio(F.col("_sig"), c)).withColumn("live_macd_hist", ratio(F.col("_macd") - F.col("_sig"), c))
    out = out.withColumn("atr_ratio", ratio(F.coalesce("_a", F.col("high") - F.col("low")), c))
    enough = F.col("_n") >= 15
    out = out.withColumn("live_dx", F.when(enough, F.abs(pdi - mdi) / (pdi + mdi + 1e-8)).otherwise(0.25)).withColumn("di_spread", F.when(enough, (pdi - mdi) / (pdi + mdi + 1e-8)).otherwise(0.0))
    return out.drop("_n", "_up", "_down", "_tr", "_p", "_m", "_g", "_l", "_a", "_ps", "_ms", "_macd", "_sig", *[f"_e{k}" for k in (12, 20, 26, 50, 200)])


def book_pressure(rows: DataFrame) -> DataFrame:
    """Depth imbalance, log depth, open-interest change and fear-and-greed in [-1, 1] of a live row."""
    bid, ask, before = F.col("depth_bid"), F.col("depth_ask"), F.col("open_interest_before")
    return (
        rows.withColumn("order_book_imbalance", (bid - ask) / (bid + ask + 1e-8)).withColumn("depth_liquidity", F.log1p(bid + ask))
        .withColumn("open_interest_delta", (F.col("open_interest") - before) / (before + 1e-8)).withColumn("fear_greed_index", (F.col("fear_greed") - 50) / 50)
    )


def directional(bars: DataFrame, key: Key = BARS, k: int = 14, high: str = "high", low: str = "low", close: str = "close", out: str = "adx") -> DataFrame:
    """Average directional index by Wilder's smoothing, with ``plus_di`` and ``minus_di``; 25 where it is unknown."""
    up, down = F.col(high) - lag(high, 1, key), lag(low, 1, key) - F.col(low)
    rows = bars.withColumn("_tr", true_range(key, high, low, close)).withColumn("_p", F.when((up > down) & (up > 0), up).otherwise(0.0)).withColumn("_m", F.when((down > up) & (down > 0), down).otherwise(0.0))
    rows = ewms(rows, [Ewm("_tr", 1 / k, "_a", k), Ewm("_p", 1 / k, "_ps", k), Ewm("_m", 1 / k, "_ms", k)], key)
    rows = rows.withColumn("plus_di", 100 * F.col("_ps") / (F.col("_a") + 1e-8)).withColumn("minus_di", 100 * F.col("_ms") / (F.col("_a") + 1e-8))
    rows = rows.withColumn("_dx", 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / (F.col("plus_di") + F.col("minus_di") + 1e-8))
    rows = ewms(rows, [Ewm("_dx", 1 / k, out, k)], key)
    return rows.withColumn(out, F.coalesce(F.col(out), F.lit(25.0))).drop("_tr", "_p", "_m", "_a", "_ps", "_ms", "_dx")


def microstructure(bars: DataFrame, key: Key = BARS) -> DataFrame:
    """Corwin-Schultz spread, close-location imbalance, taker share and VPIN from bars alone; none is NULL."""
    two, day, root = key.last(2), key.last(24), 3 - 2 * math.sqrt(2)
    beta = F.pow(F.sum(F.ln(F.try_divide("high", "low"))).over(two), F.lit(2.0))
    gamma = F.pow(F.ln(F.try_divide(F.max("high").over(two), F.min("low").over(two))), F.lit(2.0))
    alpha = F.greatest(F.lit(0.0), (F.sqrt(2 * beta) - F.sqrt(beta)) / root - F.sqrt(gamma / root))
    place = clip(ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")), 0.0, 1.0)
    out = bars.withColumn("_a", F.when(beta.isNotNull() & gamma.isNotNull(), alpha)).withColumn("_c", place)
    out = out.withColumn("spread", F.coalesce(2 * (F.exp("_a") - 1) / (1 + F.exp("_a")), F.lit(0.0005)))
    out = out.withColumn("_o", F.coalesce((F.col("_c") - 0.5) * 2, F.lit(0.0))).withColumn("imbalance", clip(F.avg("_o").over(key.last(3)), -1.0, 1.0))
    buy, sell = F.col("volume") * F.col("_c"), F.col("volume") * (1 - F.col("_c"))
    out = out.withColumn("taker_share", clip(F.coalesce(buy / (buy + sell + 1e-8), F.lit(0.5)), 0.0, 1.0)).withColumn("_i", F.abs(buy - sell))
    vpin = ratio(F.sum("_i").over(day), F.sum("volume").over(day))
    return out.withColumn("vpin", clip(F.coalesce(vpin, F.lit(0.2)), 0.0, 1.0)).drop("_a", "_c", "_o", "_i")


def term_structure(rows: DataFrame) -> DataFrame:
    """Volatilities of 5 minutes, 1, 4 and 24 hours, scaled to a day and compared; the regime and trend they name."""
    day = F.greatest(F.lit(1e-6), F.col("vol_24h"))
    out = rows.withColumn("ratio_5m_24h", F.col("vol_5m") * math.sqrt(288) / day).withColumn("ratio_1h_24h", F.col("vol_1h") * math.sqrt(24) / day).withColumn("ratio_4h_24h", F.col("vol_4h") * math.sqrt(6) / day)
    rising, falling, peak = (F.col("ratio_1h_24h") > 1.30) | (F.col("ratio_5m_24h") > 1.40), F.col("ratio_1h_24h") < 0.75, F.col("ratio_4h_24h") > 1.50
    name = lambda a, b, c, d: F.when(rising, a).when(falling, b).when(peak, c).otherwise(d)
    return out.withColumn("vol_regime", name("VOL_EXPANDING", "VOL_COMPRESSION", "PEAK_VOLATILITY", "NORMAL")).withColumn("vol_trend", name("ACCELERATING", "DECELERATING", "EXTREME", "STABLE"))


#: The columns of ``multi_timeframe``.
MTF = ("1h_ret", "1h_vol", "1h_rsi", "1h_ema_slope", "4h_ret", "4h_vol", "4h_rsi", "4h_adx", "4h_vol_z", "12h_ret", "12h_vol", "12h_rsi", "12h_trend_state", "1d_ret", "1d_vol", "1d_sma_ratio_50", "1d_vol_ratio")


def multi_timeframe(bars: DataFrame, key: Key = BARS) -> DataFrame:
    """Features of 1, 4, 12 and 24 hours side by side, from trailing windows of hourly bars; carried forward, then 0."""
    c, d = F.col("close"), F.col("close") - lag("close", 1, key)
    sums = lambda k: rolling(F.sum, "volume", key.last(k), k)
    out = bars.withColumn("_up", clip(d, 0.0, math.inf)).withColumn("_down", clip(-d, 0.0, math.inf)).withColumn("_h4", rolling(F.max, "high", key.last(4), 4)).withColumn("_l4", rolling(F.min, "low", key.last(4), 4)).withColumn("_v4", sums(4)).withColumn("_v24", sums(24))
    strengths = [Ewm(x, 1 / k, f"{x}{k}", k) for x in ("_up", "_down") for k in (14, 56, 168)]
    out = ewms(out, [*strengths, Ewm("close", span(20), "_e20", adjust=True), Ewm("close", span(120), "_e120", adjust=True)], key)
    out = directional(out, key, 14, "_h4", "_l4", "close", "mtf_4h_adx")
    for name, k in (("1h", 1), ("4h", 4), ("12h", 12), ("1d", 24)):
        out = out.withColumn(f"mtf_{name}_ret", log_return("close", k, key))
    for name, k in (("1h", 24), ("4h", 6), ("12h", 10), ("1d", 14)):
        out = out.withColumn(f"mtf_{name}_vol", rolling_std(f"mtf_{name}_ret", k, key))
    for name, k in (("1h", 14), ("4h", 56), ("12h", 168)):
        out = out.withColumn(f"mtf_{name}_rsi", 100 - 100 / (1 + F.col(f"_up{k}") / (F.col(f"_down{k}") + 1e-8)))
    out = out.withColumn("mtf_1h_ema_slope", F.try_divide(F.col("_e20"), lag("_e20", 3, key)) - 1).withColumn("mtf_4h_vol_z", (F.col("_v4") - sma("_v4", 24, key)) / (rolling_std("_v4", 24, key) + 1e-6))
    out = out.withColumn("mtf_12h_trend_state", F.when(c > F.col("_e120"), 1.0).otherwise(-1.0)).withColumn("mtf_1d_sma_ratio_50", F.try_divide(c, sma("close", 1200, key, 200)) - 1)
    out = out.withColumn("mtf_1d_vol_ratio", F.col("_v24") / (sma("volume", 480, key, 48) + 1e-6))
    return out.withColumns({f"mtf_{x}": F.coalesce(forward_fill(f"mtf_{x}", key), F.lit(0.0)) for x in MTF}).drop("_up", "_down", "_h4", "_l4", "_v4", "_v24", "_e20", "_e120", "plus_di", "minus_di", *[s.out for s in strengths])


def trend_score() -> Column:
    part = lambda c, k: F.coalesce(clip(F.col(c) * k, -1.0, 1.0), F.lit(0.0))
    return 0.5 * part("sma_ratio_50", 10.0) + 0.3 * part("ret_24", 20.0) + 0.2 * F.coalesce(F.signum("macd"), F.lit(0.0))


def market_state(rows: DataFrame, key: Key = BARS) -> DataFrame:
    """Trend score; volatility, momentum, funding and leverage states; and the regime that they name.

    Needs the columns of ``technical`` and ``funding_rate, oi_change_24``. Volatility tiers are
    the quantiles of all rows so far (from 24 on; before, of the whole series).
    """
    out = rows.withColumn("trend_score", trend_score()).withColumn("_v", F.coalesce("vol_24", F.lit(0.01)))
    out = expanding_quantiles(out, "_v", {"_lo": 0.33, "_hi": 0.66}, 24, key)
    whole = {c: F.coalesce(F.col(c), F.percentile("_v", F.lit(q)).over(key.whole())) for c, q in (("_lo", 0.33), ("_hi", 0.66))}
    out = out.withColumns(whole)
    vol = F.when(F.col("_v") <= F.col("_lo"), "LOW").when(F.col("_v") <= F.col("_hi"), "MEDIUM").otherwise("HIGH")
    momentum = F.when((F.col("rsi_14") > 55) & (F.col("ret_4") > 0), "POSITIVE").when((F.col("rsi_14") < 45) & (F.col("ret_4") < 0), "NEGATIVE").otherwise("NEUTRAL")
    f, oi = F.col("funding_rate"), F.coalesce("oi_change_24", F.lit(0.0))
    funding = F.when(f > 0.0003, "EXTREME_POSITIVE").when(f > 0.0001, "POSITIVE").when(f < -0.0003, "EXTREME_NEGATIVE").when(f < -0.0001, "NEGATIVE").otherwise("NEUTRAL")
    leverage = F.when(oi > 0.03, "ELEVATED").when(oi < -0.03, "SUBDUED").otherwise("NORMAL")
    out = out.withColumn("volatility_state", vol).withColumn("momentum_state", momentum).withColumn("funding_state", funding).withColumn("leverage_state", leverage).drop("_v", "_lo", "_hi")
    t = F.col("trend_score")
    regime = F.when(F.col("volatility_state") == "HIGH", "HIGH_VOLATILITY").when((F.col("leverage_state") == "ELEVATED") & (F.abs(t) > 0.2), "BREAKOUT")
    regime = regime.when((t > 0.15) & (F.col("momentum_state") != "NEGATIVE"), "TRENDING_BULL").when((t < -0.15) & (F.col("momentum_state") != "POSITIVE"), "TRENDING_BEAR").otherwise("RANGING")
    return out.withColumn("regime", regime)


def heat_map_regime(vol: Column, trend: Column, rsi: Column) -> Column:
    """Regime by plain thresholds, for a heat map."""
    return F.when(vol > 0.04, "HIGH_VOLATILITY").when((trend > 0.3) & (rsi > 60), "BREAKOUT").when(trend > 0.15, "TRENDING_BULL").when(trend < -0.15, "TRENDING_BEAR").otherwise("RANGING")


def macro_cycle(mvrv: Column, nupl: Column, kind: str = "ratio") -> Column:
    """Macro cycle from on-chain valuation; ``kind``: what ``mvrv`` is (ratio, zscore, or percentile of its past)."""
    #: Capitulation below, euphoria from, accumulation below.
    low, high, cheap = {"ratio": (1.0, 3.5, 1.6), "zscore": (0.1, 5.0, 1.5), "percentile": (0.05, 0.95, 0.30)}[kind]
    least = mvrv <= low if kind == "percentile" else mvrv < low
    some = mvrv <= cheap if kind == "percentile" else mvrv < cheap
    return F.when(least | (nupl < 0), "CAPITULATION").when((mvrv >= high) | (nupl >= 0.70), "EUPHORIA").when(some & (nupl < 0.25), "ACCUMULATION").otherwise("NEUTRAL")


def event_flags(volume_z: Column, funding: Column, oi_change: Column, vol: Column) -> Column:
    """All flags that hold, as an array; NORMAL_MARKET_FLOW if none does."""
    found = F.filter(
        F.array(
            F.when(volume_z > 3, "LIQUIDATION_CASCADE"), F.when(F.abs(funding) > 0.0005, "FUNDING_EXTREME"), F.when(F.abs(oi_change) > 0.06, "OPEN_INTEREST_BURST"), F.when(vol > 0.04, "MACRO_VOLATILITY_SPIKE")
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(F.size(found) == 0, F.array(F.lit("NORMAL_MARKET_FLOW"))).otherwise(found)


#: What each event flag adds to a regime's probability.
MODIFIERS = {
    "high_volatility": {"LIQUIDATION_CASCADE": 0.35, "MACRO_VOLATILITY_SPIKE": 0.40, "FUNDING_EXTREME": 0.20},
    "breakout": {"LIQUIDATION_CASCADE": 0.20, "OPEN_INTEREST_BURST": 0.30},
    "ranging": {"LIQUIDATION_CASCADE": -0.30, "MACRO_VOLATILITY_SPIKE": -0.30, "OPEN_INTEREST_BURST": -0.20},
}


def regime_modifier(flags: Column, regime: str) -> Column:
    return sum((F.when(F.array_contains(flags, f), x).otherwise(0.0) for f, x in MODIFIERS.get(regime, {}).items()), F.lit(0.0))


#: The columns of ``event_features``.
MICRO = (
    "mid_price", "spread", "relative_spread", "microprice", "top_imbalance", "depth_imbalance", "multi_level_imbalance", "signed_volume", "buy_sell_ratio", "order_flow_imbalance",
    "order_arrival_rate", "cancellation_rate", "imbalance_velocity", "spread_velocity", "microprice_velocity", "realized_vol_50",
)


def event_features(events: DataFrame, by: list[str], size: int = 8192) -> DataFrame:
    """Sixteen causal features of each order-book event, over windows of up to 50 events.

    Needs ``event_id, ts, kind, bid, ask, depth_bid, depth_ask, signed_volume, imbalance``. Events
    are dealt to blocks of ``size`` with the 50 before them, so a series of any length spreads.
    """
    e = row_blocks(numbered(events, by, "event_id"), size, 51)
    w = Window.partitionBy(*by, "_block").orderBy("_rn")
    last = lambda k: w.rowsBetween(-(k - 1), 0)
    bid, ask, db, da, s = (F.col(c) for c in ("bid", "ask", "depth_bid", "depth_ask", "signed_volume"))
    e = e.withColumn("mid_price", (bid + ask) / 2).withColumn("spread", ask - bid).withColumn("relative_spread", F.col("spread") / (F.col("mid_price") + 1e-6))
    e = e.withColumn("microprice", (db * ask + da * bid) / (db + da + 1e-6)).withColumn("top_imbalance", (db - da) / (db + da + 1e-6)).withColumn("depth_imbalance", F.col("imbalance"))
    e = e.withColumn("multi_level_imbalance", 0.7 * F.col("top_imbalance") + 0.3 * F.col("depth_imbalance"))
    buy, sell = (F.coalesce(rolling(F.sum, F.greatest(F.lit(0.0), x), last(20), 20), F.lit(0.01)) for x in (s, -s))
    e = e.withColumn("buy_sell_ratio", buy / (sell + 1e-6)).withColumn("order_flow_imbalance", F.coalesce(rolling(F.avg, s, last(10), 10), F.lit(0.0)))
    # a feed in milliseconds
    ms = F.floor(F.col("_us") / 1000)
    e = e.withColumn("_ms", ms).withColumn("_dt", F.greatest(F.lit(0.001), F.coalesce((F.col("_ms") - F.lag("_ms").over(w)) / 1000, F.lit(0.2))))
    away = F.when(F.col("kind") == "imbalance_change", 1.0).otherwise(0.0)
    e = e.withColumn("order_arrival_rate", 1 / F.col("_dt")).withColumn("cancellation_rate", F.coalesce(rolling(F.avg, away, last(20), 20), F.lit(0.0)))
    change = lambda c: F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)) / F.col("_dt")
    e = e.withColumn("imbalance_velocity", change("top_imbalance")).withColumn("spread_velocity", change("spread")).withColumn("microprice_velocity", F.col("microprice") - F.col("mid_price"))
    e = e.withColumn("_r", F.coalesce(F.try_divide(F.col("mid_price"), F.lag("mid_price").over(w)) - 1, F.lit(0.0)))
    # the first 49 events take the first known value, which is in their own block
    e = e.withColumn("_v", F.when(F.col("_rn") >= 49, rolling(F.stddev_samp, "_r", last(50), 50)))
    known = F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("_rn"))).over(Window.partitionBy(*by, "_block"))
    e = e.withColumn("realized_vol_50", F.coalesce("_v", known, F.lit(0.0005)))
    return e.where("_own").drop("_block", "_own", "_rn", "_us", "_ms", "_dt", "_r", "_v")


def analyst_factors(rows: DataFrame, key: Key = BARS) -> DataFrame:
    """Twelve scores of four analysts: technical, order flow, derivatives, sentiment; carried forward, then 0.

    Needs ``sma_ratio_20, sma_ratio_50, vwap_ratio, rsi_14, macd_hist, band_width, percent_b,
    imbalance, spread_bps, volume_z, funding_rate, oi_change_24, oi_vol_ratio, ret_24, sentiment, ts``.
    """
    col = lambda c, missing=0.0: F.coalesce(F.col(c), F.lit(missing))
    past = lambda c: (F.col(c) - rolling(F.avg, c, key.last(168), 24)) / (rolling(F.stddev_samp, c, key.last(168), 24) + 1e-6)
    smooth = lambda k: F.avg("sentiment").over(key.last(k))
    window = F.weekday("ts").isin(2, 4) & F.hour("ts").between(12, 16)
    scores = {
        "tech_trend_score": F.tanh(20 * (0.3 * F.col("sma_ratio_20") + 0.3 * F.col("sma_ratio_50") + 0.2 * F.col("vwap_ratio"))),
        "tech_momentum_score": clip(0.4 * (F.col("rsi_14") - 50) / 50 + 0.3 * F.tanh(F.col("macd_hist") * 10), -1.0, 1.0),
        "tech_breakout_score": clip(0.6 * F.abs(F.col("percent_b") - 0.5) * 2 + 0.4 * F.tanh(F.col("band_width") * 50), 0.0, 1.0),
        "of_imbalance_score": clip(0.4 * F.col("imbalance"), -1.0, 1.0),
        "of_liquidity_score": clip(F.exp(-F.col("spread_bps") / 5), 0.0, 1.0),
        "of_pressure_score": clip(F.coalesce(F.col("imbalance") - lag("imbalance", 3, key), F.lit(0.0)) * F.tanh(F.greatest(F.lit(0.0), col("volume_z"))), -1.0, 1.0),
        "deriv_leverage_risk": clip(1 / (1 + F.exp(-past("oi_vol_ratio"))), 0.0, 1.0),
        "deriv_funding_pressure": F.tanh(0.5 * past("funding_rate")),
        "deriv_oi_pressure": clip(F.signum("ret_24") * F.signum("oi_change_24") * F.abs("oi_change_24") * 5, -1.0, 1.0),
        "sent_sentiment_score": clip(0.4 * F.col("sentiment") + 0.3 * smooth(4) + 0.3 * smooth(24), -1.0, 1.0),
        "sent_sentiment_change": F.tanh(2 * (F.col("sentiment") - F.coalesce(lag("sentiment", 6, key), F.lit(0.0)))),
        "sent_event_intensity": F.when(window, 0.85).otherwise(0.15),
    }
    return rows.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in scores.items()})
