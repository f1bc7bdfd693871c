"""Bars, indicators, labels and as-of joins over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scans
from ..functions import windows as fw
from ..functions.blocks import numbered
from ..operators import bars as ob
from ..operators import indicators as oi
from ..operators import intelligence as on
from ..operators import labels as ol
from . import sql as q
from .registry import query

R = lambda c, as_=None: F.round(F.col(c), 6).alias(as_ or c)
T = lambda: F.col("ts").cast("timestamp_ntz").alias("ts")


@query("bars_hourly", f"WITH {q.BARS} SELECT symbol, ts, open, high, low, close, round(volume, 6) AS volume, n FROM bars")
def bars_hourly(spark: SparkSession, d: str) -> DataFrame:
    return ob.bars(spark, d).select("symbol", T(), "open", "high", "low", "close", R("volume"), "n")


def _stream(spark: SparkSession, d: str, kind: str, name: str) -> DataFrame:
    """A sparse stream: the value of each event of a kind, known when it happens."""
    rows = ob.events(spark, d).where(F.col("event_type") == kind).select(F.col("ts").alias("available_time"), "event_id", F.col("value").alias(name))
    return ob.keep_first(rows, ["available_time"], [F.desc("event_id")]).drop("event_id")


def _stream_sql(kind: str, name: str) -> str:
    return f"SELECT ts AS at, arg_max(value, event_id) AS {name} FROM events WHERE event_type = '{kind}' GROUP BY ts"


@query("feature_slice", f"""
WITH {q.BARS}, f AS ({_stream_sql('error', 'funding')}),
r AS (SELECT *, ln(close / nullif(lag(close) OVER ({q.W}), 0)) AS ret_1, ts + INTERVAL 1 HOUR AS available_time FROM bars)
SELECT symbol, r.ts, round(ret_1, 6) AS ret_1, round(close / nullif({q.rolling('avg', 'close', 20)}, 0) - 1, 6) AS sma_ratio_20,
  round({q.rolling('stddev_samp', 'ret_1', 24)}, 6) AS vol_24, f.funding
FROM r ASOF LEFT JOIN f ON r.available_time >= f.at""")
def feature_slice(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars with return, trend ratio, volatility, and the funding known at the bar's end."""
    b = ob.bars(spark, d).withColumn("ret_1", fw.log_return("close"))
    b = b.withColumn("sma_ratio_20", F.try_divide(F.col("close"), fw.sma("close", 20)) - 1).withColumn("vol_24", fw.rolling_std("ret_1", 24))
    return ob.asof_backward(b, _stream(spark, d, "error", "funding"), ["funding"], []).select("symbol", T(), R("ret_1"), R("sma_ratio_20"), R("vol_24"), "funding")


@query("asof_streams", f"""
WITH f AS ({_stream_sql('error', 'funding')}), o AS ({_stream_sql('signup', 'open_interest')}), j AS (SELECT f.at AS ts, funding, o.open_interest FROM f ASOF LEFT JOIN o ON f.at >= o.at)
SELECT ts, round(funding, 6) AS funding, open_interest, round(open_interest / nullif(lag(open_interest) OVER (ORDER BY ts), 0) - 1, 6) AS oi_change FROM j""")
def asof_streams(spark: SparkSession, d: str) -> DataFrame:
    """Open interest as of each funding event, and its change since the one before, by the events' numbers in the whole stream."""
    j = ob.asof_backward(_stream(spark, d, "error", "funding"), _stream(spark, d, "signup", "open_interest"), ["open_interest"], [])
    k = numbered(j.withColumn("ts", F.col("available_time")), [], "funding")
    before = k.select((F.col("_rn") + 1).alias("_rn"), F.col("open_interest").alias("before"))
    change = F.try_divide(F.col("open_interest"), F.nullif(F.col("before"), F.lit(0.0))) - 1
    return k.join(before, "_rn", "left").select("ts", R("funding"), "open_interest", F.round(change, 6).alias("oi_change"))


@query("asof_by_user", """
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT l.event_id, l.user_id, r.value AS last_click FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_by_user(spark: SparkSession, d: str) -> DataFrame:
    e = ob.events(spark, d)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("last_click"))
    return ob.asof_backward(left, right, ["last_click"], ["user_id"], on="ts").select("event_id", "user_id", "last_click")


@query("asof_tolerance", """
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT l.event_id, CASE WHEN l.ts - r.ts <= INTERVAL 6 HOUR THEN r.value END AS last_click FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_tolerance(spark: SparkSession, d: str) -> DataFrame:
    e = ob.events(spark, d)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("last_click"))
    return ob.asof_backward(left, right, ["last_click"], ["user_id"], on="ts", tolerance="6 hours").select("event_id", "last_click")


_RET = f"r AS (SELECT *, ln(close / nullif(lag(close) OVER ({q.W}), 0)) AS ret_1 FROM bars)"


TECH = f"""d AS (SELECT *, close - lag(close) OVER ({q.W}) AS d, greatest(high - low, abs(high - lag(close) OVER ({q.W})), abs(low - lag(close) OVER ({q.W}))) AS tr FROM r),
e AS (SELECT *, {q.ewm('greatest(d, 0.0 * d)', 1 / 14, 14)} AS g, {q.ewm('greatest(-d, 0.0 * d)', 1 / 14, 14)} AS l, {q.ewm('close', 2 / 13)} - {q.ewm('close', 2 / 27)} AS macd, {q.ewm('tr', 1 / 14, 14)} AS atr FROM d),
t AS (SELECT *, {q.ewm('macd', 2 / 10)} AS sig, 100 - 100 / (1 + g / nullif(l, 0)) AS rsi, ln(close / nullif(lag(close, 4) OVER ({q.W}), 0)) AS ret_4, ln(close / nullif(lag(close, 24) OVER ({q.W}), 0)) AS ret_24,
  close / nullif({q.rolling('avg', 'close', 20)}, 0) - 1 AS sma_20, close / nullif({q.rolling('avg', 'close', 50)}, 0) - 1 AS sma_50, {q.rolling('stddev_samp', 'ret_1', 24)} AS vol_24,
  (volume - {q.rolling('avg', 'volume', 24)}) / nullif({q.rolling('stddev_samp', 'volume', 24)}, 0) AS volume_z FROM e)"""


@query("technical_block", f"""
WITH {q.BARS}, {_RET}, {TECH}
SELECT symbol, ts, round(ret_4, 6) AS ret_4, round(ret_24, 6) AS ret_24, round(sma_50, 6) AS sma_ratio_50, round(vol_24, 6) AS vol_24, round(volume_z, 6) AS volume_z,
  round(rsi, 6) AS rsi_14, round(macd, 6) AS macd, round(sig, 6) AS macd_signal, round(macd - sig, 6) AS macd_hist, round(atr, 6) AS atr_wilder
FROM t""")
def technical_block(spark: SparkSession, d: str) -> DataFrame:
    return oi.technical(ob.bars(spark, d)).select("symbol", T(), *map(R, ("ret_4", "ret_24", "sma_ratio_50", "vol_24", "volume_z", "rsi_14", "macd", "macd_signal", "macd_hist", "atr_wilder")))


@query("cache_block", f"""
WITH {q.BARS}, {_RET}, {TECH}
SELECT symbol, ts, round(coalesce(ret_1, 0), 6) AS ret_1, round(coalesce(ret_24, 0), 6) AS ret_24, round(coalesce(rsi, 50), 6) AS rsi_14, round(coalesce(sma_20, 0), 6) AS sma_ratio_20, round(coalesce(vol_24, 0.015), 6) AS vol_24,
  round(coalesce({q.rolling('avg', 'tr', 14)}, 0.01 * close), 6) AS atr_simple FROM t""")
def cache_block(spark: SparkSession, d: str) -> DataFrame:
    return oi.cache_block(ob.bars(spark, d)).select("symbol", T(), *map(R, ("ret_1", "ret_24", "rsi_14", "sma_ratio_20", "vol_24", "atr_simple")))


@query("live_momentum", f"""
WITH {q.BARS}, d AS (SELECT *, close - lag(close) OVER ({q.W}) AS d, lag(close) OVER ({q.W}) AS pc, high - lag(high) OVER ({q.W}) AS up, lag(low) OVER ({q.W}) - low AS dn, row_number() OVER ({q.W}) AS rn FROM bars),
x AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, CASE WHEN pc IS NOT NULL THEN CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END END AS p, CASE WHEN pc IS NOT NULL THEN CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END END AS m FROM d),
e AS (SELECT *, {q.ewm('close', 2 / 21)} AS e20, {q.ewm('close', 2 / 51)} AS e50, {q.ewm('close', 2 / 201)} AS e200, {q.ewm('close', 2 / 13)} - {q.ewm('close', 2 / 27)} AS macd, {q.ewm('greatest(d, 0.0 * d)', 1 / 14)} AS g, {q.ewm('greatest(-d, 0.0 * d)', 1 / 14)} AS l,
  {q.ewm('tr', 2 / 15)} AS a, {q.ewm('p', 2 / 15)} AS ps, {q.ewm('m', 2 / 15)} AS ms FROM x),
s AS (SELECT *, {q.ewm('macd', 2 / 10)} AS sig, 100 * ps / (a + 1e-8) AS pdi, 100 * ms / (a + 1e-8) AS mdi FROM e)
SELECT symbol, ts, round(close / nullif(e20, 0) - 1, 6) AS ema_ratio_20, round(close / nullif(e50, 0) - 1, 6) AS ema_ratio_50, round(close / nullif(e200, 0) - 1, 6) AS ema_ratio_200,
  round((CASE WHEN rn >= 15 THEN 100 - 100 / (1 + g / (l + 1e-8)) ELSE 50.0 END - 50) / 50, 6) AS live_rsi, round(macd / nullif(close, 0), 5) AS live_macd, round((macd - sig) / nullif(close, 0), 5) AS live_macd_hist,
  round(coalesce(a, high - low) / nullif(close, 0), 5) AS atr_ratio, round(CASE WHEN rn >= 15 THEN abs(pdi - mdi) / (pdi + mdi + 1e-8) ELSE 0.25 END, 6) AS live_dx, round(CASE WHEN rn >= 15 THEN (pdi - mdi) / (pdi + mdi + 1e-8) ELSE 0.0 END, 6) AS di_spread FROM s""")
def live_momentum(spark: SparkSession, d: str) -> DataFrame:
    five = [F.round(c, 5).alias(c) for c in ("live_macd", "live_macd_hist", "atr_ratio")]
    return oi.live_momentum(ob.bars(spark, d)).select("symbol", T(), *map(R, ("ema_ratio_20", "ema_ratio_50", "ema_ratio_200", "live_rsi", "live_dx", "di_spread")), *five)


@query("book_pressure", """
WITH e AS (SELECT event_id, user_id % 13 + 1 AS b, event_id % 11 + 1 AS a, value AS oi, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_id % 101 AS fg FROM events)
SELECT event_id, round((b - a) / (b + a + 1e-8), 6) AS order_book_imbalance, round(ln(1 + b + a), 6) AS depth_liquidity, round((oi - coalesce(before, oi)) / (coalesce(before, oi) + 1e-8), 5) AS open_interest_delta, round((fg - 50) / 50, 6) AS fear_greed_index FROM e""")
def book_pressure(spark: SparkSession, d: str) -> DataFrame:
    """Depths, open interest and fear-and-greed of a live row; each user's stream is a venue's."""
    e = ob.events(spark, d)
    before = fw.lag("value", 1, fw.Key(("user_id",), ("ts", "event_id")))
    rows = ob.l2_events(e).join(e.select("event_id", F.col("value").alias("open_interest"), F.coalesce(before, F.col("value")).alias("open_interest_before"), (F.col("event_id") % 101).cast("double").alias("fear_greed")), "event_id")
    return oi.book_pressure(rows).select("event_id", R("order_book_imbalance"), R("depth_liquidity"), F.round("open_interest_delta", 5).alias("open_interest_delta"), R("fear_greed_index"))


@query("atr_variants", f"""
WITH {q.BARS}, d AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({q.W})), abs(low - lag(close) OVER ({q.W}))) AS tr FROM bars)
SELECT symbol, ts, round({q.ewm('tr', 2 / 15)}, 6) AS atr_span, round({q.rolling('avg', 'tr', 14)}, 6) AS atr_simple FROM d""")
def atr_variants(spark: SparkSession, d: str) -> DataFrame:
    return oi.atr_simple(oi.atr_span(ob.bars(spark, d))).select("symbol", T(), R("atr_span"), R("atr_simple"))


@query("live_block", f"""
WITH {q.BARS}, {_RET},
v AS (SELECT *, (high + low + close) / 3 AS tp, coalesce(sign(close - lag(close) OVER ({q.W})), 0) * volume AS signed FROM r),
o AS (SELECT *, sum(signed) OVER ({q.W} ROWS UNBOUNDED PRECEDING) AS obv, {q.rolling('avg', 'close', 20)} AS mid, {q.rolling('stddev_pop', 'close', 20)} AS dev FROM v)
SELECT symbol, ts, round({q.rolling('stddev_pop', 'ret_1', 24)} * sqrt(24), 6) AS live_vol,
  round((volume - {q.rolling('avg', 'volume', 20)}) / nullif({q.rolling('stddev_pop', 'volume', 20)}, 0), 5) AS live_volume_z,
  round(close / nullif(sum(tp * volume) {q.last(500)} / nullif(sum(volume) {q.last(500)}, 0), 0) - 1, 6) AS vwap_ratio,
  round(close / nullif(lag(close, 10) OVER ({q.W}), 0) - 1, 6) AS roc_10,
  round((obv - {q.rolling('avg', 'obv', 20)}) / nullif({q.rolling('stddev_pop', 'obv', 20)}, 0), 5) AS obv_z,
  round(4 * dev / nullif(mid, 0), 6) AS band_width, round((close - (mid - 2 * dev)) / nullif(4 * dev, 0), 6) AS percent_b
FROM o""")
def live_block(spark: SparkSession, d: str) -> DataFrame:
    five = [F.round(c, 5).alias(c) for c in ("live_volume_z", "obv_z")]
    return oi.live_block(ob.bars(spark, d)).select("symbol", T(), R("live_vol"), *five, R("vwap_ratio"), R("roc_10"), R("band_width"), R("percent_b"))


def _adx_sql(high: str, low: str, source: str) -> str:
    """CTEs that end in ``adx`` over ``source``, with ``pdi``, ``mdi`` and ``adx``."""
    return f"""mv AS (SELECT *, {high} - lag({high}) OVER ({q.W}) AS up, lag({low}) OVER ({q.W}) - {low} AS dn, greatest({high} - {low}, abs({high} - lag(close) OVER ({q.W})), abs({low} - lag(close) OVER ({q.W}))) AS atrue FROM {source}),
pm AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS m FROM mv),
sm AS (SELECT *, {q.ewm('atrue', 1 / 14, 14)} AS sa, {q.ewm('p', 1 / 14, 14)} AS sp, {q.ewm('m', 1 / 14, 14)} AS sn FROM pm), di AS (SELECT *, 100 * sp / (sa + 1e-8) AS pdi, 100 * sn / (sa + 1e-8) AS mdi FROM sm),
dx AS (SELECT *, 100 * abs(pdi - mdi) / (pdi + mdi + 1e-8) AS dx FROM di), adx AS (SELECT *, coalesce({q.ewm('dx', 1 / 14, 14)}, 25.0) AS adx FROM dx)"""


@query("directional_movement", f"WITH {q.BARS}, {_adx_sql('high', 'low', 'bars')} SELECT symbol, ts, round(pdi, 5) AS plus_di, round(mdi, 5) AS minus_di, round(adx, 5) AS adx FROM adx")
def directional_movement(spark: SparkSession, d: str) -> DataFrame:
    return oi.directional(ob.bars(spark, d)).select("symbol", T(), *[F.round(c, 5).alias(c) for c in ("plus_di", "minus_di", "adx")])


MICRO_SQL = f"""g AS (SELECT *, pow(sum(ln(high / nullif(low, 0))) OVER two, 2) AS beta, pow(ln(max(high) OVER two / nullif(min(low) OVER two, 0)), 2) AS gamma, (close - low) / nullif(high - low, 0) AS c FROM bars WINDOW two AS ({q.W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
a AS (SELECT *, greatest(0, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2)) - sqrt(gamma / (3 - 2 * sqrt(2)))) AS al, volume * c AS buy, volume * (1 - c) AS sell, coalesce((c - 0.5) * 2, 0) AS o FROM g),
mi AS (SELECT *, CASE WHEN beta IS NULL OR gamma IS NULL THEN 0.0005 ELSE 2 * (exp(al) - 1) / (1 + exp(al)) END AS spread, avg(o) {q.last(3)} AS imbalance, coalesce(buy / (buy + sell + 1e-8), 0.5) AS taker_share,
  least(1, coalesce(sum(abs(buy - sell)) {q.last(24)} / nullif(sum(volume) {q.last(24)}, 0), 0.2)) AS vpin FROM a)"""


@query("microstructure_block", f"WITH {q.BARS}, {MICRO_SQL} SELECT symbol, ts, round(spread, 6) AS spread, round(imbalance, 6) AS imbalance, round(taker_share, 6) AS taker_share, round(vpin, 6) AS vpin FROM mi")
def microstructure_block(spark: SparkSession, d: str) -> DataFrame:
    return oi.microstructure(ob.bars(spark, d)).select("symbol", T(), R("spread"), R("imbalance"), R("taker_share"), R("vpin"))


def _swing(name: str, source: str, best: str) -> str:
    w = f"OVER ({q.W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
    return f"CASE WHEN count(*) {w} = 7 AND {source} = {best}({source}) {w} THEN {source} END AS {name}"


@query("market_structure", f"""
WITH {q.BARS}, c AS (SELECT *, row_number() OVER ({q.W}) AS i, {_swing('sh', 'high', 'max')}, {_swing('sl', 'low', 'min')} FROM bars),
a AS (SELECT *, list(sh) FILTER (WHERE sh IS NOT NULL) OVER w AS hs, list(sl) FILTER (WHERE sl IS NOT NULL) OVER w AS ls FROM c WINDOW w AS ({q.W} ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING)),
k AS (SELECT *, hs[-1] AS h1, ls[-1] AS l1, coalesce(hs[-1] > hs[-2], false) AS hh, coalesce(hs[-1] < hs[-2], false) AS lh, coalesce(ls[-1] > ls[-2], false) AS hl, coalesce(ls[-1] < ls[-2], false) AS ll FROM a)
SELECT symbol, ts, CASE WHEN hh AND hl THEN 'Bullish' WHEN lh AND ll THEN 'Bearish' WHEN hh THEN 'Consolidating Bullish' WHEN lh THEN 'Consolidating Bearish' ELSE 'Ranging' END AS structure,
  CASE WHEN hh AND hl THEN 84 WHEN lh AND ll THEN 78 WHEN hh THEN 65 WHEN lh THEN 60 ELSE 52 END AS trend_strength, round((close - coalesce(h1, close)) / nullif(coalesce(h1, close), 0) * 100, 2) AS break_pct,
  coalesce(hh AND close < l1, false) OR coalesce(ll AND close > h1, false) AS change_of_character, coalesce(h1, close) AS last_swing_high, coalesce(l1, close) AS last_swing_low FROM k""")
def market_structure(spark: SparkSession, d: str) -> DataFrame:
    return on.structure(ob.bars(spark, d)).select("symbol", T(), "structure", "trend_strength", F.round("break_pct", 2).alias("break_pct"), "change_of_character", "last_swing_high", "last_swing_low")


@query("market_liquidity", f"""
WITH {q.BARS}, a AS (SELECT *, list_sort(list(high) {q.last(20)}) AS hs, list_sort(list(low) {q.last(20)}) AS ls, 2.5 * greatest(abs(close - open), 10.0) AS body FROM bars),
k AS (SELECT *, list_filter(range(1, len(hs)), lambda i: (hs[i + 1] - hs[i]) / nullif(hs[i], 0) < 0.0015)[1] AS hi, list_filter(range(1, len(ls)), lambda i: (ls[i + 1] - ls[i]) / nullif(ls[i], 0) < 0.0015)[1] AS li FROM a),
s AS (SELECT *, CASE WHEN high - greatest(close, open) > body THEN 'UPPER_WICK' WHEN least(close, open) - low > body THEN 'LOWER_WICK' ELSE 'NONE' END AS sweep FROM k)
SELECT symbol, ts, hi IS NOT NULL AS equal_highs, li IS NOT NULL AS equal_lows, sweep, CASE WHEN sweep <> 'NONE' THEN 'HIGH' WHEN hi IS NOT NULL OR li IS NOT NULL THEN 'ELEVATED' ELSE 'LOW' END AS risk,
  round(CASE WHEN hi IS NOT NULL THEN hs[hi + 1] WHEN li IS NOT NULL THEN ls[li] ELSE close * 1.012 END, 4) AS sweep_target FROM s""")
def market_liquidity(spark: SparkSession, d: str) -> DataFrame:
    return on.liquidity(ob.bars(spark, d)).select("symbol", T(), "equal_highs", "equal_lows", "sweep", "risk", F.round("sweep_target", 4).alias("sweep_target"))


@query("market_momentum", f"""
WITH {q.BARS}, a AS (SELECT *, coalesce((close - lag(close, 14) OVER ({q.W})) / nullif(lag(close, 14) OVER ({q.W}), 0), 0.01) AS roc, volume / nullif(avg(volume) {q.last(20)}, 0) AS ve, coalesce(CAST(close > lag(close) OVER ({q.W}) AS INTEGER), 0) AS up FROM bars),
k AS (SELECT *, CAST(trunc(greatest(15.0, least(95.0, 50 + roc * 500 + (ve - 1) * 20))) AS INTEGER) AS strength, CAST(trunc(avg(up) {q.last(10)} * 100) AS INTEGER) AS persistence FROM a)
SELECT symbol, ts, CASE WHEN strength >= 65 THEN 'Expanding' WHEN strength <= 35 THEN 'Compressing' ELSE 'Neutral' END AS momentum, strength AS momentum_strength, round(roc * 100, 2) AS roc_14_pct, round(ve, 4) AS volume_expansion, persistence FROM k""")
def market_momentum(spark: SparkSession, d: str) -> DataFrame:
    return on.momentum(ob.bars(spark, d)).select("symbol", T(), "momentum", "momentum_strength", F.round("roc_14_pct", 2).alias("roc_14_pct"), F.round("volume_expansion", 4).alias("volume_expansion"), "persistence")


@query("market_volatility", f"""
WITH {q.BARS}, r AS (SELECT *, ln(close / lag(close) OVER ({q.W})) AS x FROM bars), v AS (SELECT *, stddev_samp(x) {q.last(24)} AS v, count(x) {q.last(24)} AS k FROM r),
h AS (SELECT *, list(v) FILTER (WHERE k = 24) {q.last(697)} AS past FROM v), p AS (SELECT *, coalesce(100.0 * len(list_filter(past, lambda y: y < v)) / nullif(len(past), 0), 35.0) AS p FROM h)
SELECT symbol, ts, CASE WHEN p < 25 THEN 'Compression' WHEN p < 60 THEN 'Quiet' WHEN p < 85 THEN 'Expansion' WHEN p < 95 THEN 'Exhaustion' ELSE 'Panic' END AS volatility_state, CAST(trunc(p) AS INTEGER) AS volatility_percentile, round(v, 4) AS realized_vol_24 FROM p""")
def market_volatility(spark: SparkSession, d: str) -> DataFrame:
    return on.volatility(ob.bars(spark, d)).select("symbol", T(), "volatility_state", "volatility_percentile", F.round("realized_vol_24", 4).alias("realized_vol_24"))


@query("volatility_term_structure", f"""
WITH {q.BARS}, {_RET}, f AS (SELECT *, ln(close / nullif(lag(close, 4) OVER ({q.W}), 0)) AS r4, ln(close / nullif(lag(close, 24) OVER ({q.W}), 0)) AS r24 FROM r),
v AS (SELECT symbol, ts, {q.rolling('stddev_samp', 'ret_1', 24)} AS v1, {q.rolling('stddev_samp', 'r4', 6)} AS v4, {q.rolling('stddev_samp', 'r24', 14)} AS v24 FROM f),
x AS (SELECT symbol, ts, v1 / sqrt(12) * sqrt(288) / greatest(1e-6, v24) AS a, v1 * sqrt(24) / greatest(1e-6, v24) AS b, v4 * sqrt(6) / greatest(1e-6, v24) AS c FROM v WHERE v24 IS NOT NULL)
SELECT symbol, ts, round(a, 5) AS ratio_5m_24h, round(b, 5) AS ratio_1h_24h, round(c, 5) AS ratio_4h_24h, CASE WHEN b > 1.3 OR a > 1.4 THEN 'VOL_EXPANDING' WHEN b < 0.75 THEN 'VOL_COMPRESSION' WHEN c > 1.5 THEN 'PEAK_VOLATILITY' ELSE 'NORMAL' END AS vol_regime FROM x""")
def volatility_term_structure(spark: SparkSession, d: str) -> DataFrame:
    """Volatilities of 1, 4 and 24 hours; that of five minutes is the hour's by the root of time."""
    b = ob.bars(spark, d)
    for k in (1, 4, 24):
        b = b.withColumn(f"r{k}", fw.log_return("close", k))
    b = b.withColumn("vol_1h", fw.rolling_std("r1", 24)).withColumn("vol_4h", fw.rolling_std("r4", 6)).withColumn("vol_24h", fw.rolling_std("r24", 14)).where("vol_24h is not null").withColumn("vol_5m", F.col("vol_1h") / F.sqrt(F.lit(12.0)))
    return oi.term_structure(b).select("symbol", T(), *[F.round(c, 5).alias(c) for c in ("ratio_5m_24h", "ratio_1h_24h", "ratio_4h_24h")], "vol_regime")


def _mtf_sql() -> str:
    rsi = lambda k: f"100 - 100 / (1 + {q.ewm('greatest(d, 0.0 * d)', 1 / k, k)} / ({q.ewm('greatest(-d, 0.0 * d)', 1 / k, k)} + 1e-8))"
    lagged = lambda k: f"ln(close / nullif(lag(close, {k}) OVER ({q.W}), 0))"
    f = ", ".join(f"round(coalesce(last_value(x_{c} IGNORE NULLS) OVER ({q.W} ROWS UNBOUNDED PRECEDING), 0.0), {4 if 'rsi' in c or 'adx' in c or 'vol_z' in c else 6}) AS mtf_{c}" for c in oi.MTF)
    return f"""
WITH {q.BARS}, b0 AS (SELECT *, close - lag(close) OVER ({q.W}) AS d, {q.rolling('max', 'high', 4)} AS h4, {q.rolling('min', 'low', 4)} AS l4, {q.rolling('sum', 'volume', 4)} AS v4, {q.rolling('sum', 'volume', 24)} AS v24 FROM bars),
b1 AS (SELECT *, {lagged(1)} AS x_1h_ret, {lagged(4)} AS x_4h_ret, {lagged(12)} AS x_12h_ret, {lagged(24)} AS x_1d_ret, {rsi(14)} AS x_1h_rsi, {rsi(56)} AS x_4h_rsi, {rsi(168)} AS x_12h_rsi, {q.ewm_adjusted('close', 2 / 21)} AS e20, {q.ewm_adjusted('close', 2 / 121)} AS e120 FROM b0),
{_adx_sql('h4', 'l4', 'b1')},
x AS (SELECT *, adx AS x_4h_adx, {q.rolling('stddev_samp', 'x_1h_ret', 24)} AS x_1h_vol, {q.rolling('stddev_samp', 'x_4h_ret', 6)} AS x_4h_vol, {q.rolling('stddev_samp', 'x_12h_ret', 10)} AS x_12h_vol, {q.rolling('stddev_samp', 'x_1d_ret', 14)} AS x_1d_vol,
  e20 / nullif(lag(e20, 3) OVER ({q.W}), 0) - 1 AS x_1h_ema_slope, (v4 - {q.rolling('avg', 'v4', 24)}) / ({q.rolling('stddev_samp', 'v4', 24)} + 1e-6) AS x_4h_vol_z, CASE WHEN close > e120 THEN 1.0 ELSE -1.0 END AS x_12h_trend_state,
  close / nullif({q.rolling('avg', 'close', 1200, 200)}, 0) - 1 AS x_1d_sma_ratio_50, v24 / ({q.rolling('avg', 'volume', 480, 48)} + 1e-6) AS x_1d_vol_ratio FROM adx)
SELECT symbol, ts, {f} FROM x"""


@query("multi_timeframe", _mtf_sql())
def multi_timeframe(spark: SparkSession, d: str) -> DataFrame:
    out = oi.multi_timeframe(ob.bars(spark, d))
    return out.select("symbol", T(), *[F.round(f"mtf_{c}", 4 if "rsi" in c or "adx" in c or "vol_z" in c else 6).alias(f"mtf_{c}") for c in oi.MTF])


def states(spark: SparkSession, d: str) -> DataFrame:
    """Bars with technical columns, and funding and open interest as of each bar's end."""
    b = oi.technical(ob.bars(spark, d))
    b = ob.asof_backward(b, _stream(spark, d, "error", "funding"), ["funding"], [])
    b = ob.asof_backward(b, _stream(spark, d, "signup", "open_interest"), ["open_interest"], [])
    return b.withColumn("funding_rate", F.col("funding") / 1e6 - 0.0002).withColumn("oi_change_24", fw.pct_change("open_interest", 24))


STATES = f"""{q.BARS}, {_RET}, {TECH}, f AS ({_stream_sql('error', 'funding')}), oi AS ({_stream_sql('signup', 'open_interest')}),
j1 AS (SELECT t.*, f.funding FROM t ASOF LEFT JOIN f ON t.ts + INTERVAL 1 HOUR >= f.at), j2 AS (SELECT j1.*, oi.open_interest FROM j1 ASOF LEFT JOIN oi ON j1.ts + INTERVAL 1 HOUR >= oi.at),
st AS (SELECT *, funding / 1e6 - 0.0002 AS funding_rate, open_interest / nullif(lag(open_interest, 24) OVER ({q.W}), 0) - 1 AS oi_change_24, coalesce(vol_24, 0.01) AS v,
  0.5 * coalesce(CASE WHEN sma_50 IS NOT NULL THEN least(greatest(sma_50 * 10, -1), 1) END, 0) + 0.3 * coalesce(CASE WHEN ret_24 IS NOT NULL THEN least(greatest(ret_24 * 20, -1), 1) END, 0) + 0.2 * coalesce(sign(macd), 0) AS trend_score FROM j2)"""


@query("market_state", f"""
WITH {STATES}, w AS (SELECT symbol, quantile_cont(v, 0.33) AS wl, quantile_cont(v, 0.66) AS wh FROM st GROUP BY symbol),
k AS (SELECT st.*, coalesce(CASE WHEN count(v) OVER w >= 24 THEN quantile_cont(v, 0.33) OVER w END, wl) AS lo, coalesce(CASE WHEN count(v) OVER w >= 24 THEN quantile_cont(v, 0.66) OVER w END, wh) AS hi FROM st JOIN w USING (symbol) WINDOW w AS ({q.W} ROWS UNBOUNDED PRECEDING)),
n AS (SELECT *, CASE WHEN v <= lo THEN 'LOW' WHEN v <= hi THEN 'MEDIUM' ELSE 'HIGH' END AS vs, CASE WHEN rsi > 55 AND ret_4 > 0 THEN 'POSITIVE' WHEN rsi < 45 AND ret_4 < 0 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS ms,
  CASE WHEN funding_rate > 0.0003 THEN 'EXTREME_POSITIVE' WHEN funding_rate > 0.0001 THEN 'POSITIVE' WHEN funding_rate < -0.0003 THEN 'EXTREME_NEGATIVE' WHEN funding_rate < -0.0001 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS fs,
  CASE WHEN oi_change_24 > 0.03 THEN 'ELEVATED' WHEN oi_change_24 < -0.03 THEN 'SUBDUED' ELSE 'NORMAL' END AS ls FROM k)
SELECT symbol, ts, round(trend_score, 6) AS trend_score, vs AS volatility_state, ms AS momentum_state, fs AS funding_state, ls AS leverage_state,
  CASE WHEN vs = 'HIGH' THEN 'HIGH_VOLATILITY' WHEN ls = 'ELEVATED' AND abs(trend_score) > 0.2 THEN 'BREAKOUT' WHEN trend_score > 0.15 AND ms <> 'NEGATIVE' THEN 'TRENDING_BULL' WHEN trend_score < -0.15 AND ms <> 'POSITIVE' THEN 'TRENDING_BEAR' ELSE 'RANGING' END AS regime FROM n""")
def market_state(spark: SparkSession, d: str) -> DataFrame:
    return oi.market_state(states(spark, d)).select("symbol", T(), R("trend_score"), "volatility_state", "momentum_state", "funding_state", "leverage_state", "regime")


@query("event_flags", f"""
WITH {STATES}, f2 AS (SELECT symbol, ts, list_filter([CASE WHEN volume_z > 3 THEN 'LIQUIDATION_CASCADE' END, CASE WHEN abs(funding_rate) > 0.0005 THEN 'FUNDING_EXTREME' END, CASE WHEN abs(oi_change_24) > 0.06 THEN 'OPEN_INTEREST_BURST' END, CASE WHEN vol_24 > 0.04 THEN 'MACRO_VOLATILITY_SPIKE' END], lambda x: x IS NOT NULL) AS fl FROM st),
g AS (SELECT symbol, ts, CASE WHEN len(fl) = 0 THEN ['NORMAL_MARKET_FLOW'] ELSE fl END AS fl FROM f2)
SELECT symbol, ts, array_to_string(fl, ',') AS flags,
  round(0.35 * CAST(list_contains(fl, 'LIQUIDATION_CASCADE') AS INT) + 0.40 * CAST(list_contains(fl, 'MACRO_VOLATILITY_SPIKE') AS INT) + 0.20 * CAST(list_contains(fl, 'FUNDING_EXTREME') AS INT), 6) AS high_volatility,
  round(0.20 * CAST(list_contains(fl, 'LIQUIDATION_CASCADE') AS INT) + 0.30 * CAST(list_contains(fl, 'OPEN_INTEREST_BURST') AS INT), 6) AS breakout,
  round(-0.30 * CAST(list_contains(fl, 'LIQUIDATION_CASCADE') AS INT) - 0.30 * CAST(list_contains(fl, 'MACRO_VOLATILITY_SPIKE') AS INT) - 0.20 * CAST(list_contains(fl, 'OPEN_INTEREST_BURST') AS INT), 6) AS ranging FROM g""")
def event_flags(spark: SparkSession, d: str) -> DataFrame:
    """All flags of a bar, and what they add to the regimes' probabilities."""
    s = states(spark, d).withColumn("fl", oi.event_flags(F.col("volume_z"), F.col("funding_rate"), F.col("oi_change_24"), F.col("vol_24")))
    return s.select("symbol", T(), F.array_join("fl", ",").alias("flags"), *[F.round(oi.regime_modifier(F.col("fl"), r), 6).alias(r) for r in ("high_volatility", "breakout", "ranging")])


@query("regime_rules", f"""
WITH {STATES} SELECT symbol, CASE WHEN v > 0.04 THEN 'HIGH_VOLATILITY' WHEN trend_score > 0.3 AND rsi > 60 THEN 'BREAKOUT' WHEN trend_score > 0.15 THEN 'TRENDING_BULL' WHEN trend_score < -0.15 THEN 'TRENDING_BEAR' ELSE 'RANGING' END AS heat_map,
  CASE WHEN open < 20 OR close / 500 < 0 THEN 'CAPITULATION' WHEN open >= 400 OR close / 500 >= 0.7 THEN 'EUPHORIA' WHEN open < 60 AND close / 500 < 0.25 THEN 'ACCUMULATION' ELSE 'NEUTRAL' END AS macro_cycle, count(*) AS n FROM st GROUP BY ALL""")
def regime_rules(spark: SparkSession, d: str) -> DataFrame:
    """Heat-map regime and macro cycle of each bar; valuations are stood in for by prices (an open of 20 is a ratio of 1)."""
    s = states(spark, d).withColumn("trend_score", oi.trend_score())
    heat = oi.heat_map_regime(F.coalesce("vol_24", F.lit(0.01)), F.col("trend_score"), F.col("rsi_14"))
    ratio = F.when(F.col("open") < 20, 0.5).when(F.col("open") >= 400, 4.0).when(F.col("open") < 60, 1.3).otherwise(2.0)
    return s.groupBy("symbol", heat.alias("heat_map"), oi.macro_cycle(ratio, F.col("close") / 500).alias("macro_cycle")).agg(F.count("*").alias("n"))


@query("analyst_factors", f"""
WITH {STATES}, {MICRO_SQL.replace('FROM bars', 'FROM st')},
u AS (SELECT *, (close - open) / nullif(close, 0) AS sentiment, open_interest / nullif(volume, 0) AS oi_vol, {q.rolling('avg', 'close', 20)} AS mid, {q.rolling('stddev_pop', 'close', 20)} AS dev, sum((high + low + close) / 3 * volume) {q.last(500)} / nullif(sum(volume) {q.last(500)}, 0) AS vw FROM mi),
y AS (SELECT *, (funding_rate - CASE WHEN count(funding_rate) {q.last(168)} >= 24 THEN avg(funding_rate) {q.last(168)} END) / (CASE WHEN count(funding_rate) {q.last(168)} >= 24 THEN stddev_samp(funding_rate) {q.last(168)} END + 1e-6) AS fz,
  (oi_vol - CASE WHEN count(oi_vol) {q.last(168)} >= 24 THEN avg(oi_vol) {q.last(168)} END) / (CASE WHEN count(oi_vol) {q.last(168)} >= 24 THEN stddev_samp(oi_vol) {q.last(168)} END + 1e-6) AS oz FROM u),
z AS (SELECT *, 0.4 * (rsi - 50) / 50 + 0.3 * tanh((macd - sig) * 10) AS mo, 0.6 * abs((close - (mid - 2 * dev)) / nullif(4 * dev, 0) - 0.5) * 2 + 0.4 * tanh(4 * dev / nullif(mid, 0) * 50) AS br,
  coalesce(imbalance - lag(imbalance, 3) OVER ({q.W}), 0) * tanh(greatest(0, coalesce(volume_z, 0))) AS pr, sign(ret_24) * sign(oi_change_24) * abs(oi_change_24) * 5 AS op, 0.4 * sentiment + 0.3 * avg(sentiment) {q.last(4)} + 0.3 * avg(sentiment) {q.last(24)} AS se FROM y)
SELECT symbol, ts, round(coalesce(tanh(20 * (0.3 * sma_20 + 0.3 * sma_50 + 0.2 * (close / nullif(vw, 0) - 1))), 0), 6) AS tech_trend_score, round(coalesce(CASE WHEN mo IS NOT NULL THEN least(greatest(mo, -1), 1) END, 0), 6) AS tech_momentum_score,
  round(coalesce(CASE WHEN br IS NOT NULL THEN least(greatest(br, 0), 1) END, 0), 5) AS tech_breakout_score, round(0.4 * imbalance, 6) AS of_imbalance_score, round(exp(-spread * 10000 / 5), 6) AS of_liquidity_score, round(least(greatest(pr, -1), 1), 6) AS of_pressure_score,
  round(coalesce(1 / (1 + exp(-oz)), 0), 5) AS deriv_leverage_risk, round(coalesce(tanh(0.5 * fz), 0), 4) AS deriv_funding_pressure, round(coalesce(CASE WHEN op IS NOT NULL THEN least(greatest(op, -1), 1) END, 0), 6) AS deriv_oi_pressure,
  round(coalesce(CASE WHEN se IS NOT NULL THEN least(greatest(se, -1), 1) END, 0), 6) AS sent_sentiment_score, round(coalesce(tanh(2 * (sentiment - coalesce(lag(sentiment, 6) OVER ({q.W}), 0))), 0), 6) AS sent_sentiment_change,
  CASE WHEN isodow(ts) IN (3, 5) AND hour(ts) BETWEEN 12 AND 16 THEN 0.85 ELSE 0.15 END AS sent_event_intensity FROM z""")
def analyst_factors(spark: SparkSession, d: str) -> DataFrame:
    s = oi.microstructure(states(spark, d)).withColumn("sentiment", F.try_divide(F.col("close") - F.col("open"), F.col("close"))).withColumn("spread_bps", F.col("spread") * 10_000).withColumn("oi_vol_ratio", F.try_divide("open_interest", "volume"))
    s = oi.analyst_factors(oi.live_block(s))
    n = {"tech_breakout_score": 5, "deriv_leverage_risk": 5, "deriv_funding_pressure": 4}
    names = ("tech_trend_score", "tech_momentum_score", "tech_breakout_score", "of_imbalance_score", "of_liquidity_score", "of_pressure_score", "deriv_leverage_risk", "deriv_funding_pressure", "deriv_oi_pressure", "sent_sentiment_score", "sent_sentiment_change", "sent_event_intensity")
    return s.select("symbol", T(), *[F.round(c, n.get(c, 6)).alias(c) for c in names])


@query("event_time_features", """
WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, value - (event_id % 7 + 1) * 0.005 AS bid, value + (event_id % 7 + 1) * 0.005 AS ask, CAST(user_id % 13 + 1 AS DOUBLE) AS db, CAST(event_id % 11 + 1 AS DOUBLE) AS da,
  CASE event_type WHEN 'purchase' THEN value WHEN 'click' THEN -value ELSE 0 END AS s, (event_id % 21 - 10) / 10.0 AS im, CASE WHEN event_type IN ('purchase', 'click', 'view') THEN 0.0 ELSE 1.0 END AS away FROM events),
m AS (SELECT *, (bid + ask) / 2 AS mid, ask - bid AS spread, (db * ask + da * bid) / (db + da + 1e-6) AS micro, (db - da) / (db + da + 1e-6) AS ti, greatest(0.001, coalesce((ms - lag(ms) OVER w) / 1000, 0.2)) AS dt FROM e WINDOW w AS (ORDER BY rn)),
v AS (SELECT *, coalesce(mid / nullif(lag(mid) OVER w, 0) - 1, 0) AS r, coalesce(CASE WHEN rn >= 19 THEN sum(greatest(s, 0)) OVER t END, 0.01) AS buy, coalesce(CASE WHEN rn >= 19 THEN sum(greatest(-s, 0)) OVER t END, 0.01) AS sell, coalesce(CASE WHEN rn >= 19 THEN avg(away) OVER t END, 0) AS canc,
  coalesce(CASE WHEN rn >= 9 THEN avg(s) OVER u END, 0) AS ofi, coalesce(ti - lag(ti) OVER w, 0) / dt AS iv, coalesce(spread - lag(spread) OVER w, 0) / dt AS sv FROM m WINDOW w AS (ORDER BY rn), t AS (ORDER BY rn ROWS 19 PRECEDING), u AS (ORDER BY rn ROWS 9 PRECEDING)),
x AS (SELECT *, CASE WHEN rn >= 49 THEN stddev_samp(r) OVER (ORDER BY rn ROWS 49 PRECEDING) END AS rv FROM v)
SELECT event_id, round(mid, 6) AS mid_price, round(spread, 6) AS spread, round(spread / (mid + 1e-6), 6) AS relative_spread, round(micro, 6) AS microprice, round(ti, 6) AS top_imbalance, round(im, 6) AS depth_imbalance, round(0.7 * ti + 0.3 * im, 6) AS multi_level_imbalance, round(s, 6) AS signed_volume,
  round(buy / (sell + 1e-6), 3) AS buy_sell_ratio, round(ofi, 5) AS order_flow_imbalance, round(1 / dt, 6) AS order_arrival_rate, round(canc, 6) AS cancellation_rate, round(iv, 6) AS imbalance_velocity, round(sv, 6) AS spread_velocity, round(micro - mid, 6) AS microprice_velocity,
  round(coalesce(rv, first_value(rv IGNORE NULLS) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0005), 3) AS realized_vol_50 FROM x""")
def event_time_features(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen features of each event of the one order-book stream."""
    n = {"buy_sell_ratio": 3, "order_flow_imbalance": 5, "realized_vol_50": 3}
    return oi.event_features(ob.l2_events(ob.events(spark, d)), []).select("event_id", *[F.round(c, n.get(c, 6)).alias(c) for c in oi.MICRO])


@query("forward_seconds", """
SELECT event_id, {cols} FROM events {wins}""".format(
    cols=", ".join(f"count(*) OVER w{h} AS n_{h}, round(max(value) OVER w{h}, 6) AS max_{h}, round(min(value) OVER w{h}, 6) AS min_{h}" for h in (60, 300, 900, 1800)),
    wins="WINDOW " + ", ".join(f"w{h} AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 1 FOLLOWING AND {h}000000 FOLLOWING)" for h in (60, 300, 900, 1800))))
def forward_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Excursions strictly after each tick, up to 60 to 1800 seconds, in blocks of six hours with half an hour beyond."""
    from ..functions.blocks import forward_extremes

    out = forward_extremes(ob.events(spark, d), "event_type", "value", (60, 300, 900, 1800))
    return out.select("event_id", *[F.round(f"{a}_{h}", 6).alias(f"{a}_{h}") if a != "n" else f"n_{h}" for h in (60, 300, 900, 1800) for a in ("n", "max", "min")])


@query("horizon_returns", f"WITH {q.BARS} SELECT symbol, ts, round(ln(lead(close, 4) OVER ({q.W}) / nullif(close, 0)), 6) AS fwd_ret_4, round(ln(lead(close, 24) OVER ({q.W}) / nullif(close, 0)), 6) AS fwd_ret_24 FROM bars")
def horizon_returns(spark: SparkSession, d: str) -> DataFrame:
    return ol.horizon_return(ol.horizon_return(ob.bars(spark, d), 4), 24).select("symbol", T(), R("fwd_ret_4"), R("fwd_ret_24"))


@query("excursions_24", f"""
WITH {q.BARS}, x AS (SELECT *, {q.forward('max', 'high', 24)} AS hi, {q.forward('min', 'low', 24)} AS lo FROM bars), y AS (SELECT *, hi / nullif(close, 0) - 1 AS a, 1 - lo / nullif(close, 0) AS b, close / nullif(lo, 0) - 1 AS c FROM x)
SELECT symbol, ts, round(CASE WHEN a IS NOT NULL THEN greatest(a, 0) END, 6) AS mfe_long, round(CASE WHEN b IS NOT NULL THEN greatest(b, 0) END, 6) AS mae_long, round(CASE WHEN c IS NOT NULL THEN greatest(c, 0) END, 6) AS mfe_short, round(CASE WHEN a IS NOT NULL THEN greatest(a, 0) END, 6) AS mae_short FROM y""")
def excursions_24(spark: SparkSession, d: str) -> DataFrame:
    return ol.excursions(ob.bars(spark, d), 24).select("symbol", T(), *map(R, ("mfe_long", "mae_long", "mfe_short", "mae_short")))


def _barrier_sql(hi: str, lo: str, scaled: bool, multiple: float = 2.0) -> str:
    share = "0.7 + 0.6 * coalesce((rank() OVER (PARTITION BY symbol, v IS NULL ORDER BY v) + (count(*) OVER (PARTITION BY symbol, v) - 1) / 2.0) / count(v) OVER (PARTITION BY symbol), 0.5)"
    scale = f"CASE WHEN count(v) OVER (PARTITION BY symbol) > 50 THEN {share} ELSE 1.0 END" if scaled else "1.0"
    more = "" if scaled else f""", CASE WHEN k.rn + 24 <= k.total AND k.w > 0 THEN coalesce(h.rn - k.rn, 24) END AS holding_bars,
  CASE WHEN k.rn + 24 > k.total OR coalesce(k.w, 0) <= 0 THEN NULL WHEN h.rn IS NULL THEN 'timeout' WHEN h.{hi} >= k.close * (1 + k.w) AND h.{lo} <= k.close * (1 - k.w) THEN 'ambiguous_dual_crossing' WHEN h.{hi} >= k.close * (1 + k.w) THEN 'upper_barrier' ELSE 'lower_barrier' END AS exit_reason"""
    return f"""{q.BARS}, {_RET}, v AS (SELECT *, {q.rolling('stddev_samp', 'ret_1', 24)} AS v, row_number() OVER ({q.W}) AS rn, count(*) OVER (PARTITION BY symbol) AS total FROM r),
k AS (SELECT *, v * {multiple} * ({scale}) AS w FROM v),
j AS (SELECT a.symbol, a.rn, min(b.rn) AS hit FROM k a JOIN k b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn + 1 AND a.rn + 24 AND (b.{hi} >= a.close * (1 + a.w) OR b.{lo} <= a.close * (1 - a.w)) GROUP BY ALL),
tb AS (SELECT k.symbol, k.ts, k.close, CASE WHEN k.rn + 24 > k.total OR coalesce(k.w, 0) <= 0 THEN NULL WHEN h.rn IS NULL THEN 0 WHEN h.{hi} >= k.close * (1 + k.w) AND h.{lo} <= k.close * (1 - k.w) THEN NULL WHEN h.{hi} >= k.close * (1 + k.w) THEN 1 ELSE -1 END AS label,
  CASE WHEN k.rn + 24 <= k.total AND k.w > 0 THEN coalesce(h.ts, e.ts) END AS t1,
  round(CASE WHEN k.rn + 24 <= k.total AND k.w > 0 THEN ln(coalesce(h.close, e.close) / k.close) END, 6) AS ret{more}
FROM k LEFT JOIN j ON k.symbol = j.symbol AND k.rn = j.rn LEFT JOIN k h ON h.symbol = k.symbol AND h.rn = j.hit LEFT JOIN k e ON e.symbol = k.symbol AND e.rn = k.rn + 24)"""


def _labelled(spark: SparkSession, d: str, **how) -> DataFrame:
    return ol.triple_barrier(ob.bars(spark, d), **how)


@query("triple_barrier_close", f"WITH {_barrier_sql('close', 'close', True, 0.5)} SELECT symbol, ts, label, t1, ret FROM tb")
def triple_barrier_close(spark: SparkSession, d: str) -> DataFrame:
    """Half a volatility wide: these bars move by more than their price, and two volatilities are rarely reached."""
    return _labelled(spark, d, multiple=0.5).select("symbol", T(), F.col("label").cast("int").alias("label"), F.col("t1").cast("timestamp_ntz").alias("t1"), R("ret"))


@query("triple_barrier_intrabar", f"WITH {_barrier_sql('high', 'low', False)} SELECT symbol, ts, label, t1, ret, CAST(holding_bars AS INTEGER) AS holding_bars, exit_reason FROM tb")
def triple_barrier_intrabar(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d, intrabar=True).select("symbol", T(), F.col("label").cast("int").alias("label"), F.col("t1").cast("timestamp_ntz").alias("t1"), R("ret"), F.col("holding_bars").cast("int").alias("holding_bars"), "exit_reason")


@query("meta_labels", f"""
WITH {_barrier_sql('close', 'close', True, 0.5)}, s AS (SELECT *, close / nullif({q.rolling('avg', 'close', 20)}, 0) - 1 AS sma FROM tb)
SELECT symbol, ts, CASE WHEN sma > 0 THEN 1 ELSE -1 END AS primary_side, CAST(label = CASE WHEN sma > 0 THEN 1 ELSE -1 END AS INTEGER) AS meta_label, CAST(label = 1 AS INTEGER) AS binary_label FROM s WHERE label IS NOT NULL""")
def meta_labels(spark: SparkSession, d: str) -> DataFrame:
    b = _labelled(spark, d, multiple=0.5).withColumn("sma_ratio_20", F.try_divide(F.col("close"), fw.sma("close", 20)) - 1)
    return ol.meta_label(b).select("symbol", T(), "primary_side", "meta_label", "binary_label")


@query("hurdle_prevalence", f"""
WITH {q.BARS}, x AS (SELECT *, greatest({q.forward('max', 'high', 24)} / nullif(close, 0) - 1, 0) AS mfe, {q.forward('max', 'high', 24)} AS hi, ntile(3) OVER ({q.W}) AS part FROM bars)
SELECT CAST(part AS INTEGER) AS part, CAST(h AS INTEGER) AS hurdle_bps, count(*) AS n, round(avg(CAST(mfe > h / 10000.0 AS INTEGER)), 6) AS prevalence, round(avg(CAST(mfe > h / 10000.0 AS INTEGER)) / (1 - avg(CAST(mfe > h / 10000.0 AS INTEGER)) + 1e-6), 4) AS imbalance
FROM x, (VALUES (8), (10), (14), (20), (30), (50)) k(h) WHERE hi IS NOT NULL GROUP BY part, h""")
def hurdle_prevalence(spark: SparkSession, d: str) -> DataFrame:
    """How often moves exceed cost hurdles, in the early, middle and late third of each series."""
    b = ol.excursions(ob.bars(spark, d), 24).withColumn("part", F.ntile(3).over(fw.BARS.base()))
    share = F.avg("exceeds")
    return ol.hurdles(b).groupBy("part", "hurdle_bps").agg(F.count("*").alias("n"), F.round(share, 6).alias("prevalence"), F.round(share / (1 - share + 1e-6), 4).alias("imbalance"))


@query("three_class_label", f"""
WITH {q.BARS}, {_RET}, x AS (SELECT *, ln(lead(close, 24) OVER ({q.W}) / nullif(close, 0)) AS f, 0.5 * coalesce({q.rolling('stddev_samp', 'ret_1', 24)}, 0.005) AS e FROM r)
SELECT symbol, ts, CASE WHEN f IS NULL THEN NULL WHEN f > e THEN 1 WHEN f < -e THEN -1 ELSE 0 END AS class FROM x""")
def three_class_label(spark: SparkSession, d: str) -> DataFrame:
    return ol.three_class(ob.bars(spark, d)).select("symbol", T(), F.col("class").cast("int").alias("class"))


@query("take_profit_stop", f"""
WITH {q.BARS}, k AS (SELECT *, row_number() OVER ({q.W}) AS rn, count(*) OVER (PARTITION BY symbol) AS total FROM bars),
j AS (SELECT a.symbol, a.rn, min(b.rn) AS hit FROM k a JOIN k b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn + 1 AND a.rn + 12 AND (b.high >= a.close * 1.5 OR b.low <= a.close * (1 - 0.3)) GROUP BY ALL),
x AS (SELECT k.*, CASE WHEN k.rn + 12 > k.total THEN NULL WHEN h.rn IS NULL THEN 'TIME' WHEN h.high >= k.close * 1.5 THEN 'TP' ELSE 'SL' END AS why, e.close AS ec
  FROM k LEFT JOIN j ON k.symbol = j.symbol AND k.rn = j.rn LEFT JOIN k h ON h.symbol = k.symbol AND h.rn = j.hit LEFT JOIN k e ON e.symbol = k.symbol AND e.rn = k.rn + 12)
SELECT symbol, ts, why AS exit_reason, round(CASE why WHEN 'TP' THEN 0.5 WHEN 'SL' THEN -0.3 WHEN 'TIME' THEN ec / close - 1 END, 6) AS pnl FROM x""")
def take_profit_stop(spark: SparkSession, d: str) -> DataFrame:
    return ol.take_profit_stop(ob.bars(spark, d), 0.5, 0.3, 12).select("symbol", T(), "exit_reason", R("pnl"))


@query("data_audit", f"""
WITH {q.BARS}, g AS (SELECT *, epoch(ts) - lag(epoch(ts)) OVER ({q.W}) AS gap FROM bars)
SELECT symbol, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(CASE WHEN gap > 5400 THEN 1 ELSE 0 END) AS BIGINT) AS gaps, count(*) - count(DISTINCT ts) AS duplicates, CAST(0 AS BIGINT) AS availability_faults,
  CAST(floor((epoch(max(ts)) - epoch(min(ts))) / 3600) AS BIGINT) + 1 AS expected, round(count(*) / (floor((epoch(max(ts)) - epoch(min(ts))) / 3600) + 1), 6) AS coverage FROM g GROUP BY symbol""")
def data_audit(spark: SparkSession, d: str) -> DataFrame:
    out = ob.audit(ob.bars(spark, d))
    return out.select("symbol", "rows", "first_ts", "last_ts", F.col("gaps").cast("long"), "duplicates", F.col("availability_faults").cast("long"), "expected", R("coverage"))


@query("rising_runs", f"""
WITH {q.BARS}, o AS (SELECT *, close > lag(close) OVER ({q.W}) AS up FROM bars), m AS (SELECT *, CASE WHEN up AND NOT coalesce(lag(up) OVER ({q.W}), false) THEN 1 ELSE 0 END AS new FROM o),
n AS (SELECT *, sum(new) OVER ({q.W} ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT symbol, CAST(run AS BIGINT) AS run, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS bars FROM n WHERE up GROUP BY symbol, run""")
def rising_runs(spark: SparkSession, d: str) -> DataFrame:
    return ob.islands(ob.bars(spark, d).withColumn("_rise", F.col("close") > fw.lag("close")), F.col("_rise"))


@query("event_clusters", """
WITH n AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 300000000 THEN 0 ELSE 1 END AS new FROM events),
c AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM n)
SELECT event_type, CAST(cluster AS BIGINT) AS cluster, count(*) AS events, min(ts) AS start_ts, max(ts) AS end_ts, round(sum(value), 6) AS total FROM c GROUP BY event_type, cluster""")
def event_clusters(spark: SparkSession, d: str) -> DataFrame:
    return ob.clusters(ob.events(spark, d), 300).withColumn("total", F.round("total", 6))


@query("rolling_correlation", f"""
WITH {q.BARS}, {_RET} SELECT symbol, ts, round(CASE WHEN count(ret_1) {q.last(24)} >= 24 THEN corr(ret_1, volume) {q.last(24)} END, 5) AS corr_24,
  round((volume - CASE WHEN count(volume) OVER p >= 24 THEN avg(volume) OVER p END) / nullif(CASE WHEN count(volume) OVER p >= 24 THEN stddev_samp(volume) OVER p END, 0), 5) AS past_z
FROM r WINDOW p AS ({q.W} ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)""")
def rolling_correlation(spark: SparkSession, d: str) -> DataFrame:
    b = ob.bars(spark, d).withColumn("ret_1", fw.log_return("close"))
    c = F.when(F.count("ret_1").over(fw.BARS.last(24)) >= 24, F.corr("ret_1", "volume").over(fw.BARS.last(24)))
    return b.select("symbol", T(), F.round(c, 5).alias("corr_24"), F.round(fw.past_zscore("volume", 168, 24), 5).alias("past_z"))


@query("percent_rank_average", f"""
WITH {q.BARS} SELECT symbol, ts, round((rank() OVER (PARTITION BY symbol ORDER BY n) + (count(*) OVER (PARTITION BY symbol, n) - 1) / 2.0) / count(*) OVER (PARTITION BY symbol), 6) AS share FROM bars""")
def percent_rank_average(spark: SparkSession, d: str) -> DataFrame:
    return ob.bars(spark, d).select("symbol", T(), F.round(fw.percent_share("n"), 6).alias("share"))


@query("sequence_windows", f"""
WITH {q.BARS}, s AS (SELECT symbol, ts, list(close) {q.last(120)} AS seq, row_number() OVER ({q.W}) AS rn FROM bars)
SELECT symbol, ts, rn, round(list_sum(seq), 4) AS total, seq[1] AS first_close FROM s WHERE len(seq) = 120 AND rn % 4 = 0""")
def sequence_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sliding sequences of 120 bars, every fourth."""
    b = ob.bars(spark, d).withColumn("seq", F.collect_list("close").over(fw.BARS.last(120))).withColumn("rn", F.row_number().over(fw.BARS.base()).cast("long"))
    total = F.aggregate("seq", F.lit(0.0), lambda a, x: a + x)
    return b.where((F.size("seq") == 120) & (F.col("rn") % 4 == 0)).select("symbol", T(), "rn", F.round(total, 4).alias("total"), F.element_at("seq", 1).alias("first_close"))


@query("filled_series", f"""
WITH {q.BARS}, s AS (SELECT *, CASE WHEN n >= 2 THEN close END AS x FROM bars)
SELECT symbol, ts, last_value(x IGNORE NULLS) OVER ({q.W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ffilled, first_value(x IGNORE NULLS) OVER ({q.W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bfilled, CASE WHEN x IS NOT NULL THEN least(greatest(x, 50), 400) END AS clipped FROM s""")
def filled_series(spark: SparkSession, d: str) -> DataFrame:
    b = ob.bars(spark, d).withColumn("x", F.when(F.col("n") >= 2, F.col("close")))
    return b.select("symbol", T(), fw.forward_fill("x").alias("ffilled"), fw.backward_fill("x").alias("bfilled"), fw.clip("x", 50.0, 400.0).alias("clipped"))


@query("ewm_exact", f"WITH {q.BARS} SELECT symbol, ts, round({q.ewm('close', 2 / 201)}, 4) AS ema_200, round({q.ewm_adjusted('close', 2 / 51)}, 4) AS ema_50_adjusted FROM bars")
def ewm_exact(spark: SparkSession, d: str) -> DataFrame:
    """A long span, and one with bias correction."""
    b = fw.ewms(ob.bars(spark, d).select("symbol", "ts", "close"), [fw.Ewm("close", fw.span(200), "ema_200"), fw.Ewm("close", fw.span(50), "ema_50_adjusted", adjust=True)])
    return b.select("symbol", T(), F.round("ema_200", 4).alias("ema_200"), F.round("ema_50_adjusted", 4).alias("ema_50_adjusted"))


_DECAY = "list_reduce(l, lambda s, v: {'d': A * s.d + 1, 'e': A * A * s.e + 1, 'm': (A * s.d * s.m + v.m) / (A * s.d + 1), 'q': A * s.q + A * s.d / (A * s.d + 1) * (s.m - v.m) * (s.m - v.m)})".replace("A", f"{1 - 2 / 51!r}::DOUBLE")


@query("ewm_ticks", f"""
WITH x AS (SELECT event_id, event_type AS symbol, ts, value FROM events), o AS (PLACE)
SELECT event_id, round(level, 5) AS level, round(w.m, 5) AS mean, CASE WHEN n >= 2 THEN round(sqrt(w.q / w.d * w.d * w.d / (w.d * w.d - w.e)), 5) END AS deviation FROM (SELECT *, {_DECAY} AS w FROM o)""".replace("PLACE", """SELECT event_id, list_reduce(list(value) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), lambda s, v: s * 0.9::DOUBLE + v * 0.1::DOUBLE) AS level, count(*) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n,
  list({'d': 1::DOUBLE, 'e': 1::DOUBLE, 'm': value, 'q': 0::DOUBLE}) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS l FROM x"""))
def ewm_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Exponential level, and bias-corrected mean and deviation, of the raw ticks of each kind: a scan over blocks of rows."""
    specs = [fw.Ewm("value", 0.1, "level"), fw.Ewm("value", fw.span(50), "mean", adjust=True), fw.Ewm("value", fw.span(50), "deviation", adjust=True, deviation=True)]
    out = scans.ewm_scan(ob.events(spark, d).select("event_id", "event_type", "ts", "value"), specs, ["event_type"], "event_id")
    return out.select("event_id", *[F.round(c, 5).alias(c) for c in ("level", "mean", "deviation")])
