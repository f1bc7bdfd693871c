"""Streaming, models, evolution, sources and sinks as named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import udtf
from ..functions import windows as fw
from ..operators import arena
from ..operators import bars as ob
from ..operators import evolve as ev
from ..operators import genomes as ge
from ..operators import models as om
from ..operators.indicators import macro_cycle, market_state
from ..operators.labels import excursions
from ..operators.ledger import latest
from ..operators.quantiles import excursion_distribution as excursion_distribution_of
from ..sources import paged, scans, sinks
from ..sources.shared import shared_dir, written
from ..streaming import features, live
from . import market
from . import sql as q
from .analytics import R, S, scored, t
from .registry import ORACLE_SQL, query
from .trading import FORECAST, forecasts, signals


SLICES = 5


def _slices(rows: DataFrame) -> list[DataFrame]:
    """The rows in slices of time of about equal size, as a stream would bring them."""
    cuts = rows.agg(F.percentile_approx("ts", F.array(*[F.lit(k / SLICES) for k in range(1, SLICES)]))).first()[0] or []
    edges = [None, *cuts, None]
    between = lambda lo, hi: (F.lit(True) if lo is None else F.col("ts") > F.lit(lo)) & (F.lit(True) if hi is None else F.col("ts") <= F.lit(hi))
    return [rows.where(between(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _run(rows: DataFrame, build, schema: str = live.TICK) -> DataFrame:
    """What ``build(stream)`` writes while slices of ``rows`` arrive one by one, the query being started anew for each."""
    spark = rows.sparkSession
    return live.replay(_slices(rows), build, schema, shared_dir(spark))


NTZ = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
CLOSED = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)"


@query("streaming_bars", f"WITH {q.BARS} SELECT symbol, ts, open, high, low, close, round(volume, 6) AS volume, n FROM bars WHERE ts + INTERVAL 1 HOUR <= {CLOSED}")
def streaming_bars(spark: SparkSession, d: str) -> DataFrame:
    out = _run(_ticks(spark, d), live.live_bars)
    return out.select("symbol", NTZ("ts"), "open", "high", "low", "close", R("volume"), "n")


@query("streaming_sliding", f"WITH w AS (SELECT event_type, value, unnest([date_trunc('hour', ts) + k * INTERVAL 15 MINUTE for k in range(-3, 4)]) AS start, ts FROM events) SELECT start AS ts, event_type, count(*) AS n, round(sum(value), 6) AS total FROM w WHERE ts >= start AND ts < start + INTERVAL 1 HOUR AND start + INTERVAL 1 HOUR <= {CLOSED} GROUP BY ALL")
def streaming_sliding(spark: SparkSession, d: str) -> DataFrame:
    return _run(_ticks(spark, d), live.sliding).select(NTZ("ts"), "event_type", "n", R("total"))


@query("streaming_sessions", f"""
WITH n AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) < 300000000 THEN 0 ELSE 1 END AS new FROM events), c AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM n),
s AS (SELECT event_type, min(ts) AS start_ts, max(ts) + INTERVAL 5 MINUTE AS end_ts, count(*) AS events, round(sum(value), 6) AS total FROM c GROUP BY event_type, k) SELECT * FROM s WHERE end_ts <= {CLOSED}""")
def streaming_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _run(_ticks(spark, d), live.sessions).select("event_type", NTZ("start_ts"), NTZ("end_ts"), "events", R("total"))


@query("streaming_once", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) > 0 AS seen FROM events GROUP BY ALL")
def streaming_once(spark: SparkSession, d: str) -> DataFrame:
    out = _run(_ticks(spark, d), lambda s: live.once(s.withColumn("day", F.to_date("ts")), ["user_id", "day"], "40 days"))
    return out.select("user_id", "day", F.lit(True).alias("seen"))


@query("streaming_carry_forward", "WITH e AS (SELECT *, CASE WHEN value >= 20 THEN value END AS v FROM events) SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value, v IS NULL AS degraded FROM e")
def streaming_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    out = _run(_ticks(spark, d), lambda s: live.carry_forward(s.withColumn("value", F.when(F.col("value") >= 20, F.col("value")))))
    return out.select("event_id", "value", "degraded")


@query("streaming_cooldown", """
WITH RECURSIVE e AS (SELECT event_id, event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events WHERE value > 150), c AS (SELECT event_id, event_type, i, ts AS last, 1 AS k FROM e WHERE i = 1
  UNION ALL SELECT e.event_id, e.event_type, e.i, CASE WHEN e.ts - c.last >= INTERVAL 900 SECOND THEN e.ts ELSE c.last END, CASE WHEN e.ts - c.last >= INTERVAL 900 SECOND THEN 1 ELSE 0 END FROM c JOIN e ON e.event_type = c.event_type AND e.i = c.i + 1)
SELECT event_id FROM c WHERE k = 1""")
def streaming_cooldown(spark: SparkSession, d: str) -> DataFrame:
    return _run(_ticks(spark, d), lambda s: live.cooled(s.where("value > 150"))).select("event_id")


#: Stand-ins for the feeds beside the bars, each absent now and then.
CONTEXT = {
    "bid_depth": "n % 13 + 1.0", "ask_depth": "CASE WHEN n % 5 <> 0 THEN n % 11 + 1.0 END", "spread": "n / 4.0", "imbalance": "CASE WHEN n % 3 = 0 THEN n % 7 / 7.0 END", "funding_rate": "CASE WHEN n % 2 = 0 THEN n / 1e5 END",
    "open_interest": "CASE WHEN n % 4 <> 0 THEN 1000.0 + n END", "fear_greed": "CASE WHEN n % 6 <> 0 THEN n % 101 END", "sentiment_score": "CASE WHEN n % 2 = 1 THEN n % 9 / 9.0 END", "embed_dim0": "n % 5 / 5.0", "embed_dim1": "CAST(NULL AS DOUBLE)", "embed_dim2": "n % 8 / 8.0",
}


def _features_sql(size: int = 500) -> str:
    """Every window of bars folded anew, as the definitions say."""
    last = lambda k: f"OVER ({q.W} ROWS {k - 1} PRECEDING)"
    now, spans = "CASE WHEN close > 0 THEN close ELSE 1.0 END", (12, 20, 26, 50, 200)
    step = ", ".join(f"'e{k}': s.e{k} * {1 - 2 / (k + 1)!r} + v.e{k} * {2 / (k + 1)!r}" for k in spans)
    fold = f"list_reduce(cs, lambda s, v: {{{step}, 'sig': s.sig * 0.8 + 0.2 * (s.e12 * {1 - 2 / 13!r} + v.e12 * {2 / 13!r} - s.e26 * {1 - 2 / 27!r} - v.e26 * {2 / 27!r})}})"
    moves = {"g": 1 / 14, "l": 1 / 14, "t": 2 / 15, "p": 2 / 15, "m": 2 / 15}
    slide = "list_reduce(ds, lambda s, v: {" + ", ".join(f"'{k}': s.{k} * {1 - a!r} + v.{k} * {a!r}" for k, a in moves.items()) + "})"
    pack = "{" + ", ".join(f"'e{k}': close" for k in spans) + ", 'sig': 0.0}"
    ratio = lambda k: f"CASE WHEN e.e{k} > 0 THEN now / e.e{k} - 1 ELSE 0.0 END"
    columns = {
        "norm_open": "(open - now) / now", "norm_high": "(high - now) / now", "norm_low": "(low - now) / now", "norm_close_ret": "ln(now / CASE WHEN pc > 0 THEN pc ELSE now END)",
        "norm_volume": f"(volume - avg(volume) {last(20)}) / (stddev_pop(volume) {last(20)} + 1e-8)", "ema_20_ratio": ratio(20), "ema_50_ratio": ratio(50), "ema_200_ratio": ratio(200),
        "vwap_ratio": f"now / (sum((high + low + close) / 3 * volume) {last(size)} / sum(volume) {last(size)}) - 1", "roc_10": f"now / CASE WHEN rn > 10 THEN lag(close, 10) OVER ({q.W}) ELSE first(close) {last(size)} END - 1",
        "rsi_14": "CASE WHEN rn >= 15 THEN 1 - 2 / (1 + f.g / (f.l + 1e-8)) ELSE 0.0 END", "macd": "(e.e12 - e.e26) / now", "macd_signal": "CASE WHEN rn >= 9 THEN e.sig ELSE e.e12 - e.e26 END / now", "macd_hist": "CASE WHEN rn >= 9 THEN e.e12 - e.e26 - e.sig ELSE 0.0 END / now",
        "atr_14_ratio": "coalesce(f.t, high - low) / now", "bollinger_width": f"4 * (stddev_pop(close) {last(20)} + 1e-8) / avg(close) {last(20)}", "bollinger_pct_b": f"(now - avg(close) {last(20)} + 2 * (stddev_pop(close) {last(20)} + 1e-8)) / (4 * (stddev_pop(close) {last(20)} + 1e-8) + 1e-8)",
        "realized_vol_24": f"coalesce(stddev_pop(ln(close / pc)) {last(24)} * sqrt(24), 0.0)", "adx_14": "CASE WHEN rn >= 15 THEN abs(pdi - mdi) / (pdi + mdi + 1e-8) ELSE 0.25 END",
        "obv_norm": f"CASE WHEN rn > 20 THEN (obv - avg(obv) {last(20)}) / (stddev_pop(obv) {last(20)} + 1e-8) ELSE 0.0 END", "plus_minus_di_spread": "CASE WHEN rn >= 15 THEN (pdi - mdi) / (pdi + mdi + 1e-8) ELSE 0.0 END",
        "bid_ask_spread": "CASE WHEN spread > 1 THEN spread / now ELSE spread END", "order_book_imbalance": "(bid_depth - coalesce(ask_depth, 100)) / (bid_depth + coalesce(ask_depth, 100) + 1e-8)", "depth_liquidity_score": "ln(1 + bid_depth + coalesce(ask_depth, 100))",
        "microstructure_pressure": "coalesce(imbalance, (bid_depth - coalesce(ask_depth, 100)) / (bid_depth + coalesce(ask_depth, 100) + 1e-8))", "funding_rate": "coalesce(funding_rate, 0.0001)",
        "open_interest_delta": f"(coalesce(open_interest, 1000) - coalesce(lag(open_interest) OVER ({q.W}), open_interest, 1000)) / (coalesce(lag(open_interest) OVER ({q.W}), open_interest, 1000) + 1e-8)", "fear_greed_index": "(coalesce(fear_greed, 50) - 50) / 50",
        "sentiment_score": "coalesce(sentiment_score, 0.0)", "sentiment_embed_dim0": "embed_dim0", "sentiment_embed_dim1": "coalesce(embed_dim1, 0.0)", "sentiment_embed_dim2": "embed_dim2",
    }
    return f"""WITH {q.BARS}, d0 AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in CONTEXT.items())}, {now} AS now, row_number() OVER ({q.W}) AS rn, lag(close) OVER ({q.W}) AS pc, high - lag(high) OVER ({q.W}) AS up, lag(low) OVER ({q.W}) - low AS dn FROM bars),
d1 AS (SELECT *, greatest(close - pc, 0.0) AS g, greatest(pc - close, 0.0) AS l, greatest(high - low, abs(high - pc), abs(low - pc)) AS t, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS m,
  sum(coalesce(sign(close - pc), 0) * volume) OVER ({q.W} ROWS UNBOUNDED PRECEDING) AS obv FROM (SELECT *, coalesce(lag(close) OVER ({q.W}), close) AS _ FROM d0)),
d2 AS (SELECT *, list({pack}) {last(size)} AS cs, list({{'g': g, 'l': l, 't': t, 'p': p, 'm': m}}) FILTER (WHERE pc IS NOT NULL) {last(size - 1)} AS ds FROM d1),
d3 AS (SELECT *, {fold} AS e, CASE WHEN rn > 1 THEN {slide} END AS f FROM d2), d4 AS (SELECT *, 100 * f.p / (f.t + 1e-8) AS pdi, 100 * f.m / (f.t + 1e-8) AS mdi FROM d3)
SELECT symbol, ts, CAST(least({size}, rn) AS BIGINT) AS held, {", ".join(f"round({v}, 5) AS {k}" for k, v in columns.items())} FROM d4"""


@query("streaming_features", _features_sql())
def streaming_features(spark: SparkSession, d: str) -> DataFrame:
    """All live features of closed bars, in constant work a bar; feeds beside the bars are stand-ins."""
    bars = ob.bars(spark, d).select("symbol", "ts", "open", "high", "low", "close", "volume", *[F.expr(v).cast("double").alias(k) for k, v in CONTEXT.items()])
    schema = "symbol string, ts timestamp_ntz, " + ", ".join(f"{k} double" for k in (*features.PRICES, *CONTEXT))
    out = _run(bars, features.live_features, schema)
    return out.select("symbol", NTZ("ts"), "held", *[F.round(k, 5).alias(k) for k in features.NAMES])


@query("streaming_resolution", f"""
WITH w AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS w FROM events), m AS (SELECT f.event_id AS forecast_id, e.event_id FROM events f JOIN events e ON f.event_type = e.event_type AND e.ts > f.ts AND e.ts <= f.ts + INTERVAL 6 HOUR)
SELECT * FROM m UNION ALL SELECT event_id, NULL FROM events, w WHERE ts + INTERVAL 6 HOUR < w AND event_id NOT IN (SELECT forecast_id FROM m)""")
def streaming_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Every event is a forecast; outcomes are the events of its kind in the next six hours, or none by then."""

    def build(stream: DataFrame) -> DataFrame:
        f = stream.select(F.col("event_id").alias("forecast_id"), F.col("event_type").alias("forecast_symbol"), F.col("ts").alias("made_at"))
        return live.resolutions(f, stream.select("event_id", F.col("event_type").alias("symbol"), "ts"), 6)

    return _run(_ticks(spark, d), build)


def _frame(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d).withColumn("volume_z", fw.zscore("volume", 24)).withColumn("up", (fw.lead("close") > F.col("close")).cast("double")).withColumn("nxt", fw.lead("ret_1"))
    rows = s.select("symbol", "ts", "p", "vol", "volume_z", "ret_1", "up", "nxt").dropna()
    return om.assembled(rows, ["p", "vol", "volume_z", "ret_1"])


@query("model_ladder")
def model_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Logistic, forest and boosted models on the first 70 % of each series, scored on the rest."""
    from ..functions.metrics import auc

    k = _frame(spark, d).withColumn("share", F.percent_rank().over(Window.partitionBy("symbol").orderBy("ts")))
    train, test = om.standardised(k.where("share <= 0.7"), k.where("share > 0.7"))
    train, out = train.persist(), None
    for name, model in (("logistic", om.logistic(train, "up")), ("forest", om.forest(train, "up", 20)), ("boosted", om.boosted(train, "up", 5))):
        one = auc(om.probability(model, test).withColumn("y", F.col("up").cast("int")), "p", "y").select(F.lit(name).alias("model"), "positives", "negatives", R("auc", 3))
        out = one if out is None else out.unionByName(one)
    return out


@query("ridge_coefficients")
def ridge_coefficients(spark: SparkSession, d: str) -> DataFrame:
    (train,) = om.standardised(_frame(spark, d))
    model = om.ridge(train, "nxt", 1.0)
    rows = [(n, round(float(c), 6)) for n, c in zip(("p", "vol", "volume_z", "ret_1"), model.coefficients, strict=True)]
    return spark.createDataFrame(rows, "feature string, weight double")


@query("quantile_regression")
def quantile_regression(spark: SparkSession, d: str) -> DataFrame:
    return om.quantile_regression(_frame(spark, d).drop("features"), ["symbol"], ["vol", "volume_z"], "nxt", 0.9).select("symbol", R("b_vol", 4), R("b_volume_z", 4), R("b_0", 4))


@query("excursion_distribution")
def excursion_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Five quantiles of the next day's best move, fitted on the first 60 % of each series, for the last 20 %."""
    s = excursions(signals(spark, d).withColumn("volume_z", fw.zscore("volume", 24)), 24)
    s = written(s.withColumn("share", F.percent_rank().over(Window.partitionBy("symbol").orderBy("ts"))).select("symbol", "ts", "close", "p", "vol", "volume_z", "ret_1", "mfe_long", "share"))
    out = excursion_distribution_of(s.where("share <= 0.6"), s.where("share > 0.8"), ["p", "vol", "volume_z", "ret_1"], "mfe_long")
    names = ("exp_mfe", "p10_mfe", "p25_mfe", "p50_mfe", "p75_mfe", "p90_mfe", "interval_width", "uncertainty_score")
    return out.select("symbol", NTZ("ts"), R("close", 6), *[R(c, 4) for c in names], F.round("mfe_long", 6).alias("actual_mfe"))


@query("isotonic_calibration")
def isotonic_calibration(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).select("p", F.col("y").cast("double").alias("y"))
    out = om.isotonic(s, "p", "y").transform(s)
    return out.groupBy("p").agg(F.round(F.max("prediction"), 6).alias("calibrated"), F.count("*").alias("n"))


@query("kmeans_regimes")
def kmeans_regimes(spark: SparkSession, d: str) -> DataFrame:
    (rows,) = om.standardised(_frame(spark, d))
    return om.regimes(rows, 5).transform(rows).groupBy("prediction").agg(F.count("*").alias("n"), F.round(F.avg("vol"), 6).alias("mean_vol"))


@query("perturbation_attribution", f"""
WITH {S}, m AS (SELECT avg(p) AS mp, avg(x) AS mx FROM s)
SELECT l_orderkey, l_linenumber, round((0.6 * p + 0.01 * x) - (0.6 * mp + 0.01 * x), 3) AS effect_p, round((0.6 * p + 0.01 * x) - (0.6 * p + 0.01 * mx), 3) AS effect_x FROM s, m""")
def perturbation_attribution(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).select("l_orderkey", "l_linenumber", "p", "x")
    return om.perturbation(lambda c: 0.6 * c["p"] + 0.01 * c["x"], s, ["p", "x"]).select("l_orderkey", "l_linenumber", R("effect_p", 3), R("effect_x", 3))


OBJ = "c_custkey AS id, c_acctbal AS sharpe, CAST(c_custkey * 7919 % 101 AS DOUBLE) AS calmar, CAST(c_custkey * 104729 % 97 AS DOUBLE) AS win_rate, -CAST(c_custkey * 31 % 89 AS DOUBLE) AS max_drawdown, -CAST(c_custkey * 17 % 83 AS DOUBLE) AS thrift"
_ALL = " AND ".join(f"a.{c} >= b.{c}" for c in ev.OBJECTIVES)
_ANY = " OR ".join(f"a.{c} > b.{c}" for c in ev.OBJECTIVES)


@query("pareto_front", f"""
WITH RECURSIVE p AS (SELECT {OBJ} FROM customer), d AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON {_ALL} AND ({_ANY})), r(id, front) AS (SELECT id, 1 FROM p UNION SELECT d.b, r.front + 1 FROM r JOIN d ON d.a = r.id),
f AS (SELECT id, max(front) AS front FROM r GROUP BY id), x AS (SELECT * FROM p JOIN f USING (id)),
c AS (SELECT id, front, count(*) OVER (PARTITION BY front) <= 2 OR {' OR '.join(f"lead(id) OVER w_{c} IS NULL OR lag(id) OVER w_{c} IS NULL" for c in ev.OBJECTIVES)} AS is_end,
  {' + '.join(f"coalesce((lead({c}) OVER w_{c} - lag({c}) OVER w_{c}) / nullif(max({c}) OVER (PARTITION BY front) - min({c}) OVER (PARTITION BY front), 0), 0)" for c in ev.OBJECTIVES)} AS dist FROM x WINDOW {', '.join(f"w_{c} AS (PARTITION BY front ORDER BY {c}, id)" for c in ev.OBJECTIVES)})
SELECT id, CAST(front AS INTEGER) AS front, CASE WHEN is_end THEN NULL ELSE round(dist, 6) END AS crowding FROM c""")
def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    """Fronts and crowding of customers by five stand-in objectives."""
    k = F.col("c_custkey")
    mod = lambda a, m: F.pmod(k * a, F.lit(m)).cast("double")
    p = t(spark, d, "customer").select(k.alias("id"), F.col("c_acctbal").alias("sharpe"), mod(7919, 101).alias("calmar"), mod(104729, 97).alias("win_rate"), (-mod(31, 89)).alias("max_drawdown"), (-mod(17, 83)).alias("thrift"))
    return ev.crowding(ev.dominance_fronts(p)).select("id", "front", F.when(F.col("crowding") < float("inf"), F.round("crowding", 6)).alias("crowding"))


def strategy_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars with regime, price, ATR, volatility and a forecast's probability; prices lie 1000 higher than values, so that returns are those of a price."""
    s = market_state(market.states(spark, d))
    p = F.try_divide(F.col("close") - F.col("low"), F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))
    return s.select("symbol", "ts", "regime", (F.col("close") + 1000).alias("price"), F.col("atr_wilder").alias("atr"), F.coalesce(F.col("vol_24") / 100, F.lit(0.01)).alias("vol"), F.coalesce(p, F.lit(0.5)).alias("p"))


_GENES = {
    "id": "s_suppkey", "regime": f"element_at(array({', '.join(map(repr, ge.REGIMES))}), CAST(s_suppkey % 5 + 1 AS INT))", "take": "1 + s_suppkey * 7 % 41 / 10.0D", "stop": "0.5D + s_suppkey * 11 % 26 / 10.0D",
    "hold": "CAST(4 + s_suppkey * 13 % 93 AS INT)", "sizing": f"element_at(array({', '.join(map(repr, ge.SIZINGS))}), CAST(s_suppkey % 3 + 1 AS INT))",
}


def _fitness_sql() -> str:
    """Every bar with a position is tried as an entry; a walk over the entries finds those that close, then one back-test."""
    k, key = "id, symbol, fold", "PARTITION BY id, symbol, fold"
    w = f"OVER ({key} ORDER BY i)"
    return f"""
WITH RECURSIVE {market.STATES}, ms AS ({ORACLE_SQL["market_state"]}),
rows_ AS (SELECT st.symbol, st.ts, ms.regime, close + 1000 AS price, atr, coalesce(vol_24 / 100, 0.01) AS vol, coalesce((close - low) / nullif(high - low, 0), 0.5) AS p,
  row_number() OVER (PARTITION BY st.symbol ORDER BY st.ts) - 1 AS k, count(*) OVER (PARTITION BY st.symbol) // 6 AS c FROM st JOIN ms ON ms.symbol = st.symbol AND ms.ts = st.ts),
folds AS (SELECT *, CAST(least(k // c, 5) AS INTEGER) AS fold FROM rows_ WHERE c > 0 AND k >= c),
tape AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, fold, regime ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol, fold, regime) AS m, count(*) OVER (PARTITION BY symbol, fold) AS f FROM folds) WHERE m >= 20 AND f >= 20),
gen AS (SELECT s_suppkey AS id, [{", ".join(map(repr, ge.REGIMES))}][s_suppkey % 5 + 1] AS regime, 1 + s_suppkey * 7 % 41 / 10.0::DOUBLE AS take, 0.5::DOUBLE + s_suppkey * 11 % 26 / 10.0::DOUBLE AS stop, 4 + s_suppkey * 13 % 93 AS hold, s_suppkey % 3 AS sizing FROM supplier),
x0 AS (SELECT {k}, i, m, price, take, stop, hold, CASE WHEN atr > 0 THEN atr ELSE 0.001 * price END AS unit,
  CASE sizing WHEN 0 THEN CASE WHEN p > 0.55 THEN 1.0 WHEN p < 0.45 THEN -1.0 ELSE 0.0 END WHEN 1 THEN least(greatest(sign(p - 0.5) * (0.02 / greatest(vol, 1e-6)), -1), 1) ELSE least(greatest((p - 0.5) * 2, -1), 1) END::DOUBLE AS pos FROM tape JOIN gen USING (regime)),
x1 AS (SELECT *, CASE WHEN abs(pos) = 1 THEN pos ELSE 0 END AS u, CASE WHEN abs(abs(pos) - 1) < 0.01 THEN sign(pos) ELSE 0 END AS v FROM x0),
x2 AS (SELECT *, CASE WHEN u = lag(u) {w} THEN 0 ELSE 1 END AS nu, CASE WHEN v = lag(v) {w} THEN 0 ELSE 1 END AS nv FROM x1),
x3 AS (SELECT *, sum(nu) OVER ({key} ORDER BY i ROWS UNBOUNDED PRECEDING) AS bu, sum(nv) OVER ({key} ORDER BY i ROWS UNBOUNDED PRECEDING) AS bv FROM x2),
x4 AS (SELECT *, max(i) OVER (PARTITION BY {k}, bu) AS eu, max(i) OVER (PARTITION BY {k}, bv) AS ev FROM x3),
xs AS (SELECT *, CASE WHEN pos <> 0 AND lead(u) {w} = sign(pos) THEN lead(eu) {w} ELSE i END AS l FROM x4),
hit AS (SELECT {k}, a.i, min(b.i) AS j, arg_min(b.ev, b.i) AS z FROM xs a JOIN xs b USING ({k}) WHERE a.pos <> 0 AND b.i > a.i AND b.i <= a.l
  AND (b.i - a.i >= a.hold OR b.price >= a.price + a.unit * CASE WHEN a.pos > 0 THEN a.take ELSE a.stop END OR b.price <= a.price - a.unit * CASE WHEN a.pos > 0 THEN a.stop ELSE a.take END) GROUP BY ALL),
step AS (SELECT {k}, xs.i, j, z, CASE WHEN pos = 0 THEN xs.i + 1 WHEN j IS NOT NULL THEN z + 1 WHEN l = m - 1 THEN m ELSE xs.i + 1 END AS after FROM xs LEFT JOIN hit USING ({k}, i)),
walk AS (SELECT {k}, i, j, z, after FROM step WHERE i = 0 UNION ALL SELECT {k}, s.i, s.j, s.z, s.after FROM walk JOIN step s USING ({k}) WHERE s.i = walk.after),
gone AS (SELECT {k}, unnest(range(j, z + 1)) AS i FROM walk WHERE j IS NOT NULL),
y AS (SELECT xs.*, CASE WHEN gone.i IS NULL THEN pos ELSE 0 END AS q FROM xs LEFT JOIN gone USING ({k}, i)),
mv AS (SELECT *, coalesce(lag(q) {w}, 0) AS held, coalesce(price / lag(price) {w} - 1, 0) AS ret FROM y),
pn AS (SELECT *, abs(q - held) AS turn, held * ret - 0.001 * abs(q - held) AS pnl FROM mv), eq AS (SELECT *, exp(sum(ln(1 + pnl)) OVER ({key} ORDER BY i ROWS UNBOUNDED PRECEDING)) AS eq FROM pn),
dd AS (SELECT *, 1 - eq / max(eq) OVER ({key} ORDER BY i ROWS UNBOUNDED PRECEDING) AS dd FROM eq),
fr AS (SELECT {k}, CASE WHEN max(pnl) = min(pnl) THEN 0 ELSE round(avg(pnl) / stddev_samp(pnl) * sqrt(8760), 4) END AS sharpe, -round(max(dd), 6) AS deep, avg(turn) AS turn, arg_max(eq, i) - 1 AS total, sum(CAST(turn > 1e-5 AS INTEGER)) AS trades FROM dd GROUP BY {k}),
al AS (SELECT id, avg(sharpe) AS sharpe, avg(deep) AS deep, avg(turn) AS turn, avg(total) AS total, avg(CAST(sharpe > 0 AS INTEGER)) AS win, sum(trades) AS trades, count(*) AS folds FROM fr GROUP BY id)
SELECT gen.id, gen.regime, round(sharpe, 3) AS sharpe, round(CASE WHEN deep = 0 THEN 0 ELSE total / abs(deep) END, 4) AS calmar, round(win, 6) AS win_rate, round(deep, 6) AS max_drawdown, round(-turn, 6) AS thrift, CAST(coalesce(trades, 0) AS BIGINT) AS trades, coalesce(folds, 0) AS folds FROM gen LEFT JOIN al USING (id)"""


@query("genome_fitness", _fitness_sql())
def genome_fitness(spark: SparkSession, d: str) -> DataFrame:
    """One exit policy for each supplier, judged on its regime's bars in every test fold of every series."""
    genomes = t(spark, d, "supplier").select(*[F.expr(v).alias(k) for k, v in _GENES.items()])
    return ge.fitness(genomes, strategy_bars(spark, d)).join(genomes.select("id", "regime"), "id").select("id", "regime", R("sharpe", 3), R("calmar", 4), R("win_rate"), R("max_drawdown"), R("thrift"), "trades", "folds")


def _arena_sql() -> str:
    """Candle after candle: an open position is watched, or else one may open."""
    return f"""
WITH RECURSIVE {market.STATES}, sb AS (SELECT symbol, ts, high + 1000 AS high, low + 1000 AS low, close + 1000 AS close, atr, coalesce((close - low) / nullif(high - low, 0), 0.5) AS p, row_number() OVER ({q.W}) AS i FROM st),
w AS (SELECT symbol, CAST(0 AS BIGINT) AS i, CAST(10 AS DOUBLE) AS balance, CAST(10 AS DOUBLE) AS peak, CAST(0 AS DOUBLE) AS side, CAST(0 AS DOUBLE) AS entry, CAST(0 AS DOUBLE) AS take, CAST(0 AS DOUBLE) AS stop, CAST(0 AS DOUBLE) AS qty, CAST(0 AS DOUBLE) AS size, 0 AS bars,
  CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS VARCHAR) AS event, CAST(NULL AS VARCHAR) AS exit_reason, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS pnl FROM sb WHERE i = 1
  UNION ALL SELECT symbol, i, nbal, greatest(peak, nbal), CASE WHEN why IS NOT NULL THEN 0 WHEN opens THEN d ELSE side END, CASE WHEN opens THEN close ELSE entry END, CASE WHEN opens THEN nt ELSE take END, CASE WHEN opens THEN ns ELSE stop END,
    CASE WHEN opens THEN nsize / greatest(1.0, close) ELSE qty END, CASE WHEN opens THEN nsize ELSE size END, CASE WHEN opens THEN 0 ELSE nb END, ts, CASE WHEN why IS NOT NULL THEN 'TRADE_CLOSED' WHEN opens THEN 'POSITION_OPENED' END, why, CASE WHEN opens THEN close ELSE xp END, npnl
  FROM (SELECT *, CASE WHEN why IS NOT NULL THEN round(greatest(0.1, balance + npnl), 4) ELSE balance END AS nbal, least(0.02 * balance, 0.2) / greatest(0.005, d * (close - ns) / close) AS nsize
  FROM (SELECT *, CASE WHEN why IS NOT NULL THEN round(qty * side * (xp - entry) - size * 0.001, 4) END AS npnl, round(close + d * 2 * unit, 2) AS nt, round(close - d * 1.5 * unit, 2) AS ns
  FROM (SELECT *, CASE why WHEN 'TP_HIT' THEN take WHEN 'SL_HIT' THEN stop WHEN 'TIME_EXPIRED' THEN close END AS xp
  FROM (SELECT w.* EXCLUDE (i, ts), b.i, b.ts, b.high, b.low, b.close, CASE WHEN b.p > 0.54 THEN 1.0 ELSE -1.0 END AS d, CASE WHEN b.atr > 0 THEN b.atr ELSE b.close * 0.008 END AS unit, CASE WHEN side <> 0 THEN bars + 1 ELSE 0 END AS nb, side = 0 AND (b.p >= 0.55 OR b.p <= 0.45) AS opens,
    CASE WHEN side <> 0 THEN CASE WHEN (side > 0 AND b.high >= take) OR (side < 0 AND b.low <= take) THEN 'TP_HIT' WHEN (side > 0 AND b.low <= stop) OR (side < 0 AND b.high >= stop) THEN 'SL_HIT' WHEN bars + 1 >= 30 THEN 'TIME_EXPIRED' END END AS why
    FROM w JOIN sb b ON b.symbol = w.symbol AND b.i = w.i + 1)))))
SELECT symbol, ts, event, exit_reason, round(price, 4) AS price, round(pnl, 4) AS pnl, round(balance, 4) AS balance, round(least(0, (balance - peak) / peak), 6) AS drawdown, CAST(bars AS BIGINT) AS bars_held FROM w WHERE event IS NOT NULL"""


def _candles(spark: SparkSession, d: str) -> DataFrame:
    s = market.states(spark, d)
    p = F.coalesce(F.try_divide(F.col("close") - F.col("low"), F.nullif(F.col("high") - F.col("low"), F.lit(0.0))), F.lit(0.5))
    direction = F.when(p > 0.54, "LONG").when(p < 0.46, "SHORT").otherwise("SKIP")
    return s.select("symbol", "ts", *[(F.col(c) + 1000).alias(c) for c in ("high", "low", "close")], F.col("atr_wilder").alias("atr"), direction.alias("direction"), p.alias("probability"))


def _told(events: DataFrame) -> DataFrame:
    return events.select("symbol", NTZ("ts"), "event", "exit_reason", R("price", 4), R("pnl", 4), R("balance", 4), R("drawdown"), "bars_held")


@query("paper_arena", _arena_sql())
def paper_arena(spark: SparkSession, d: str) -> DataFrame:
    """Trades of each symbol's account, closed on the candle's high and low or after 30 bars."""
    return _told(arena.played(_candles(spark, d)))


@query("streaming_arena", _arena_sql())
def streaming_arena(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream of candles, the account being state."""
    return _told(_run(_candles(spark, d), arena.live, "symbol string, ts timestamp_ntz, high double, low double, close double, atr double, direction string, probability double"))


@query("evolution")
def evolution(spark: SparkSession, d: str) -> DataFrame:
    """Two generations of exit policies: fitness over folds and regimes, fronts, survivors, children."""
    bars = written(strategy_bars(spark, d))
    first = written(ge.seeded(spark, 40))
    judged = written(ge.fitness(first, bars))
    alive = ev.survivors(ev.dominance_fronts(judged), 20)
    children = written(ge.bred(first, first.join(alive.select("id"), "id", "left_semi"), 20))
    both = judged.unionByName(ge.fitness(children, bars))
    genes = first.unionByName(children)
    return ev.dominance_fronts(both).join(genes, "id").select("id", "generation", "regime", "front", R("sharpe", 4), R("calmar", 4), R("max_drawdown"), "trades", "folds")


@query("quarantine_states", "WITH t AS (SELECT l_suppkey AS genome_id, l_tax - 0.04 AS pnl FROM lineitem), a AS (SELECT genome_id, count(*) AS trades, avg(pnl) AS m, avg(CAST(pnl > 0 AS INTEGER)) AS w FROM t GROUP BY 1) SELECT genome_id, trades, CASE WHEN trades < 30 THEN 'WAITING' WHEN round(m, 9) > 0 AND w >= 0.5 THEN 'PROMOTED' ELSE 'DEMOTED' END AS state FROM a")
def quarantine_states(spark: SparkSession, d: str) -> DataFrame:
    return ev.quarantine(t(spark, d, "lineitem").select(F.col("l_suppkey").alias("genome_id"), (F.col("l_tax") - 0.04).alias("pnl"))).select("genome_id", "trades", "state")


@query("registry_lifecycle", """
WITH e AS (SELECT o_custkey AS model_id, o_orderkey AS pos, CASE o_orderpriority[1] WHEN '1' THEN 'REGISTER' WHEN '2' THEN 'CHALLENGE' WHEN '3' THEN 'PROMOTE' WHEN '4' THEN 'ROLLBACK' ELSE 'RETIRE' END AS event FROM orders),
l AS (SELECT model_id, list(event ORDER BY pos, event) AS log FROM e GROUP BY 1)
SELECT model_id, list_reduce(list_prepend('NONE', log), lambda s, x: CASE WHEN x = 'REGISTER' AND s = 'NONE' THEN 'CANDIDATE' WHEN x = 'CHALLENGE' AND s = 'CANDIDATE' THEN 'CHALLENGER' WHEN x = 'PROMOTE' AND s = 'CHALLENGER' THEN 'PRODUCTION' WHEN x = 'ROLLBACK' AND s = 'PRODUCTION' THEN 'CHALLENGER' WHEN x = 'RETIRE' AND s IN ('CANDIDATE', 'CHALLENGER', 'PRODUCTION') THEN 'RETIRED' ELSE s END) AS state FROM l""")
def registry_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Model states from an ordered log of transitions."""
    name = F.element_at(F.create_map(*[F.lit(x) for kv in {"1": "REGISTER", "2": "CHALLENGE", "3": "PROMOTE", "4": "ROLLBACK", "5": "RETIRE"}.items() for x in kv]), F.substring("o_orderpriority", 1, 1))
    return ev.lifecycle(t(spark, d, "orders").select(F.col("o_custkey").alias("model_id"), F.col("o_orderkey").alias("at"), name.alias("event")))


@query("paged_scan", """
WITH b AS (SELECT i * 3600 AS s FROM range(0, 3000) x(i)), p AS (SELECT s, 65000 * exp(0.02 * sin(s / 86400.0) + 0.005 * sin(s / 3700.0)) AS o, 65000 * exp(0.02 * sin((s + 3600) / 86400.0) + 0.005 * sin((s + 3600) / 3700.0)) AS c, 10.0 + s % 7 AS v FROM b)
SELECT CAST(DATE '1970-01-01' + CAST(s // 86400 AS INTEGER) AS DATE) AS day, count(*) AS rows, CAST(0 AS BIGINT) AS duplicates, round(max(greatest(o, c) * 1.001), 4) AS high, round(min(least(o, c) * 0.999), 4) AS low, round(sum(v), 4) AS volume FROM p GROUP BY 1""")
def paged_scan(spark: SparkSession, d: str) -> DataFrame:
    """Days of the bars that a paged source serves; pages overlap by a bar, which is dropped again."""
    spark.dataSource.register(scans.PagedSource)
    df = spark.read.format("paged").options(start=0, stop=3000 * 3600, step=3600, page=500).load()
    one = ob.keep_first(df, ["symbol", "ts"], [F.col("ts")])
    return one.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("rows"), (F.count("*") - F.count_distinct("ts")).alias("duplicates"), F.round(F.max("high"), 4).alias("high"), F.round(F.min("low"), 4).alias("low"), F.round(F.sum("volume"), 4).alias("volume"))


@query("sink_round_trip", f"WITH {q.BARS} SELECT symbol, count(*) AS rows, round(sum(close), 4) AS total FROM bars GROUP BY symbol")
def sink_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Bars written by symbol and day, appended again, read as the newest of each key."""
    path = shared_dir(spark)
    b = ob.bars(spark, d).drop("n")
    sinks.append_version(b.withColumn("close", F.lit(-1.0)), path)
    sinks.append_version(b, path)
    return sinks.read_latest(spark, path, ["symbol", "ts"]).groupBy("symbol").agg(F.count("*").alias("rows"), F.round(F.sum("close"), 4).alias("total"))


@query("path_table_function", f"""WITH {FORECAST}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM fo)
SELECT symbol, CAST(step AS INTEGER) AS step, round(close * (1 + CASE direction WHEN 'BULLISH' THEN mfe_p50 WHEN 'BEARISH' THEN -mae_p50 ELSE 0 END * (step / 6.0)), 6) AS projected, round(close * (1 + mfe_p90 * sqrt(step / 6.0)), 6) AS band_high, round(close * (1 - mae_p90 * sqrt(step / 6.0)), 6) AS band_low FROM l, range(1, 7) g(step) WHERE k = 1""")
def path_table_function(spark: SparkSession, d: str) -> DataFrame:
    """The same path as a table function in SQL."""
    udtf.register(spark)
    newest = ob.keep_first(forecasts(spark, d), ["symbol"], [F.desc("ts")])
    text = "SELECT symbol, p.* FROM {newest}, LATERAL forecast_path(close, mfe_p50, mae_p50, mfe_p90, mae_p90, direction, 6) p"
    return spark.sql(text, newest=newest).select("symbol", "step", R("projected"), R("band_high"), R("band_low"))


@query("depth_snapshots", """
WITH e AS (SELECT event_id, user_id, ts, value, event_id % 9 = 0 AS gone, event_id % 5 + 1 AS a, event_id % 7 + 1 AS b FROM events), s AS (SELECT *, CASE WHEN NOT gone THEN a + 2.5 END AS bd, CASE WHEN NOT gone THEN b + 1.5 END AS ad FROM e),
h AS (SELECT event_id, gone, last_value(bd IGNORE NULLS) OVER w AS bd, last_value(ad IGNORE NULLS) OVER w AS ad FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT event_id, round(bd, 6) AS bid_depth, round(ad, 6) AS ask_depth, CASE WHEN bd IS NOT NULL THEN 2.0 END AS spread, round((bd - ad) / (bd + ad + 1e-8), 6) AS imbalance, gone AS degraded FROM h""")
def depth_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Order-book answers of each user's venue as JSON; every ninth is empty."""
    level = lambda price, size: F.array(price.cast("string"), size.cast("string"))
    v, i = F.lit(100.0), F.col("event_id")
    book = F.to_json(F.struct(F.array(level(v - 1, i % 5 + 1), level(v - 2, F.lit(2.5))).alias("bids"), F.array(level(v + 1, i % 7 + 1), level(v + 2, F.lit(1.5))).alias("asks")))
    e = t(spark, d, "events").select("event_id", "user_id", "ts", F.when(i % 9 == 0, '{"bids": [], "asks": []}').otherwise(book).alias("text"))
    return scans.depth_snapshots(e, "text", "user_id", "ts").select("event_id", R("bid_depth"), R("ask_depth"), R("spread"), R("imbalance"), "degraded")


@query("kline_snapshots", """
WITH e AS (SELECT event_id, user_id, ts, value, event_id % 8 AS k FROM events), s AS (SELECT *, CASE WHEN k = 0 THEN NULL ELSE event_id * 60000 END AS ms, value * 2 + k AS o, CASE WHEN k = 0 THEN NULL ELSE value + 1 END AS c FROM e),
h AS (SELECT event_id, k, last_value(ms IGNORE NULLS) OVER w AS open_ms, last_value(CASE WHEN k > 0 THEN o END IGNORE NULLS) OVER w AS o, last_value(c IGNORE NULLS) OVER w AS c FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, open_ms, round(o, 4) AS open, round(c, 4) AS close, k = 0 AS degraded, CASE WHEN k % 2 = 1 THEN k / 10000.0 ELSE 0.0001 END AS funding_rate, CASE WHEN k % 3 = 1 THEN 1000.0 + k ELSE 0.0 END AS open_interest, CASE WHEN k > 4 THEN 10.0 * k ELSE 50.0 END AS fear_greed FROM h""")
def kline_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Candles, funding, open interest and fear-and-greed from JSON answers; some are empty, cut off or no JSON."""
    i, v = F.col("event_id"), F.col("value")
    k = i % 8
    row = lambda ms, o, c: F.array(*[x.cast("string") for x in (ms, o, o + 1, o - 1, c, v)])
    both = F.to_json(F.array(row(i * 60000, v * 2 + k, v + 1), row(i * 60000 + 60000, v, v)))
    one = F.to_json(F.array(row(i * 60000, v * 2 + k, v + 1)))
    text = F.when(k == 0, F.when(i % 16 == 0, "[]").otherwise("<html>")).when(k == 3, one).otherwise(both)
    e = t(spark, d, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), text.alias("text"), F.when(k % 2 == 1, F.concat(F.lit('{"lastFundingRate": "'), (k / 10000).cast("string"), F.lit('"}'))).otherwise("{}").alias("f"),
        F.when(k % 3 == 1, F.concat(F.lit('{"openInterest": "'), (1000 + k).cast("string"), F.lit('"}'))).otherwise("").alias("o"), F.when(k > 4, F.concat(F.lit('{"data": [{"value": "'), (k * 10).cast("string"), F.lit('"}]}'))).otherwise('{"data": []}').alias("g"))
    out = scans.macro_snapshots(scans.kline_snapshots(e, "text", "user_id", "at"), "f", "o", "g")
    return out.select("event_id", "open_ms", R("open", 4), R("close", 4), "degraded", "funding_rate", "open_interest", "fear_greed")


@query("macro_cycle_modes", """
WITH e AS (SELECT event_id, value / 100 AS r, (value - 100) / 30 AS z, value % 100 / 100 AS c, value / 600 AS u FROM events)
SELECT event_id, CASE WHEN r < 1.0 OR u < 0 THEN 'CAPITULATION' WHEN r >= 3.5 OR u >= 0.7 THEN 'EUPHORIA' WHEN r < 1.6 AND u < 0.25 THEN 'ACCUMULATION' ELSE 'NEUTRAL' END AS by_ratio,
  CASE WHEN z < 0.1 OR u < 0 THEN 'CAPITULATION' WHEN z >= 5.0 OR u >= 0.7 THEN 'EUPHORIA' WHEN z < 1.5 AND u < 0.25 THEN 'ACCUMULATION' ELSE 'NEUTRAL' END AS by_zscore,
  CASE WHEN c <= 0.05 OR u < 0 THEN 'CAPITULATION' WHEN c >= 0.95 OR u >= 0.7 THEN 'EUPHORIA' WHEN c <= 0.30 AND u < 0.25 THEN 'ACCUMULATION' ELSE 'NEUTRAL' END AS by_percentile FROM e""")
def macro_cycle_modes(spark: SparkSession, d: str) -> DataFrame:
    """The macro cycle by each kind of valuation: ratio, z-score, percentile of its past."""
    v = F.col("value")
    kinds = {"ratio": v / 100, "zscore": (v - 100) / 30, "percentile": v % 100 / 100}
    return t(spark, d, "events").select("event_id", *[macro_cycle(x, v / 600, k).alias(f"by_{k}") for k, x in kinds.items()])


@query("streaming_pages", "SELECT event_id, ts, event_type, value FROM events")
def streaming_pages(spark: SparkSession, d: str) -> DataFrame:
    """All events from a polled, paged source: polled once while half of them are there, then again from the checkpoint."""
    spark.dataSource.register(paged.PagedStream)
    middle = t(spark, d, "events").agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).first()[0]
    path, schema = shared_dir(spark), "event_id long, ts timestamp_ntz, event_type string, value double"
    for clock in (middle, None):
        stream = spark.readStream.format("paged_stream").options(path=f"{d}/events.parquet", page=500, slice=86_400, clock=clock or "").load()
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out")


@query("onchain_valuation", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN value * 200 END AS price, CASE WHEN event_id % 3 = 0 THEN value / 100 END AS m, CASE WHEN event_id % 3 = 0 THEN value / 600 END AS u FROM events),
x AS (SELECT event_id, m IS NOT NULL AS live, coalesce(m, CASE WHEN price IS NULL THEN 1.85 ELSE least(greatest((price / 42000 - 1) * 1.5 + 1.2, 0.6), 5.5) END) AS m, coalesce(u, CASE WHEN price IS NULL THEN 0.42 ELSE least(greatest((price / 42000 - 1) * 0.35 + 0.30, -0.2), 0.85) END) AS u FROM e)
SELECT event_id, round(m, 6) AS mvrv, round(u, 6) AS nupl, CASE WHEN live THEN 'live' ELSE 'calibrated_proxy' END AS source, CASE WHEN live THEN 1.0 ELSE 0.0 END AS influence_weight, CASE WHEN m < 1.0 OR u < 0 THEN 'CAPITULATION' WHEN m >= 3.5 OR u >= 0.7 THEN 'EUPHORIA' WHEN m < 1.6 AND u < 0.25 THEN 'ACCUMULATION' ELSE 'NEUTRAL' END AS cycle FROM x""")
def onchain_valuation(spark: SparkSession, d: str) -> DataFrame:
    """Valuation as given by a source, or a proxy; and the macro cycle."""
    i, v = F.col("event_id"), F.col("value")
    e = t(spark, d, "events").select("event_id", F.when(i % 10 != 0, v * 200).alias("price"), F.when(i % 3 == 0, v / 100).alias("mvrv"), F.when(i % 3 == 0, v / 600).alias("nupl"))
    out = scans.valuation(e, "price", "mvrv", "nupl").withColumn("cycle", macro_cycle(F.col("mvrv"), F.col("nupl")))
    return out.select("event_id", R("mvrv"), R("nupl"), "source", "influence_weight", "cycle")


@query("guarded_ledger", "WITH k AS (SELECT o_custkey AS id, o_orderkey AS seq, o_totalprice AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderpriority <> '5-LOW'), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM k) SELECT id, seq, v FROM n WHERE rn = 1")
def guarded_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Evidence before the boundary or of another version is refused; the newest of each key stays."""
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("ts"), F.when(F.col("o_orderpriority") == "5-LOW", "v0").otherwise("v1").alias("version"))
    return latest(sinks.guarded(o, "1996-01-01", "v1"), ["id"], [F.desc("seq")]).select("id", "seq", "v")
