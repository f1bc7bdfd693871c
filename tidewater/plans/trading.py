"""Validation, resampling, back-tests, risk, forecasts and sequential operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranks as fr
from ..functions import windows as fw
from ..operators import backtest as bt
from ..operators import bars as ob
from ..operators import forecast as fc
from ..operators import jumps
from ..operators import resampling as rs
from ..operators import sequential as sq
from ..operators import validation as ov
from . import sql as q
from .analytics import R, S, scored
from .registry import query

T = lambda: F.col("ts").cast("timestamp_ntz").alias("ts")
NTZ = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
RET = f"r AS (SELECT *, ln(close / nullif(lag(close) OVER ({q.W}), 0)) AS ret_1 FROM bars)"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return ob.bars(spark, d).select("symbol", "ts", F.col("ts").alias("t0"), F.expr("ts + make_interval(0, 0, 0, 0, CAST(1 + n % 6 AS INT))").alias("t1"))


L = f"{q.BARS}, l AS (SELECT symbol, ts AS t0, ts + INTERVAL (1 + n % 6) HOUR AS t1, row_number() OVER ({q.W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"


@query("purged_walk_forward", f"""
WITH {L}, e AS (SELECT symbol, greatest(24, ceil(quantile_cont(date_diff('second', t0, t1) / 3600.0, 0.95))) AS emb FROM l GROUP BY symbol), f AS (SELECT l.*, emb, fold, n // 6 AS c FROM l JOIN e USING (symbol), range(1, 6) g(fold)), s AS (SELECT *, min(CASE WHEN i = fold * c THEN t0 END) OVER (PARTITION BY symbol, fold) AS st FROM f),
k AS (SELECT symbol, fold, CASE WHEN i >= fold * c AND (i < (fold + 1) * c OR fold = 5) THEN 'test' WHEN i >= fold * c THEN 'unused' WHEN t1 >= st THEN 'purged' WHEN fold >= 3 AND i >= 2 * c AND i % c < emb THEN 'embargo' ELSE 'train' END AS role FROM s)
SELECT symbol, CAST(fold AS INTEGER) AS fold, role, count(*) AS n FROM k GROUP BY ALL""")
def purged_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    return ov.walk_forward(labelled(spark, d), ["symbol"], 5, 24, ["ts"]).groupBy("symbol", "fold", "role").agg(F.count("*").alias("n"))


@query("combinatorial_purged", f"""
WITH {L}, e AS (SELECT symbol, greatest(24, ceil(quantile_cont(date_diff('second', t0, t1) / 3600.0, 0.95))) AS emb FROM l GROUP BY symbol), g AS (SELECT g FROM range(0, 6) x(g)), c AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS split, a, b FROM range(0, 6) x(a), range(0, 6) y(b) WHERE a < b),
sp AS (SELECT DISTINCT l.symbol, g, g * n // 6 AS lo, (g + 1) * n // 6 AS hi, emb FROM l JOIN e USING (symbol), g), st AS (SELECT sp.*, l.t0 AS st FROM sp LEFT JOIN l ON l.symbol = sp.symbol AND l.i = sp.lo),
r AS (SELECT l.symbol, c.split, CASE WHEN bool_or(i >= lo AND i < hi) THEN 'test' WHEN bool_or(t0 < st AND t1 >= st) THEN 'purged' WHEN bool_or(i >= hi AND i < hi + emb) THEN 'embargo' ELSE 'train' END AS role FROM l, c JOIN st ON st.g IN (c.a, c.b) WHERE st.symbol = l.symbol GROUP BY l.symbol, c.split, l.i)
SELECT symbol, CAST(split AS INTEGER) AS split, role, count(*) AS n FROM r GROUP BY ALL""")
def combinatorial_purged(spark: SparkSession, d: str) -> DataFrame:
    return ov.combinatorial(labelled(spark, d), ["symbol"], 6, 2, ["ts"]).groupBy("symbol", "split", "role").agg(F.count("*").alias("n"))


@query("three_way_split", f"WITH {L} SELECT symbol, CASE WHEN i + 1 <= floor(n * 0.6) - 12 THEN 'train' WHEN i + 1 <= floor(n * 0.6) THEN 'embargo' WHEN i + 1 <= floor(n * 0.8) - 12 THEN 'validation' WHEN i + 1 <= floor(n * 0.8) THEN 'embargo' ELSE 'test' END AS role, count(*) AS n FROM l GROUP BY ALL")
def three_way_split(spark: SparkSession, d: str) -> DataFrame:
    return ov.three_way(labelled(spark, d), ["symbol"], (0.6, 0.2), 12, ["ts"]).groupBy("symbol", "role").agg(F.count("*").alias("n"))


HOUR = "h AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, avg(value) AS x FROM events GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i FROM h), b AS (SELECT i // 24 AS b, sum(x) AS s, count(*) AS n FROM k GROUP BY 1), t AS (SELECT count(*) AS t FROM b)"


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return ob.events(spark, d).groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("x"))


DRAWS = 10_000


@query("block_bootstrap", f"""
WITH {HOUR}, r AS (SELECT i, x / 1000 - 0.25 AS r FROM k), bb AS (SELECT i // 24 AS b, sum(r) AS s, sum(r * r) AS ss, sum(greatest(r, 0)) AS up, sum(greatest(-r, 0)) AS down, count(*) AS n FROM r GROUP BY 1),
dr AS (SELECT d AS draw, (d * 7919 + s * 104729 + d * s * 31) % t AS b FROM t, range(0, {DRAWS}) x(d), range(0, 10000) y(s) WHERE s < t),
m AS (SELECT draw, sum(s) / sum(n) AS m, sum(s) / sum(n) / (sqrt(greatest(sum(ss) / sum(n) - pow(sum(s) / sum(n), 2), 0)) + 1e-8) * sqrt(8766) AS sr, sum(up) / greatest(1e-6, sum(down)) AS pf FROM dr JOIN bb USING (b) GROUP BY draw)
SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS mean_low, round(quantile_cont(m, 0.975), 6) AS mean_high, round(quantile_cont(sr, 0.025), 4) AS sharpe_low, round(quantile_cont(sr, 0.975), 4) AS sharpe_high, round(quantile_cont(pf, 0.025), 5) AS factor_low, round(quantile_cont(pf, 0.975), 5) AS factor_high FROM m""")
def block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of mean, Sharpe ratio and profit factor of hourly returns (x / 1000 - 0.25 stands in for them)."""
    rows = hourly(spark, d).withColumn("r", F.col("x") / 1000 - 0.25)
    m = ov.block_bootstrap(rows, "r", ["ts"], 24, DRAWS)
    p = lambda c, q_, n: F.round(F.percentile(c, F.lit(q_)), n)
    return m.agg(
        F.round(F.avg("mean"), 6).alias("mean"), p("mean", 0.025, 6).alias("mean_low"), p("mean", 0.975, 6).alias("mean_high"), p("sharpe", 0.025, 4).alias("sharpe_low"), p("sharpe", 0.975, 4).alias("sharpe_high"),
        p("profit_factor", 0.025, 5).alias("factor_low"), p("profit_factor", 0.975, 5).alias("factor_high"),
    )


@query("bootstrap_drawdown", f"""
WITH {HOUR}, r AS (SELECT i, x / 1000 - 0.25 AS r FROM k), e AS (SELECT i // 24 AS b, i, r, sum(ln(1 + r)) OVER (PARTITION BY i // 24 ORDER BY i) AS e FROM r), g AS (SELECT *, max(e) OVER (PARTITION BY b ORDER BY i) AS top FROM e),
bb AS (SELECT b, arg_max(e, i) AS total, max(e) AS peak, min(e) AS low, max(top - e) AS deep, sum(r) AS s, count(*) AS n, coalesce(sum(r) FILTER (WHERE r < 0), 0) AS sd, coalesce(sum(r * r) FILTER (WHERE r < 0), 0) AS ssd, count(*) FILTER (WHERE r < 0) AS nd FROM g GROUP BY b),
dr AS (SELECT d AS draw, s AS slot, (d * 7919 + s * 104729 + d * s * 31) % t AS b FROM t, range(0, {DRAWS}) x(d), range(0, 10000) y(s) WHERE s < t),
lo AS (SELECT draw, list({{'e': total, 'top': peak, 'dd': deep, 'low': low}} ORDER BY slot) AS l, sum(s) / sum(n) AS m, CASE WHEN sum(nd) > 0 THEN sqrt(greatest(sum(ssd) / sum(nd) - pow(sum(sd) / sum(nd), 2), 0)) + 1e-8 ELSE 1e-6 END AS down FROM dr JOIN bb USING (b) GROUP BY draw),
m AS (SELECT m / down * sqrt(8766) AS so, 1 - exp(-list_reduce(l, lambda a, x: {{'e': a.e + x.e, 'top': greatest(a.top, a.e + x.top), 'dd': greatest(a.dd, x.dd, a.top - a.e - x.low), 'low': x.low}}).dd) AS mdd FROM lo)
SELECT round(avg(mdd), 6) AS mean, round(quantile_cont(mdd, 0.025), 6) AS low, round(quantile_cont(mdd, 0.975), 6) AS high, round(avg(so), 4) AS sortino_mean, round(quantile_cont(so, 0.025), 4) AS sortino_low, round(quantile_cont(so, 0.975), 4) AS sortino_high FROM m""")
def bootstrap_drawdown(spark: SparkSession, d: str) -> DataFrame:
    """Deepest drawdown and Sortino ratio of 10,000 resamples: blocks are reduced to a few numbers, which chain in the drawn order."""
    m = rs.bootstrap(hourly(spark, d).withColumn("r", F.col("x") / 1000 - 0.25), "r", ["ts"], 24, DRAWS)
    deep = rs.interval(m, ["max_drawdown"]).toDF("mean", "low", "high")
    return deep.crossJoin(F.broadcast(rs.interval(m, ["sortino"], 4)))  # one row


@query("paired_bootstrap", f"""
WITH {HOUR}, f AS (SELECT ts, abs(x - lag(x, 1) OVER (ORDER BY ts)) - abs(x - lag(x, 24) OVER (ORDER BY ts)) AS diff FROM k), z AS (SELECT diff, row_number() OVER (ORDER BY ts) - 1 AS i FROM f WHERE diff IS NOT NULL),
bb AS (SELECT i // 24 AS b, sum(diff) AS s, count(*) AS n FROM z GROUP BY 1), tt AS (SELECT count(*) AS t FROM bb), dr AS (SELECT d AS draw, (d * 7919 + s * 104729 + d * s * 31) % t AS b FROM tt, range(0, {DRAWS}) x(d), range(0, 10000) y(s) WHERE s < t),
m AS (SELECT draw, sum(s) / sum(n) AS m FROM dr JOIN bb USING (b) GROUP BY draw)
SELECT round(avg(m), 6) AS mean_mean, round(quantile_cont(m, 0.025), 6) AS mean_low, round(quantile_cont(m, 0.975), 6) AS mean_high, round(avg(CAST(m < 0 AS INTEGER)), 6) AS better FROM m""")
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Paired difference of two forecasts' errors (the hour before against the day before): interval over resampled days."""
    w = Window.orderBy("ts")  # one ordered series of hours
    diff = hourly(spark, d).withColumn("diff", F.abs(F.col("x") - F.lag("x", 1).over(w)) - F.abs(F.col("x") - F.lag("x", 24).over(w))).where("diff is not null")
    m = rs.paired(diff, "diff", ["ts"], 24, DRAWS)
    return rs.interval(m, ["mean"]).crossJoin(F.broadcast(m.agg(F.round(F.avg((F.col("mean") < 0).cast("int")), 6).alias("better"))))  # one row


@query("sign_flip_test", f"""
WITH {HOUR}, d AS (SELECT b, s / n - (SELECT sum(s) / sum(n) FROM b) + 1 AS diff FROM b), m AS (SELECT x.d, avg(CASE WHEN (x.d * 7919 + b * 104729 + x.d * b * 31) % 2 = 0 THEN diff ELSE -diff END) AS m FROM d, range(0, {DRAWS}) x(d) GROUP BY x.d), o AS (SELECT avg(diff) AS o FROM d)
SELECT round(max(o), 6) AS observed, round((sum(CAST(abs(m) >= abs(o) AS INTEGER)) + 1.0) / (count(*) + 1), 6) AS p_value FROM m, o""")
def sign_flip_test(spark: SparkSession, d: str) -> DataFrame:
    k = hourly(spark, d).withColumn("i", F.row_number().over(Window.orderBy("ts")) - 1)  # one ordered series of hours
    b = k.groupBy(F.floor(F.col("i") / 24).alias("b")).agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    mean = b.agg((F.sum("s") / F.sum("n")).alias("m"))
    diff = b.crossJoin(F.broadcast(mean)).select("b", (F.col("s") / F.col("n") - F.col("m") + 1).alias("diff"))
    return ov.sign_flip(diff, "diff", DRAWS).select(R("observed"), R("p_value"))


@query("family_wise", f"""
WITH {S}, p AS (SELECT horizon || regime AS name, exp(-abs(avg(r)) * sqrt(count(*)) / stddev_samp(r)) AS p FROM s GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY p, name) AS i, count(*) OVER () AS m FROM p)
SELECT name, round(p, 6) AS p, round(least(1, max(p * (m - i + 1)) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING)), 6) AS holm, round(least(1, min(p * m / i) OVER (ORDER BY p, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bh FROM k""")
def family_wise(spark: SparkSession, d: str) -> DataFrame:
    p = F.exp(-F.abs(F.avg("r")) * F.sqrt(F.count("*").cast("double")) / F.stddev_samp("r"))
    tests = scored(spark, d).groupBy(F.concat("horizon", "regime").alias("name")).agg(p.alias("p"))
    return ov.adjusted(tests).select("name", R("p"), R("holm"), R("bh"))


@query("effective_sample", f"WITH {HOUR}, a AS (SELECT x, lag(x) OVER (ORDER BY ts) AS y FROM k) SELECT count(*) AS n, round(corr(x, y), 6) AS rho, round(count(*) * (1 - corr(x, y)) / (1 + corr(x, y)), 4) AS n_eff FROM a")
def effective_sample(spark: SparkSession, d: str) -> DataFrame:
    a = hourly(spark, d).withColumn("y", F.lag("x").over(Window.orderBy("ts")))  # one ordered series of hours
    rho = F.corr("x", "y")
    return a.agg(F.count("*").alias("n"), F.round(rho, 6).alias("rho"), F.round(F.count("*") * (1 - rho) / (1 + rho), 4).alias("n_eff"))


@query("effective_samples", f"""
WITH {HOUR}, m AS (SELECT ts, x - avg(x) OVER () AS d FROM k), a AS (SELECT d, lag(d) OVER (ORDER BY ts) AS e FROM m), c AS (SELECT count(*) AS n, greatest(-0.99, least(0.99, sum(d * e) / sum(d * d))) AS rho, corr(d, e) AS pair FROM a)
SELECT n, round(rho, 6) AS rho_1, CAST(greatest(2, trunc(n * (1 - rho) / (1 + rho))) AS BIGINT) AS by_autocorrelation, CAST(greatest(2, n // 24) AS BIGINT) AS by_blocks, CAST(greatest(10, least(n, trunc(n * ((1 - pair) / (1 + pair + 1e-6))))) AS BIGINT) AS by_events,
  CAST(greatest(2, trunc(n * (1 - rho) / (1 + rho))) - 1 AS BIGINT) AS degrees_of_freedom FROM c""")
def effective_samples(spark: SparkSession, d: str) -> DataFrame:
    """Three effective sample sizes of the hourly series: by lag-1 autocorrelation, by whole days, and as for events."""
    return ov.effective_samples(hourly(spark, d), "x", ["ts"], 24).withColumn("rho_1", R("rho_1"))


@query("independent_blocks", f"WITH {HOUR} SELECT i // 24 AS block, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, round(avg(x), 9) AS mean FROM k GROUP BY 1 HAVING count(*) = 24")
def independent_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 24 hours that don't overlap; a last one that isn't whole goes."""
    return ov.independent_blocks(hourly(spark, d), "x", ["ts"], 24).select("block", NTZ("first_ts"), NTZ("last_ts"), "n", F.round("mean", 9).alias("mean"))


P = f"{q.BARS}, {RET}, v AS (SELECT *, {q.rolling('stddev_samp', 'ret_1', 24)} AS vol, (close - low) / nullif(high - low, 0) AS p FROM r)"


def signals(spark: SparkSession, d: str) -> DataFrame:
    b = ob.bars(spark, d).withColumn("ret_1", fw.log_return("close")).withColumn("vol", fw.rolling_std("ret_1", 24))
    return b.withColumn("p", F.try_divide(F.col("close") - F.col("low"), F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))).withColumn("r", F.try_divide(F.col("ret_1"), F.lit(100.0)))


@query("backtest_cost_grid", f"""
WITH {P}, z AS (SELECT symbol, ts, ret_1 / 100 AS r, CASE WHEN p > 0.54 THEN 1.0 WHEN p < 0.46 THEN -1.0 ELSE 0.0 END AS pos FROM v), g AS (SELECT z.*, CAST(c AS DOUBLE) AS cost, coalesce(lag(pos) OVER (PARTITION BY symbol, c ORDER BY ts), 0) AS held FROM z, (VALUES (0.0), (0.0005), (0.001)) k(c)),
n AS (SELECT *, abs(coalesce(pos, 0) - held) AS turnover, held * coalesce(r, 0) - cost * abs(coalesce(pos, 0) - held) AS pnl FROM g), e AS (SELECT *, exp(sum(ln(1 + greatest(pnl, -0.999999))) OVER w) AS eq FROM n WINDOW w AS (PARTITION BY symbol, cost ORDER BY ts ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, 1 - eq / greatest(max(eq) OVER (PARTITION BY symbol, cost ORDER BY ts ROWS UNBOUNDED PRECEDING), 1) AS dd FROM e)
SELECT symbol, cost, count(*) AS bars, round(sum(pnl), 5) AS total, round(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(8760), 4) AS sharpe, round(max(dd), 5) AS max_drawdown, round(sum(turnover), 4) AS turnover, CAST(sum(CAST(turnover > 0 AS INTEGER)) AS BIGINT) AS trades FROM d GROUP BY symbol, cost""")
def backtest_cost_grid(spark: SparkSession, d: str) -> DataFrame:
    """One vectorised back-test over a grid of three costs."""
    s = signals(spark, d)
    s = s.withColumn("pos", bt.positions(s, "fixed"))
    grid = spark.createDataFrame([(c,) for c in (0.0, 0.0005, 0.001)], "cost double")
    sim = bt.simulate(s.crossJoin(F.broadcast(grid)), "pos", "r", F.col("cost"), fw.Key(("symbol", "cost"), ("ts",)))
    return bt.summary(sim, ["symbol", "cost"]).select("symbol", "cost", "bars", R("total", 5), R("sharpe", 4), R("max_drawdown", 5), R("turnover", 4), "trades")


@query("sizing_schemes", f"""
WITH {P} SELECT symbol, ts, CASE WHEN p > 0.54 THEN 1.0 WHEN p < 0.46 THEN -1.0 ELSE 0.0 END AS fixed, round(CASE WHEN p > 0.54 THEN 1.0 WHEN p < 0.46 THEN -1.0 ELSE 0.0 END * CASE WHEN vol > 0 THEN least(greatest(0.02 / vol, 0), 2) END, 6) AS vol_target,
  round(CASE WHEN p IS NOT NULL THEN least(greatest(2 * (p - 0.5), -1), 1) END, 6) AS prob_scaled, CASE WHEN abs(p - 0.5) * vol > 0.001 THEN CASE WHEN p > 0.54 THEN 1.0 WHEN p < 0.46 THEN -1.0 ELSE 0.0 END ELSE 0.0 END AS cost_aware FROM v""")
def sizing_schemes(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d)
    return s.select("symbol", T(), *[F.round(bt.positions(s, k), 6).alias(k) for k in ("fixed", "vol_target", "prob_scaled", "cost_aware")])


@query("risk_envelope", f"""
WITH {q.BARS}, m AS (SELECT symbol, ts, close, {q.forward('max', 'high', 24)} / nullif(close, 0) - 1 AS mfe FROM bars), e AS (SELECT symbol, count(mfe) AS n, quantile_cont(mfe, 0.5) AS p50, quantile_cont(mfe, 0.9) AS p90, quantile_cont(mfe, 0.1) AS p10, avg(mfe) AS mean, arg_max(close, ts) AS price FROM m GROUP BY symbol)
SELECT symbol, n, round(p50, 5) AS upside_median, round(1.32 * p50, 5) AS downside_median, round(p90, 5) AS upside_tail, round(1.9 * p90, 5) AS downside_tail, round(p90 + 1.9 * p90, 5) AS range_width, round((p90 - p10) / (mean + 1e-6), 5) AS uncertainty,
  round(price * (1 + p90), 4) AS upper_level, round(price * (1 - 1.9 * p90), 4) AS lower_level, CASE WHEN 1.9 * p90 > p90 THEN 'SKEWED_ADVERSE' ELSE 'SYMMETRIC' END AS symmetry, CASE WHEN p50 - 1.32 * p50 > 0.0014 THEN 'TRADE' ELSE 'ABSTAIN' END AS decision FROM e""")
def risk_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Median and tail excursions of each symbol as a price envelope around its last close, with the decision they name."""
    b = ob.bars(spark, d).withColumn("mfe", F.try_divide(fw.forward(F.max, "high", 24), F.nullif(F.col("close"), F.lit(0.0))) - 1)
    quantiles = fr.exact_quantiles(b, ["symbol"], "mfe", {"p50": 0.5, "p90": 0.9, "p10": 0.1})
    rest = b.groupBy("symbol").agg(F.count("mfe").alias("n"), F.avg("mfe").alias("mean"), F.max_by("close", "ts").alias("price"))
    return fc.risk_envelope(quantiles.join(rest, "symbol")).select("symbol", "n", *[F.round(c, 5).alias(c) for c in ("upside_median", "downside_median", "upside_tail", "downside_tail", "range_width", "uncertainty")], R("upper_level", 4), R("lower_level", 4), "symmetry", "decision")


@query("reference_sizing", f"WITH {q.BARS}, e AS (SELECT symbol, ts, (high - open) / nullif(open, 0) AS mfe, (open - low) / nullif(open, 0) AS mae FROM bars) SELECT symbol, ts, round(CASE WHEN mfe / (mae + 0.0016 + 1e-6) IS NOT NULL THEN least(1, greatest(0, mfe / (mae + 0.0016 + 1e-6) - 0.5)) END, 6) AS size FROM e")
def reference_sizing(spark: SparkSession, d: str) -> DataFrame:
    """Size from the favourable against the adverse excursion of a bar and the cost."""
    o = F.nullif(F.col("open"), F.lit(0.0))
    b = ob.bars(spark, d).withColumn("mfe", F.try_divide(F.col("high") - F.col("open"), o)).withColumn("mae", F.try_divide(F.col("open") - F.col("low"), o))
    return b.select("symbol", T(), F.round(bt.reference_size(F.col("mfe"), F.col("mae")), 6).alias("size"))


@query("risk_panel", f"""
WITH {P}, x AS (SELECT symbol, ts, ret_1 / 100 AS r FROM v WHERE ret_1 IS NOT NULL), e AS (SELECT *, exp(sum(ln(1 + greatest(r, -0.999999))) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS eq, row_number() OVER (PARTITION BY symbol ORDER BY r, ts) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM x),
g AS (SELECT *, 1 - eq / greatest(max(eq) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 1) AS dd, floor((1 - CAST(0.95 AS DOUBLE)) * n) AS kk FROM e)
SELECT symbol, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(8760), 4) AS sharpe, round(avg(r) / nullif(sqrt(avg(pow(least(r, 0), 2))), 0) * sqrt(8760), 4) AS sortino, round(max(dd), 6) AS max_drawdown, round(avg(r) * 8760 / nullif(max(dd), 0), 4) AS calmar,
  round(-max(CASE WHEN k = kk + 1 THEN r END), 6) AS var_95, round(-avg(CASE WHEN k <= greatest(1, kk) THEN r END), 6) AS cvar_95, round(sum(CASE WHEN r > 0 THEN r ELSE 0 END) / nullif(-sum(CASE WHEN r < 0 THEN r ELSE 0 END), 0), 6) AS profit_factor, round(avg(CAST(r > 0 AS INTEGER)), 6) AS win_rate FROM g GROUP BY symbol""")
def risk_panel(spark: SparkSession, d: str) -> DataFrame:
    out = bt.risk_metrics(signals(spark, d).where("r is not null"), "r", ["symbol"], ["ts"])
    return out.select("symbol", R("sharpe", 4), R("sortino", 4), R("max_drawdown"), R("calmar", 4), R("var_95"), R("cvar_95"), R("profit_factor"), R("win_rate"))


@query("execution_and_kelly", f"""
WITH {S}, c AS (SELECT *, 0.03 AS win, abs(r) AS loss, CASE regime WHEN 'O' THEN 'RANGING' ELSE 'BREAKOUT' END AS rg FROM s), k AS (SELECT *, CASE WHEN loss <= 0 THEN 0.0 ELSE least(greatest((p * (win / loss) - (1 - p)) / (win / loss), -1), 1) END AS kelly FROM c)
SELECT l_orderkey, l_linenumber, round((greatest(0.0001, 0.0005 / 2) + 0.0002 * sqrt(greatest(1, x * 10000 / 100000))) * (1 + greatest(0, (p - 0.5) * 2)), 6) AS cost, round(kelly, 6) AS kelly, round(greatest(0.01, least(abs(kelly * 0.25), CASE rg WHEN 'RANGING' THEN 0.08 ELSE 0.15 END, 0.20)), 6) AS share,
  round(greatest(0, price + CASE WHEN r > 0 THEN 1 ELSE -1 END * 2.0 * x), 4) AS take, round(greatest(0, price - CASE WHEN r > 0 THEN 1 ELSE -1 END * 1.5 * x), 4) AS stop FROM k""")
def execution_and_kelly(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).withColumn("rg", F.when(F.col("regime") == "O", "RANGING").otherwise("BREAKOUT"))
    cost = bt.execution_cost(F.col("x") * 10_000, F.lit(0.0005), F.col("p"))
    s = s.withColumn("kelly", bt.kelly(F.col("p"), F.lit(0.03), F.abs("r")))
    take, stop = bt.dynamic_levels(F.col("price"), F.col("r") > 0, F.col("x"), F.col("rg"))
    return s.select("l_orderkey", "l_linenumber", F.round(cost, 6).alias("cost"), F.round("kelly", 6).alias("kelly"), F.round(bt.position_share(F.col("kelly"), F.col("rg")), 6).alias("share"), F.round(take, 4).alias("take"), F.round(stop, 4).alias("stop"))


def _q(side: str, k: int) -> str:
    m = (fc.MFE if side == "mfe" else fc.MAE)[k]
    return f"greatest({fc.FLOORS[k]}, {m} * s)"


FORECAST = f"""{P}, z AS (SELECT *, close - lag(close) OVER ({q.W}) AS d FROM v), rs AS (SELECT *, 100 - 100 / (1 + {q.ewm('greatest(d, 0.0 * d)', 1 / 14, 14)} / nullif({q.ewm('greatest(-d, 0.0 * d)', 1 / 14, 14)}, 0)) AS rsi, greatest(0.005, coalesce(vol, 0)) AS s FROM z),
f0 AS (SELECT *, {', '.join(f"{_q(x, k)} AS {x}_p{round(100 * g)}" for x in ('mfe', 'mae') for k, g in enumerate(fc.QUANTILES))}, CASE WHEN close IS NULL OR close <= 0 OR (vol IS NULL AND rsi IS NULL) THEN 'INVALID' WHEN vol IS NULL OR rsi IS NULL THEN 'DEGRADED' ELSE 'VALID' END AS quality FROM rs),
f1 AS (SELECT *, greatest(1e-6, mfe_p90 - mfe_p10) / greatest(1e-6, mfe_p50) AS unc, mfe_p50 / (mae_p50 + 1e-6) AS asym FROM f0),
f2 AS (SELECT *, CASE WHEN quality <> 'VALID' OR unc >= 2.5 THEN 'LOW_CONFIDENCE' WHEN unc >= 1.8 THEN 'MODERATE' ELSE 'HIGH' END AS conf FROM f1),
fo AS (SELECT *, CASE WHEN conf = 'LOW_CONFIDENCE' THEN 'LOW_CONFIDENCE' WHEN asym >= 1.4 AND p >= 0.65 THEN 'BULLISH' WHEN asym <= 0.7 AND p <= 0.35 THEN 'BEARISH' ELSE 'NO_DIRECTIONAL_EDGE' END AS direction,
  CASE WHEN quality <> 'VALID' OR unc >= 2.5 THEN 88.67 * CASE WHEN quality = 'VALID' THEN 1.0 ELSE 0.85 END WHEN unc >= 1.8 THEN 88.67 * 0.95 ELSE 88.67 END AS cover, mfe_p50 - 1.5 * mae_p50 - 0.0016 AS raw FROM f2)"""


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.indicators import technical

    s = technical(signals(spark, d).drop("ret_1")).withColumn("vol", F.col("vol_24"))
    return fc.complete_forecast(s, vol="vol")


@query("range_forecast", f"""WITH {FORECAST} SELECT symbol, ts, round(mfe_p10, 6) AS mfe_p10, round(mfe_p90, 6) AS mfe_p90, round(mae_p50, 6) AS mae_p50, round(close * (1 + mfe_p90), 6) AS upper_p90, round(close * (1 - mae_p90), 6) AS lower_p90, quality, round(unc, 5) AS uncertainty, conf AS confidence, round(cover, 4) AS expected_coverage,
  round(asym, 5) AS asymmetry, direction, round(raw * 100, 4) AS tradeability, CASE WHEN conf = 'LOW_CONFIDENCE' OR raw < -0.005 THEN 'LOW' WHEN raw < 0.002 THEN 'MEDIUM' ELSE 'HIGH' END AS tradeability_category FROM fo""")
def range_forecast(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d)
    return f.select("symbol", T(), R("mfe_p10"), R("mfe_p90"), R("mae_p50"), R("upper_p90"), R("lower_p90"), "quality", R("uncertainty", 5), "confidence", R("expected_coverage", 4), R("asymmetry", 5), "direction", R("tradeability", 4), "tradeability_category")


@query("range_containment", f"""
WITH {FORECAST}, f AS (SELECT *, {q.forward('max', 'high', 24)} AS hi, {q.forward('min', 'low', 24)} AS lo, lead(close, 24) OVER ({q.W}) AS ec FROM fo), c AS (SELECT symbol, hi <= close * (1 + mfe_p90) AS h, lo >= close * (1 - mae_p90) AS l, ec BETWEEN close * (1 - mae_p90) AND close * (1 + mfe_p90) AS e FROM f WHERE hi IS NOT NULL)
SELECT symbol, count(*) AS n, round(avg(CAST(h AS INTEGER)), 6) AS high_contained, round(avg(CAST(l AS INTEGER)), 6) AS low_contained, round(avg(CAST(h AND l AS INTEGER)), 6) AS both_contained, round(avg(CAST(e AS INTEGER)), 6) AS end_contained FROM c GROUP BY symbol""")
def range_containment(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).withColumn("hi", fw.forward(F.max, "high", 24)).withColumn("lo", fw.forward(F.min, "low", 24)).withColumn("ec", fw.lead("close", 24)).where("hi is not null")
    h, low, end = F.col("hi") <= F.col("upper_p90"), F.col("lo") >= F.col("lower_p90"), F.col("ec").between(F.col("lower_p90"), F.col("upper_p90"))
    share = lambda x: F.round(F.avg(x.cast("int")), 6)
    return f.groupBy("symbol").agg(F.count("*").alias("n"), share(h).alias("high_contained"), share(low).alias("low_contained"), share(h & low).alias("both_contained"), share(end).alias("end_contained"))


@query("forecast_path", f"""WITH {FORECAST}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM fo)
SELECT symbol, ts, CAST(step AS INTEGER) AS step, round(close * (1 + CASE direction WHEN 'BULLISH' THEN mfe_p50 WHEN 'BEARISH' THEN -mae_p50 ELSE 0 END * (step / 24.0)), 6) AS projected, round(close * (1 + mfe_p90 * sqrt(step / 24.0)), 6) AS band_high, round(close * (1 - mae_p90 * sqrt(step / 24.0)), 6) AS band_low, round(unc * sqrt(step / 24.0), 5) AS spread FROM l, range(1, 25) g(step) WHERE k = 1""")
def forecast_path(spark: SparkSession, d: str) -> DataFrame:
    """A 24-step path from the newest bar of each series."""
    newest = ob.keep_first(forecasts(spark, d), ["symbol"], [F.desc("ts")])
    return fc.path(newest).select("symbol", T(), "step", R("projected"), R("band_high"), R("band_low"), R("spread", 5))


@query("conformal_radius", f"""
WITH {P}, e AS (SELECT symbol, abs(ret_1) AS a FROM v WHERE ret_1 IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY a) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM e)
SELECT symbol, round(max(CASE WHEN i = least(ceil((n + 1) * (1 - 0.1) - 1e-9), n) THEN a END), 6) AS radius, max(n) AS n FROM k GROUP BY symbol""")
def conformal_radius(spark: SparkSession, d: str) -> DataFrame:
    return fc.conformal_radius(signals(spark, d), "ret_1", ["symbol"]).select("symbol", R("radius"), "n")


@query("decisions_and_blend", f"""
WITH {P} SELECT symbol, ts, CASE WHEN p > CASE WHEN n >= 5 THEN 0.58 ELSE 0.54 END THEN 'LONG' WHEN p < CASE WHEN n >= 5 THEN 0.42 ELSE 0.46 END THEN 'SHORT' ELSE 'FLAT' END AS direction,
  round(coalesce((p * n + 0.5 * 2) / nullif(n + 2.0, 0), (p + 0.5) / 2), 6) AS blended, round(2 / (1 / greatest(p, 1e-4) + 1 / greatest(n / 10.0, 1e-4)), 6) AS confidence FROM v WHERE p IS NOT NULL""")
def decisions_and_blend(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d).where("p is not null")
    p, n = F.col("p"), F.col("n")
    return s.select("symbol", T(), fc.decision(p, n >= 5).alias("direction"), F.round(fc.blended([p, F.lit(0.5)], [n.cast("double"), F.lit(2.0)]), 6).alias("blended"), F.round(fc.harmonic(p, n / 10.0), 6).alias("confidence"))


@query("reliability_tiers", f"""
WITH {S}, a AS (SELECT horizon, 100 * avg(CAST(abs(r) <= 0.035 AS INTEGER)) AS cv, 20 * avg(abs(r)) AS er, abs(avg(r)) * 10 AS psi, avg(p) > 0.3 AS ok, CAST(count(DISTINCT CAST(ts AS DATE)) AS DOUBLE) / 60 AS bl FROM s GROUP BY horizon),
t AS (SELECT horizon, bl, 0.25 * greatest(0, 100 - abs(cv - 90) * 15) + 0.25 * greatest(0, 100 - er / 0.5 * 40) + 0.2 * CASE WHEN psi < 0.05 THEN 100 WHEN psi < 0.1 THEN 80 ELSE 40 END + 0.15 * CASE WHEN ok THEN 100 ELSE 20 END + 0.15 * CASE WHEN bl >= 30 THEN 100 ELSE bl / 30 * 80 END AS score FROM a)
SELECT horizon, round(score, 4) AS score, CASE WHEN score >= 85 AND bl >= 30 THEN 'VERY_HIGH' WHEN score >= 75 THEN 'HIGH' WHEN score >= 60 THEN 'MODERATE' WHEN score >= 40 THEN 'LOW' ELSE 'INSUFFICIENT' END AS tier FROM t""")
def reliability_tiers(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("r")
    a = scored(spark, d).groupBy("horizon").agg(
        (100 * F.avg((F.abs(r) <= 0.035).cast("int"))).alias("cv"), (20 * F.avg(F.abs(r))).alias("er"), (F.abs(F.avg(r)) * 10).alias("psi"), (F.avg("p") > 0.3).alias("ok"), (F.count_distinct(F.to_date("ts")) / 60).alias("bl"),
    )
    score, tier = fc.reliability_score(*map(F.col, ("cv", "er", "psi", "ok", "bl")))
    return a.select("horizon", F.round(score, 4).alias("score"), tier.alias("tier"))


# --- sequential operators, whose twins recurse over positions ---
_SEQ = f"{q.BARS}, {RET}, n AS (SELECT symbol, ts, close, coalesce(ret_1, 0) AS x, row_number() OVER ({q.W}) AS i FROM r)"


@query("cusum_filter", f"""
WITH RECURSIVE {_SEQ}, c AS (SELECT symbol, i, CASE WHEN greatest(0, x) > 1.0 THEN 0 ELSE greatest(0, x) END AS up, CASE WHEN greatest(0, x) <= 1.0 AND least(0, x) < -1.0 THEN 0 ELSE least(0, x) END AS dn, CASE WHEN greatest(0, x) > 1.0 THEN 1 WHEN least(0, x) < -1.0 THEN -1 ELSE 0 END AS ev FROM n WHERE i = 1
  UNION ALL SELECT n.symbol, n.i, CASE WHEN greatest(0, up + x) > 1.0 THEN 0 ELSE greatest(0, up + x) END, CASE WHEN greatest(0, up + x) <= 1.0 AND least(0, dn + x) < -1.0 THEN 0 ELSE least(0, dn + x) END, CASE WHEN greatest(0, up + x) > 1.0 THEN 1 WHEN least(0, dn + x) < -1.0 THEN -1 ELSE 0 END FROM c JOIN n ON n.symbol = c.symbol AND n.i = c.i + 1)
SELECT n.symbol, n.ts, CAST(ev AS BIGINT) AS cusum_event FROM c JOIN n USING (symbol, i)""")
def cusum_filter(spark: SparkSession, d: str) -> DataFrame:
    b = ob.bars(spark, d).withColumn("x", fw.log_return("close")).select("symbol", "ts", "x")
    return sq.cusum(b, ["symbol"], ["ts"], "x", 1.0).select("symbol", T(), "cusum_event")


@query("event_cooldown", """
WITH RECURSIVE e AS (SELECT event_id, event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events), c AS (SELECT event_id, event_type, i, ts AS last, 1 AS k FROM e WHERE i = 1
  UNION ALL SELECT e.event_id, e.event_type, e.i, CASE WHEN e.ts - c.last >= INTERVAL 24 HOUR THEN e.ts ELSE c.last END, CASE WHEN e.ts - c.last >= INTERVAL 24 HOUR THEN 1 ELSE 0 END FROM c JOIN e ON e.event_type = c.event_type AND e.i = c.i + 1)
SELECT event_id FROM c WHERE k = 1""")
def event_cooldown(spark: SparkSession, d: str) -> DataFrame:
    return jumps.cooldown(ob.events(spark, d).select("event_id", "event_type", "ts"), "event_type", "event_id", 86400).select("event_id")


_SIG = f"{P}, sg AS (SELECT symbol, ts, close, low, high, CASE WHEN p > 0.54 THEN 1.0 WHEN p < 0.46 THEN -1.0 ELSE 0.0 END AS s, row_number() OVER ({q.W}) AS i, {q.rolling('avg', f'(greatest(high - low, abs(high - pc), abs(low - pc)))', 14)} AS atr FROM (SELECT *, lag(close) OVER ({q.W}) AS pc FROM v))"


@query("max_hold_positions", f"""
WITH RECURSIVE {_SIG}, h AS (SELECT symbol, i, s AS pos, CASE WHEN s <> 0 THEN 6 ELSE 0 END AS n FROM sg WHERE i = 1
  UNION ALL SELECT g.symbol, g.i, CASE WHEN s <> 0 AND s <> pos THEN s WHEN pos <> 0 AND n - 1 <= 0 THEN 0.0 ELSE pos END, CASE WHEN s <> 0 AND s <> pos THEN 6 WHEN pos <> 0 THEN n - 1 ELSE n END FROM h JOIN sg g ON g.symbol = h.symbol AND g.i = h.i + 1)
SELECT sg.symbol, sg.ts, pos AS held FROM h JOIN sg USING (symbol, i)""")
def max_hold_positions(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d)
    s = s.withColumn("signal", bt.positions(s)).select("symbol", "ts", "close", "signal")
    return sq.max_hold(s, ["symbol"], ["ts"], "signal", 6).select("symbol", T(), "held")


@query("exit_policy", f"""
WITH RECURSIVE {_SIG}, u AS (SELECT *, CASE WHEN atr > 0 THEN atr ELSE 0.001 * close END AS unit FROM sg), h AS (SELECT symbol, i, s AS side, close AS entry, unit AS un, 0 AS age, false AS done, CAST(NULL AS VARCHAR) AS why FROM u WHERE i = 1
  UNION ALL SELECT u.symbol, u.i, s, CASE WHEN s <> side THEN u.close ELSE entry END, CASE WHEN s <> side THEN u.unit ELSE un END, CASE WHEN s <> side THEN 0 ELSE age + 1 END,
    CASE WHEN s <> side THEN false WHEN side <> 0 AND NOT done THEN side * (u.close - entry) >= 2 * un OR side * (u.close - entry) <= -un OR age + 1 >= 24 ELSE done END,
    CASE WHEN s <> side THEN CASE WHEN side <> 0 AND NOT done THEN CASE WHEN s <> 0 THEN 'FLIP' ELSE 'FLAT' END END WHEN side <> 0 AND NOT done THEN CASE WHEN side * (u.close - entry) >= 2 * un THEN 'TP' WHEN side * (u.close - entry) <= -un THEN 'SL' WHEN age + 1 >= 24 THEN 'TIME' END END
  FROM h JOIN u ON u.symbol = h.symbol AND u.i = h.i + 1)
SELECT u.symbol, u.ts, CASE WHEN done THEN 0.0 ELSE u.s END AS held, why AS exit_reason FROM h JOIN u USING (symbol, i)""")
def exit_policy(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.indicators import atr_simple

    s = atr_simple(signals(spark, d))
    s = s.withColumn("signal", bt.positions(s)).select("symbol", "ts", "close", "signal", "atr_simple")
    return sq.exit_policy(s, ["symbol"], ["ts"], "signal", "atr_simple").select("symbol", T(), "held", "exit_reason")


def _hawkes_sql() -> str:
    felt = ", ".join(f"{sq.MU[i]} + coalesce(sum(CASE b.k {' '.join(f'WHEN {j} THEN {sq.ALPHA[i][j]}' for j in range(4))} END * exp(-{sq.BETA[i]} * (a.us - b.us) / 1e6)), 0) AS l{i}" for i in range(4))
    return f"""WITH e AS (SELECT event_id, epoch_us(ts) AS us, CASE event_type WHEN 'purchase' THEN CASE WHEN value > 0 THEN 0 ELSE 1 END WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS k FROM events),
x AS (SELECT a.event_id, {felt} FROM e a LEFT JOIN e b ON b.us >= a.us - 60000000 AND b.us < a.us GROUP BY a.event_id)
SELECT event_id, round(l0, 4) AS lambda_buy, round(l1, 4) AS lambda_sell, round(l2, 4) AS lambda_liquidity, round(l3, 4) AS lambda_volatility, round(l0 / (l1 + 1e-6), 4) AS buy_sell_intensity_ratio, round(l0 - l1, 4) AS event_pressure, round((l0 + l1 + l2 + l3) / {sum(sq.MU)}, 4) AS event_cluster_score FROM x"""


@query("hawkes_intensity", _hawkes_sql())
def hawkes_intensity(spark: SparkSession, d: str) -> DataFrame:
    return sq.hawkes(ob.l2_events(ob.events(spark, d))).select("event_id", *[R(c, 4) for c in sq.HAWKES])
