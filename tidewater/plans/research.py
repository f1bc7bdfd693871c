"""Studies over forecasts and signals: baselines, calibration by classes, model selection, gates, stress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics as fm
from ..functions import ranks as fr
from ..functions import scalar as fs
from ..functions import windows as fw
from ..operators import backtest as bt
from ..operators import bars as ob
from ..operators import forecast as fc
from ..operators import labels as ol
from ..operators import ledger as og
from ..operators import resampling as rs
from ..operators import services as sv
from ..operators import validation as ov
from ..sources import scans, sinks
from ..sources.shared import shared_dir
from . import sql as q
from .analytics import R, S, scored, t
from .registry import query
from .trading import FORECAST, P, forecasts, signals

T = lambda: F.col("ts").cast("timestamp_ntz").alias("ts")


@query("fold_mean_by_model", f"WITH {S}, f AS (SELECT horizon AS model, l_linenumber AS fold, avg(CAST((p >= 0.5) = (y = 1) AS INTEGER)) AS accuracy, avg((y - p) * (y - p)) AS brier FROM s GROUP BY ALL) SELECT model, count(DISTINCT fold) AS folds, round(avg(accuracy), 6) AS accuracy, round(avg(brier), 6) AS brier FROM f GROUP BY model")
def fold_mean_by_model(spark: SparkSession, d: str) -> DataFrame:
    hit = ((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int")
    f = scored(spark, d).groupBy(F.col("horizon").alias("model"), F.col("l_linenumber").alias("fold")).agg(F.avg(hit).alias("accuracy"), fm.brier(F.col("p"), F.col("y")).alias("brier"))
    return f.groupBy("model").agg(F.count_distinct("fold").alias("folds"), F.round(F.avg("accuracy"), 6).alias("accuracy"), F.round(F.avg("brier"), 6).alias("brier"))


def _balance_sql() -> str:
    one = lambda h: f"SELECT symbol, {h} AS h, ts, ln(lead(close, {h}) OVER ({q.W}) / nullif(close, 0)) AS r, 0.5 * coalesce(vol, 0.015) * sqrt({h} / 24.0) AS e, lead(ts, {h}) OVER ({q.W}) AS t1 FROM v"
    return f"""WITH {P}, a AS ({' UNION ALL '.join(one(h) for h in (1, 3, 6, 12, 24))}), c AS (SELECT *, CASE WHEN r > e THEN 'BUY' WHEN r < -e THEN 'SELL' ELSE 'HOLD' END AS k, t1 > lead(ts) OVER (PARTITION BY symbol, h ORDER BY ts) AS ov FROM a WHERE r IS NOT NULL),
n AS (SELECT h, count(*) AS n, avg(CAST(k = 'BUY' AS INTEGER)) AS b, avg(CAST(k = 'SELL' AS INTEGER)) AS s, avg(CAST(k = 'HOLD' AS INTEGER)) AS o, avg(CAST(ov AS INTEGER)) AS ov, avg(abs(r)) AS ar FROM c GROUP BY h)
SELECT CAST(h AS INTEGER) AS horizon, n, round(b, 6) AS buy, round(s, 6) AS sell, round(greatest(b, s, o), 6) AS majority, round(-(CASE WHEN b > 0 THEN b * log2(b) ELSE 0 END + CASE WHEN s > 0 THEN s * log2(s) ELSE 0 END + CASE WHEN o > 0 THEN o * log2(o) ELSE 0 END), 6) AS entropy, round(ov, 6) AS overlap_rate, round(ar - 0.0008, 6) AS net_move FROM n"""


@query("class_balance", _balance_sql())
def class_balance(spark: SparkSession, d: str) -> DataFrame:
    """Shares of up, down and flat at five horizons, the majority's share, entropy, and how many labels overlap the next."""
    out = None
    for h in (1, 3, 6, 12, 24):
        s = ol.horizon_return(signals(spark, d), h).withColumn("r", F.col(f"fwd_ret_{h}")).withColumn("t1", fw.lead("ts", h)).select("symbol", F.lit(h).alias("horizon"), "ts", "r", "t1", (0.5 * F.coalesce("vol", F.lit(0.015)) * (h / 24) ** 0.5).alias("e"))
        out = s if out is None else out.unionByName(s)
    k = F.when(F.col("r") > F.col("e"), "BUY").when(F.col("r") < -F.col("e"), "SELL").otherwise("HOLD")
    c = out.where("r is not null").withColumn("k", k).withColumn("ov", F.col("t1") > fw.lead("ts", 1, fw.Key(("symbol", "horizon"))))
    share = lambda x: F.avg((F.col("k") == x).cast("int"))
    n = c.groupBy("horizon").agg(F.count("*").alias("n"), share("BUY").alias("b"), share("SELL").alias("s"), share("HOLD").alias("o"), F.avg(F.col("ov").cast("int")).alias("ov"), F.avg(F.abs("r")).alias("ar"))
    h = -sum((F.when(F.col(x) > 0, F.col(x) * F.log2(x)).otherwise(0.0) for x in "bso"), F.lit(0.0))
    return n.select("horizon", "n", F.round("b", 6).alias("buy"), F.round("s", 6).alias("sell"), F.round(F.greatest("b", "s", "o"), 6).alias("majority"), F.round(h, 6).alias("entropy"), F.round("ov", 6).alias("overlap_rate"), F.round(F.col("ar") - 0.0008, 6).alias("net_move"))


CLASSES = "c AS (SELECT *, p * 0.6 AS p0, p * 0.3 + 0.1 AS p1, 1 - p * 0.9 - 0.1 AS p2, CASE horizon WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS k FROM s)"


def classes(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    return scored(spark, d).withColumn("p0", p * 0.6).withColumn("p1", p * 0.3 + 0.1).withColumn("p2", 1 - p * 0.9 - 0.1).withColumn("k", F.when(F.col("horizon") == "A", 0).when(F.col("horizon") == "N", 1).otherwise(2))


@query("multiclass_scores", f"""
WITH {S}, {CLASSES}, r AS (SELECT j, CAST(k = j AS INTEGER) AS y, rank() OVER (PARTITION BY j ORDER BY sc) + (count(*) OVER (PARTITION BY j, sc) - 1) / 2.0 AS rk FROM (SELECT k, 0 AS j, p0 AS sc FROM c UNION ALL SELECT k, 1, p1 FROM c UNION ALL SELECT k, 2, p2 FROM c)),
a AS (SELECT j, (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc FROM r GROUP BY j)
SELECT (SELECT round(avg(pow(p0 - CAST(k = 0 AS INT), 2) + pow(p1 - CAST(k = 1 AS INT), 2) + pow(p2 - CAST(k = 2 AS INT), 2)), 6) FROM c) AS brier, (SELECT round(avg(auc), 6) FROM a) AS auc_macro""")
def multiclass_scores(spark: SparkSession, d: str) -> DataFrame:
    c = classes(spark, d)
    brier = c.agg(F.round(fm.brier_classes([F.col("p0"), F.col("p1"), F.col("p2")], F.col("k")), 6).alias("brier"))
    area = fm.auc_one_vs_rest(c.select("k", "p0", "p1", "p2"), {0: "p0", 1: "p1", 2: "p2"}, "k")
    return brier.crossJoin(F.broadcast(area.select(F.round("auc", 6).alias("auc_macro"))))  # one row


PANEL = f"""{FORECAST}, lg AS (SELECT *, least(greatest((high - close) / nullif(close, 0), 0.001), 0.15) AS um, row_number() OVER ({q.W}) AS rn, {q.forward('max', 'high', 24)} AS hi, {q.forward('min', 'low', 24)} AS lo FROM fo),
pb AS (SELECT *, (hi - close) / nullif(close, 0) AS act, quantile_cont(um, 0.5) OVER ({q.W} ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS med, avg(greatest(high - low, 1e-4)) OVER ({q.W} ROWS 14 PRECEDING) / nullif(close, 0) AS atr, greatest(0.005, coalesce(stddev_pop(ret_1) OVER ({q.W} ROWS 23 PRECEDING), 0.015 / sqrt(24)) * sqrt(24)) AS ew FROM lg),
pa AS (SELECT symbol, act, unnest([{{'m': 'median_168', 'a': med, 'b': med * 1.8}}, {{'m': 'atr', 'a': atr, 'b': atr * 2.0}}, {{'m': 'trailing_vol', 'a': ew, 'b': ew * 1.64}}, {{'m': 'production', 'a': mfe_p50, 'b': mfe_p90}}]) AS z FROM pb WHERE act IS NOT NULL AND med IS NOT NULL)"""


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Actual favourable moves beside the median and 90 % guesses of four models: ``model, act, a, b``."""
    f = forecasts(spark, d).withColumn("ret_1", fw.log_return("close")).withColumn("hi", fw.forward(F.max, "high", 24)).withColumn("act", F.try_divide(F.col("hi") - F.col("close"), F.col("close")))
    um = F.least(F.greatest(F.try_divide(F.col("high") - F.col("close"), F.nullif(F.col("close"), F.lit(0.0))), F.lit(0.001)), F.lit(0.15))
    w, c = fw.BARS.base(), F.col("close")
    f = f.withColumn("um", um).withColumn("med", F.percentile("um", F.lit(0.5)).over(w.rowsBetween(-168, -1))).withColumn("atr", F.try_divide(F.avg(F.greatest(F.col("high") - F.col("low"), F.lit(1e-4))).over(w.rowsBetween(-14, 0)), c))
    f = f.withColumn("ew", F.greatest(F.lit(0.005), F.coalesce(F.stddev_pop("ret_1").over(w.rowsBetween(-23, 0)), F.lit(0.015 / 24**0.5)) * 24**0.5)).where("act is not null and med is not null")
    guess = lambda m, a, b: F.struct(F.lit(m).alias("model"), a.alias("a"), b.alias("b"))
    each = F.explode(F.array(guess("median_168", F.col("med"), F.col("med") * 1.8), guess("atr", F.col("atr"), F.col("atr") * 2.0), guess("trailing_vol", F.col("ew"), F.col("ew") * 1.64), guess("production", F.col("mfe_p50"), F.col("mfe_p90"))))
    return f.select("symbol", "act", each.alias("z")).select("symbol", "act", "z.*")


@query("baseline_panel", f"""WITH {PANEL}, e AS (SELECT z.m AS model, abs(act - z.a) AS e, CAST(act <= z.b AS INTEGER) AS c FROM pa)
SELECT model, count(*) AS n, round(avg(e), 5) AS mae, round(sqrt(avg(e * e)), 5) AS rmse, round(quantile_cont(e, 0.5), 5) AS medae, round(quantile_cont(e, 0.9), 5) AS p90_error, round(avg(c), 6) AS coverage FROM e GROUP BY model""")
def baseline_panel(spark: SparkSession, d: str) -> DataFrame:
    e = panel(spark, d).withColumn("e", F.abs(F.col("act") - F.col("a"))).withColumn("c", (F.col("act") <= F.col("b")).cast("int")).persist()
    means = e.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("e"), 5).alias("mae"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 5).alias("rmse"), F.round(F.avg("c"), 6).alias("coverage"))
    return means.join(fr.exact_quantiles(e, ["model"], "e", {"medae": 0.5, "p90_error": 0.9}), "model").select("model", "n", "mae", "rmse", R("medae", 5), R("p90_error", 5), "coverage")


@query("bake_off", f"""WITH {PANEL} SELECT symbol, count(*) AS n, round(avg(abs(act - mfe_p50)), 5) AS champion_error, round(avg(abs(act - ew)), 5) AS challenger_error, round(avg(CAST(abs(act - mfe_p50) < abs(act - ew) AS INTEGER)), 6) AS champion_wins, round(avg(greatest(0.9 * (act - mfe_p50), -0.1 * (act - mfe_p50))), 5) AS champion_pinball,
  round(avg(greatest(0.9 * (act - ew), -0.1 * (act - ew))), 5) AS challenger_pinball, round(avg(CAST(hi <= close * (1 + mfe_p90) AND lo >= close * (1 - mae_p90) AS INTEGER)), 6) AS champion_contained, round(avg(CAST(hi <= close * (1 + ew * 1.64) AND lo >= close * (1 - ew * 1.64) AS INTEGER)), 6) AS challenger_contained FROM pb WHERE act IS NOT NULL AND rn % 24 = 0 GROUP BY symbol""")
def bake_off(spark: SparkSession, d: str) -> DataFrame:
    """Champion and challenger on the same rows, a day apart."""
    w = fw.BARS.base()
    f = forecasts(spark, d).withColumn("ret_1", fw.log_return("close")).withColumn("hi", fw.forward(F.max, "high", 24)).withColumn("lo", fw.forward(F.min, "low", 24)).withColumn("act", F.try_divide(F.col("hi") - F.col("close"), F.col("close"))).withColumn("rn", F.row_number().over(w))
    f = f.withColumn("ew", F.greatest(F.lit(0.005), F.coalesce(F.stddev_pop("ret_1").over(w.rowsBetween(-23, 0)), F.lit(0.015 / 24**0.5)) * 24**0.5)).where("act is not null and rn % 24 = 0")
    a, b, act, c = F.abs(F.col("act") - F.col("mfe_p50")), F.abs(F.col("act") - F.col("ew")), F.col("act"), F.col("close")
    inside = lambda up, down: F.round(F.avg(((F.col("hi") <= up) & (F.col("lo") >= down)).cast("int")), 6)
    return f.groupBy("symbol").agg(
        F.count("*").alias("n"), F.round(F.avg(a), 5).alias("champion_error"), F.round(F.avg(b), 5).alias("challenger_error"), F.round(F.avg((a < b).cast("int")), 6).alias("champion_wins"),
        F.round(fm.pinball(act, F.col("mfe_p50"), 0.9), 5).alias("champion_pinball"), F.round(fm.pinball(act, F.col("ew"), 0.9), 5).alias("challenger_pinball"),
        inside(F.col("upper_p90"), F.col("lower_p90")).alias("champion_contained"), inside(c * (1 + F.col("ew") * 1.64), c * (1 - F.col("ew") * 1.64)).alias("challenger_contained"),
    )


@query("epoch_comparison", f"""WITH {PANEL}, e AS (SELECT symbol, ntile(3) OVER (PARTITION BY symbol ORDER BY ts) AS epoch, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, abs(act - mfe_p50) AS me, abs((close - lo) / nullif(close, 0) - mae_p50) AS ae, CAST(hi <= close * (1 + mfe_p90) AND lo >= close * (1 - mae_p90) AS INTEGER) AS pc, mfe_p90 + mae_p90 AS w FROM pb WHERE act IS NOT NULL)
SELECT CAST(epoch AS INTEGER) AS epoch, count(*) AS blocks, round(avg(me), 5) AS mfe_error, round(avg(ae), 5) AS mae_error, round(avg(pc), 6) AS contained, round(avg(w), 6) AS width FROM e WHERE k % 24 = 0 GROUP BY epoch""")
def epoch_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Three consecutive thirds of each series, a forecast a day."""
    f = forecasts(spark, d).withColumn("hi", fw.forward(F.max, "high", 24)).withColumn("lo", fw.forward(F.min, "low", 24)).withColumn("act", F.try_divide(F.col("hi") - F.col("close"), F.col("close"))).where("act is not null")
    f = f.withColumn("epoch", F.ntile(3).over(fw.BARS.base())).withColumn("k", F.row_number().over(fw.BARS.base())).where("k % 24 = 0")
    inside = ((F.col("hi") <= F.col("upper_p90")) & (F.col("lo") >= F.col("lower_p90"))).cast("int")
    return f.groupBy("epoch").agg(
        F.count("*").alias("blocks"), F.round(F.avg(F.abs(F.col("act") - F.col("mfe_p50"))), 5).alias("mfe_error"), F.round(F.avg(F.abs(F.try_divide(F.col("close") - F.col("lo"), F.col("close")) - F.col("mae_p50"))), 5).alias("mae_error"),
        F.round(F.avg(inside), 6).alias("contained"), F.round(F.avg(F.col("mfe_p90") + F.col("mae_p90")), 6).alias("width"),
    )


@query("accuracy_records", f"""WITH {PANEL}, ar AS (SELECT symbol, ts, greatest(0, (hi - close) / (close + 1e-6)) AS am, greatest(0, (close - lo) / (close + 1e-6)) AS aa, mfe_p50, mae_p50, mfe_p90, mae_p90 FROM pb WHERE act IS NOT NULL)
SELECT symbol, ts, round(abs(am - mfe_p50), 5) AS mfe_error, round(abs(aa - mae_p50), 5) AS mae_error, CAST(am <= mfe_p90 AND aa <= mae_p90 AS INTEGER) AS path_contained, round((2 * (mfe_p90 + mae_p90) + 20 * (greatest(0, am - mfe_p90) + greatest(0, aa - mae_p90))) * 100, 3) AS winkler, round(0.5 * (abs(am - mfe_p50) + abs(aa - mae_p50)), 5) AS quantile_loss FROM ar""")
def accuracy_records(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).withColumn("actual_high", fw.forward(F.max, "high", 24)).withColumn("actual_low", fw.forward(F.min, "low", 24)).withColumn("price", F.col("close")).where("actual_high is not null and close <> 0")
    return fc.accuracy_record(f).select("symbol", T(), R("mfe_error", 5), R("mae_error", 5), F.col("path_contained").cast("int").alias("path_contained"), R("winkler", 3), R("quantile_loss", 5))


@query("range_quality", f"""WITH {PANEL}, a AS (SELECT symbol, 100 * avg(CAST(hi <= close * (1 + mfe_p90) AND lo >= close * (1 - mae_p90) AS INTEGER)) AS pc, avg(abs(act - mfe_p50)) AS er, avg(abs(act - mfe_p50)) - avg(abs(act - ew)) AS de, 10 * avg(mfe_p90 + mae_p90) AS w, bool_and(quality <> 'INVALID') AS ok FROM pb WHERE act IS NOT NULL GROUP BY symbol),
s AS (SELECT symbol, ok, CASE WHEN ok THEN greatest(10.0, 100 - CASE WHEN pc < 70 THEN 30 WHEN pc < 80 THEN 15 ELSE 0 END - CASE WHEN er > 0.8 THEN 20 WHEN er > 0.55 THEN 10 ELSE 0 END - CASE WHEN de > 0.05 THEN 15 ELSE 0 END - CASE WHEN w > 8 THEN 10 ELSE 0 END) ELSE 45.0 END AS score FROM a)
SELECT symbol, CAST(score AS DOUBLE) AS score, CASE WHEN NOT ok THEN 'DEGRADED' WHEN score >= 85 THEN 'EXCELLENT' WHEN score >= 70 THEN 'GOOD' WHEN score >= 55 THEN 'WATCH' ELSE 'DEGRADED' END AS status FROM s""")
def range_quality(spark: SparkSession, d: str) -> DataFrame:
    w = fw.BARS.base()
    f = forecasts(spark, d).withColumn("ret_1", fw.log_return("close")).withColumn("hi", fw.forward(F.max, "high", 24)).withColumn("lo", fw.forward(F.min, "low", 24)).withColumn("act", F.try_divide(F.col("hi") - F.col("close"), F.col("close")))
    f = f.withColumn("ew", F.greatest(F.lit(0.005), F.coalesce(F.stddev_pop("ret_1").over(w.rowsBetween(-23, 0)), F.lit(0.015 / 24**0.5)) * 24**0.5)).where("act is not null")
    inside = ((F.col("hi") <= F.col("upper_p90")) & (F.col("lo") >= F.col("lower_p90"))).cast("int")
    error, other = F.avg(F.abs(F.col("act") - F.col("mfe_p50"))), F.avg(F.abs(F.col("act") - F.col("ew")))
    a = f.groupBy("symbol").agg((100 * F.avg(inside)).alias("pc"), error.alias("er"), (error - other).alias("de"), (10 * F.avg(F.col("mfe_p90") + F.col("mae_p90"))).alias("w"), F.every(F.col("quality") != "INVALID").alias("ok"))
    score, status = fc.range_quality(F.col("pc"), F.col("er"), F.col("de"), F.col("w"), F.col("ok"))
    return a.select("symbol", score.alias("score"), status.alias("status"))


@query("non_crossing", f"WITH {S} SELECT l_orderkey, l_linenumber, round(p, 6) AS q1, round(greatest(p, x / 60), 6) AS q2, round(greatest(p, x / 60, 0.4 + r), 6) AS q3, round(greatest(p, x / 60, 0.4 + r) - p, 6) AS width, round((greatest(p, x / 60, 0.4 + r) - p) / ((p + greatest(p, x / 60) + greatest(p, x / 60, 0.4 + r)) / 3 + 1e-6), 5) AS uncertainty_ratio FROM s")
def non_crossing(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles made monotone, and the distribution they give: width and width over mean."""
    s = scored(spark, d).withColumn("q1", F.col("p")).withColumn("q2", F.col("x") / 60).withColumn("q3", 0.4 + F.col("r"))
    s = fc.non_crossing(s, ["q1", "q2", "q3"])
    mean = (F.col("q1_sorted") + F.col("q2_sorted") + F.col("q3_sorted")) / 3
    width = F.col("q3_sorted") - F.col("q1_sorted")
    return s.select("l_orderkey", "l_linenumber", *[F.round(f"{c}_sorted", 6).alias(c) for c in ("q1", "q2", "q3")], F.round(width, 6).alias("width"), F.round(width / (mean + 1e-6), 5).alias("uncertainty_ratio"))


@query("decomposed_uncertainty", f"""WITH {FORECAST}, u AS (SELECT symbol, ts, (CASE WHEN close IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN rsi IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN vol IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN ret_1 IS NOT NULL THEN 1 ELSE 0 END) / 4.0 * CASE WHEN n < 2 THEN 0.7 ELSE 1.0 END AS d, coalesce(p, 0.5) AS a, 1 - coalesce(p, 0.5) AS b, vol FROM fo),
x AS (SELECT *, 1 - (-(CASE WHEN a > 0 THEN a * ln(a) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b) ELSE 0 END)) / ln(2) AS rc, abs(a - 0.5) / 2 AS sd, (a + 0.5) / 2 AS mp FROM u), y AS (SELECT *, least(greatest(rc, 0), 1) AS rr FROM x),
dz AS (SELECT *, least(greatest(CASE WHEN abs(mp - 0.5) < 0.01 THEN 0.5 + 0.5 * rr ELSE 1 - 2 * sd END, 0), 1) AS ma, coalesce(1 - CASE WHEN vol IS NOT NULL THEN least(greatest((vol - 0.005) / 0.045, 0), 1) END, 0.5) AS vs FROM y)
SELECT symbol, ts, round(d, 6) AS data_reliability, round(rr, 6) AS regime_certainty, round(ma, 6) AS model_agreement, round(vs, 6) AS volatility_calm, round(4 / (1 / greatest(d, 1e-4) + 1 / greatest(rr, 1e-4) + 1 / greatest(ma, 1e-4) + 1 / greatest(vs, 1e-4)), 6) AS quality FROM dz""")
def decomposed_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    """Four sources of confidence, and their harmonic mean."""
    f = forecasts(spark, d).withColumn("ret_1", fw.log_return("close"))
    a = F.coalesce("p", F.lit(0.5))
    f = f.withColumn("d", fc.data_reliability([F.col(c) for c in ("close", "rsi_14", "vol", "ret_1")], F.col("n") < 2)).withColumn("rc", fc.regime_certainty([a, 1 - a])).withColumn("ma", fc.model_agreement([a, F.lit(0.5)], F.col("rc"))).withColumn("vs", fc.volatility_calm(F.col("vol")))
    return f.select("symbol", T(), F.round("d", 6).alias("data_reliability"), F.round("rc", 6).alias("regime_certainty"), F.round("ma", 6).alias("model_agreement"), F.round("vs", 6).alias("volatility_calm"), F.round(fc.harmonic(*map(F.col, ("d", "rc", "ma", "vs"))), 6).alias("quality"))


@query("residual_ic", f"""
WITH {P}, a AS (SELECT symbol, ts, vol AS x1, ln(close / nullif(lag(close, 24) OVER ({q.W}), 0)) AS x2, p AS f, ln(lead(close, 4) OVER ({q.W}) / nullif(close, 0)) AS y FROM v), b AS (SELECT *, percent_rank() OVER (PARTITION BY symbol ORDER BY ts) <= 0.6 AS tr FROM a WHERE f IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND y IS NOT NULL),
m AS (SELECT symbol, count(*) AS n, avg(f) AS mf, avg(x1) AS m1, avg(x2) AS m2, sum(x1 * x1) AS s11, sum(x2 * x2) AS s22, sum(x1 * x2) AS s12, sum(x1 * f) AS s1f, sum(x2 * f) AS s2f FROM b WHERE tr GROUP BY symbol),
w AS (SELECT *, s11 - n * m1 * m1 + 1 AS a11, s22 - n * m2 * m2 + 1 AS a22, s12 - n * m1 * m2 AS a12, s1f - n * m1 * mf AS b1, s2f - n * m2 * mf AS b2 FROM m),
g AS (SELECT b.*, mf + (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) * (x1 - m1) + (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12) * (x2 - m2) AS fit FROM b JOIN w USING (symbol) WHERE NOT tr),
k AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY f) + (count(*) OVER (PARTITION BY symbol, f) - 1) / 2.0 AS rf, rank() OVER (PARTITION BY symbol ORDER BY f - fit) + (count(*) OVER (PARTITION BY symbol, f - fit) - 1) / 2.0 AS rr, rank() OVER (PARTITION BY symbol ORDER BY y) + (count(*) OVER (PARTITION BY symbol, y) - 1) / 2.0 AS ry, avg(f) OVER (PARTITION BY symbol) AS af FROM g)
SELECT symbol, count(*) AS n, round(1 - sum(pow(f - fit, 2)) / nullif(sum(pow(f - af, 2)), 0), 5) AS r2, round(corr(rf, ry), 4) AS ic_raw, round(corr(rr, ry), 4) AS ic_residual FROM k GROUP BY symbol""")
def residual_ic(spark: SparkSession, d: str) -> DataFrame:
    """What of a factor its base features don't explain, and whether that still ranks returns."""
    s = signals(spark, d).withColumn("x2", fw.log_return("close", 24)).withColumn("y", F.ln(F.try_divide(fw.lead("close", 4), F.nullif(F.col("close"), F.lit(0.0))))).select("symbol", "ts", F.col("vol").alias("x1"), "x2", F.col("p").alias("f"), "y").dropna()
    s = s.withColumn("tr", F.percent_rank().over(fw.BARS.base()) <= 0.6)
    g = sv.residual_factor(s, "f", "x1", "x2", F.col("tr"), ["symbol"]).where("not tr").persist()
    mean = g.groupBy("symbol").agg(F.avg("f").alias("af"))
    r2 = g.join(F.broadcast(mean), "symbol").groupBy("symbol").agg(F.count("*").alias("n"), (1 - F.try_divide(F.sum(F.pow("residual", F.lit(2.0))), F.nullif(F.sum(F.pow(F.col("f") - F.col("af"), F.lit(2.0))), F.lit(0.0)))).alias("r2"))  # a row a series
    raw, rest = fm.spearman(g, "f", "y", ("symbol",)).select("symbol", F.round("ic", 4).alias("ic_raw")), fm.spearman(g, "residual", "y", ("symbol",)).select("symbol", F.round("ic", 4).alias("ic_residual"))
    return r2.join(raw, "symbol").join(rest, "symbol").select("symbol", "n", R("r2", 5), "ic_raw", "ic_residual")


@query("conditional_subspaces", f"""
WITH {S}, m AS (SELECT y, p, x, unnest(list_filter([CASE WHEN p > 0.7 OR p < 0.3 THEN 'CONFIDENT' END, CASE WHEN x > 40 THEN 'LARGE' END, CASE WHEN regime = 'O' THEN 'OPEN' END, CASE WHEN r > 0.02 THEN 'RICH' END], lambda z: z IS NOT NULL)) AS part FROM s),
k AS (SELECT *, rank() OVER (PARTITION BY part ORDER BY x) + (count(*) OVER (PARTITION BY part, x) - 1) / 2.0 AS rk FROM m)
SELECT part, count(*) AS n, round(avg(CAST((p >= 0.5) = (y = 1) AS INTEGER)), 6) AS accuracy, round(avg(y), 6) AS p_up, round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auc FROM k GROUP BY part""")
def conditional_subspaces(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping parts of the data: a row counts in all that hold it."""
    p = F.col("p")
    parts = F.filter(F.array(F.when((p > 0.7) | (p < 0.3), "CONFIDENT"), F.when(F.col("x") > 40, "LARGE"), F.when(F.col("regime") == "O", "OPEN"), F.when(F.col("r") > 0.02, "RICH")), lambda z: z.isNotNull())
    m = scored(spark, d).withColumn("part", F.explode(parts))
    area = fm.auc(m, "x", "y", ("part",)).select("part", R("auc"))
    hit = ((p >= 0.5) == (F.col("y") == 1)).cast("int")
    return m.groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("accuracy"), F.round(F.avg("y"), 6).alias("p_up")).join(area, "part")


@query("sanitised_vector", "WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST('nan' AS DOUBLE) WHEN 1 THEN CAST('inf' AS DOUBLE) WHEN 2 THEN CAST('-inf' AS DOUBLE) WHEN 3 THEN NULL ELSE value END AS x FROM events) SELECT event_id, CASE WHEN x IS NULL OR isnan(x) THEN 0.0 WHEN x = CAST('inf' AS DOUBLE) THEN 1.0 WHEN x = CAST('-inf' AS DOUBLE) THEN -1.0 ELSE x END AS clean FROM e")
def sanitised_vector(spark: SparkSession, d: str) -> DataFrame:
    k = F.pmod(F.col("event_id"), F.lit(5))
    x = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).when(k == 3, None).otherwise(F.col("value"))
    return t(spark, d, "events").select("event_id", sv.sanitised(x).alias("clean"))


@query("horizon_validity", "WITH k AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'UNRESOLVED' WHEN l_returnflag = 'A' THEN 'RESEARCH_4H' WHEN l_quantity >= 23.5 THEN 'VALID_24H' ELSE 'INVALID_MIXED_HORIZON' END AS validity FROM lineitem) SELECT validity, count(*) AS n FROM k GROUP BY 1")
def horizon_validity(spark: SparkSession, d: str) -> DataFrame:
    v = og.horizon_validity(F.col("l_linestatus") != "O", F.when(F.col("l_returnflag") == "A", "research_4h").otherwise("live"), F.col("l_quantity"))
    return t(spark, d, "lineitem").groupBy(v.alias("validity")).agg(F.count("*").alias("n"))


@query("prefix_and_rounding", "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS pr, o_totalprice FROM orders) SELECT o_orderkey, coalesce(starts_with(pr, '1-'), false) AS urgent, round_even(CAST(floor(o_totalprice) AS DOUBLE) / 2, 0) AS half_even, round(CAST(floor(o_totalprice) AS DOUBLE) / 2, 0) AS half_up FROM o")
def prefix_and_rounding(spark: SparkSession, d: str) -> DataFrame:
    """A prefix test in which NULL is false; halves to even and away from zero."""
    o = t(spark, d, "orders").withColumn("pr", F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")))
    half = F.floor("o_totalprice").cast("double") / 2
    return o.select("o_orderkey", F.coalesce(F.col("pr").startswith("1-"), F.lit(False)).alias("urgent"), F.bround(half, 0).alias("half_even"), F.round(half, 0).alias("half_up"))


MODELS = f"{S}, mo AS (SELECT horizon || regime AS model, avg(r + 0.001) / nullif(stddev_samp(r), 0) AS sharpe, count(*) AS n, (avg(pow(r, 3)) - 3 * avg(r) * avg(pow(r, 2)) + 2 * pow(avg(r), 3)) / pow(stddev_pop(r), 3) AS skew, (avg(pow(r, 4)) - 4 * avg(r) * avg(pow(r, 3)) + 6 * pow(avg(r), 2) * avg(pow(r, 2)) - 3 * pow(avg(r), 4)) / pow(stddev_pop(r), 4) AS kurt FROM s GROUP BY 1)"


def models(spark: SparkSession, d: str) -> DataFrame:
    """Returns of each horizon and regime as those of a model: Sharpe ratio, count and population moments."""
    r = F.col("r")
    return scored(spark, d).groupBy(F.concat("horizon", "regime").alias("model")).agg(F.try_divide(F.avg(r + 0.001), F.nullif(F.stddev_samp(r), F.lit(0.0))).alias("sharpe"), F.count("*").alias("n"), F.skewness(r).alias("skew"), (F.kurtosis(r) + 3).alias("kurtosis"))


def _deflated_sql() -> str:
    e9 = fs.expected_maximum(9)
    import math

    root = math.sqrt(2 * math.log(9))
    risk = math.sqrt(0.5) * math.erfc(math.sqrt(1 / 18))
    return f"""WITH {MODELS}, x AS (SELECT *, 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe AS sh, sharpe * sqrt(n) AS tot FROM mo), y AS (SELECT *, (1 + 0.5 * sharpe * sharpe - skew * sharpe + (kurt - 3) / 4 * sharpe * sharpe) / (n - 1) AS va FROM x)
SELECT model, round({q.cdf(f'(sharpe - {risk!r}) / sqrt(sh)')}, 4) AS risk, round({q.cdf(f'(sharpe - {root + fs.EULER / root!r}) / sqrt(greatest(1e-8, va))')}, 4) AS annual, round(sharpe - sqrt(greatest(1e-8, sh / (n - 1))) * {e9!r}, 6) AS haircut,
  round(CASE WHEN tot <= 0 THEN 0 ELSE {q.cdf(f'sharpe / sqrt(greatest(1e-8, sh) / n) - {e9!r}')} END, 4) AS exact, round({q.cdf(f'(sharpe - 0.01 * {e9!r}) / sqrt(va)')}, 4) AS research, CAST(row_number() OVER (ORDER BY sharpe - sqrt(greatest(1e-8, sh / (n - 1))) * {e9!r} DESC, model) AS INTEGER) AS place FROM y"""


@query("deflated_sharpes", _deflated_sql())
def deflated_sharpes(spark: SparkSession, d: str) -> DataFrame:
    """Five deflated Sharpe ratios of each model for nine tries, and the leaderboard by one of them."""
    m = sv.leaderboard(models(spark, d), 9)
    args = (F.col("n"), F.col("skew"), F.col("kurtosis"), 9)
    ratio = lambda v, s="sharpe", **k: fs.deflated_sharpe(F.col(s), *args, v, **k)
    m = m.withColumn("tot", F.col("sharpe") * F.sqrt("n"))
    return m.select("model", F.round(ratio("risk"), 4).alias("risk"), F.round(ratio("annual"), 4).alias("annual"), F.round(ratio("haircut"), 6).alias("haircut"), F.round(ratio("exact", "tot"), 4).alias("exact"), F.round(ratio("research", variance=0.0001), 4).alias("research"), F.col("place").cast("int").alias("place"))


@query("overfitting", f"""
WITH {S}, f AS (SELECT CASE horizon WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END * 2 + CAST(regime = 'O' AS INTEGER) AS genome, l_linenumber % 5 AS fold, avg(r) / nullif(stddev_samp(r), 0) AS sharpe, count(*) AS trades FROM s GROUP BY ALL),
c AS (SELECT a, b FROM range(0, 5) x(a), range(0, 5) y(b) WHERE a < b), e AS (SELECT a, b, genome, avg(CASE WHEN fold IN (a, b) THEN sharpe END) AS i, avg(CASE WHEN fold NOT IN (a, b) THEN sharpe END) AS o, min(trades) AS t FROM f, c GROUP BY ALL),
w AS (SELECT a, b, arg_max(o, {{'i': i, 'g': -genome}}) AS w, quantile_cont(o, 0.5) AS m, min(t) AS t FROM e GROUP BY a, b) SELECT CASE WHEN min(t) >= 30 THEN round(avg(CAST(w < m AS INTEGER)), 6) END AS pbo, CAST(NULL AS DOUBLE) AS pbo_thin FROM w""")
def overfitting(spark: SparkSession, d: str) -> DataFrame:
    """Probability of over-fitting of six genomes over five folds; NULL where a fold is too thin."""
    g = F.when(F.col("horizon") == "A", 0).when(F.col("horizon") == "N", 1).otherwise(2) * 2 + (F.col("regime") == "O").cast("int")
    f = scored(spark, d).groupBy(g.alias("genome"), F.pmod(F.col("l_linenumber"), F.lit(5)).alias("fold")).agg(F.try_divide(F.avg("r"), F.nullif(F.stddev_samp("r"), F.lit(0.0))).alias("sharpe"), F.count("*").alias("trades")).persist()
    thin = fs.probability_of_overfitting(f.withColumn("trades", F.lit(5)), 5).select(F.col("pbo").alias("pbo_thin"))
    return fs.probability_of_overfitting(f, 5).select(R("pbo")).crossJoin(F.broadcast(thin))  # one row


DR = "SELECT d AS draw, (d * 7919 + s * 104729 + d * s * 31) % t AS b FROM t, range(0, 2000) x(d), range(0, 100000) y(s) WHERE s < t"
BLK = f"{S}, k AS (SELECT CAST(ts AS DATE) AS day, p, y FROM s), dy AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS b FROM (SELECT DISTINCT day FROM k)), pc AS (SELECT dy.b // 20 AS b, p, count(*) AS n, sum(y) AS py FROM k JOIN dy USING (day) GROUP BY ALL), t AS (SELECT count(DISTINCT b) AS t FROM pc)"


def _score_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each score in blocks of twenty days: ``b, p, n, py``; scores have few values."""
    s = scored(spark, d).select(F.to_date("ts").alias("day"), "p", "y")
    days = s.select("day").distinct().withColumn("b", F.floor((F.row_number().over(Window.orderBy("day")) - 1) / 20))  # a row a day
    return s.join(days, "day").groupBy("b", "p").agg(F.count("*").alias("n"), F.sum("y").alias("py"))


def _auc_of_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    r = counts.withColumn("rk", F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2)
    pos, neg = F.sum("py"), F.sum(F.col("n") - F.col("py"))
    return r.groupBy(*by).agg(F.try_divide(F.sum(F.col("rk") * F.col("py")) - pos * (pos + 1) / 2, F.nullif(pos * neg, F.lit(0))).alias("auc"))


_AUC = "(sum(rk * py) - sum(py) * (sum(py) + 1) / 2.0) / nullif(sum(py) * (sum(n) - sum(py)), 0)"


@query("auc_bootstrap", f"""
WITH {BLK}, dr AS ({DR}), g AS (SELECT draw, p, sum(n) AS n, sum(py) AS py FROM dr JOIN pc USING (b) GROUP BY ALL), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY draw ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rk FROM g),
a AS (SELECT draw, {_AUC} AS auc FROM r GROUP BY draw) SELECT round(avg(auc), 6) AS mean, round(quantile_cont(CAST(auc AS DOUBLE), 0.025), 5) AS low, round(quantile_cont(CAST(auc AS DOUBLE), 0.975), 5) AS high FROM a""")
def auc_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of an area under the curve: blocks of days are drawn, their counts per score added."""
    a = rs.auc_bootstrap(_score_blocks(spark, d), 2000)
    return a.agg(F.round(F.avg("auc"), 6).alias("mean"), F.round(F.percentile("auc", F.lit(0.025)), 5).alias("low"), F.round(F.percentile("auc", F.lit(0.975)), 5).alias("high"))


@query("auc_permutation", f"""
WITH {S}, dy AS (SELECT CAST(ts AS DATE) AS day, round(avg(p), 6) AS p, CAST(2 * sum(y) >= count(*) AS INTEGER) AS y FROM s GROUP BY 1), z AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () // 24 AS t FROM dy),
w AS (SELECT i, y, i // 24 AS b, i % 24 AS k, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM z WHERE i < t * 24), bl AS (SELECT DISTINCT b FROM w),
pm AS (SELECT d AS draw, b, row_number() OVER (PARTITION BY d ORDER BY (d * 7919 + b * 104729 + d * b * 31) % 1000003, b) - 1 AS slot FROM bl, range(0, 500) x(d)),
c AS (SELECT sum(y) AS pos, count(*) - sum(y) AS neg, sum(rk * y) AS o FROM w), r AS (SELECT draw, sum(place.rk * lab.y) AS o FROM pm JOIN w lab ON lab.b = pm.b JOIN w place ON place.b = pm.slot AND place.k = lab.k GROUP BY draw)
SELECT round(max((c.o - pos * (pos + 1) / 2) / (pos * neg)), 6) AS observed, round(avg((r.o - pos * (pos + 1) / 2) / (pos * neg)), 6) AS mean, round(avg(CAST(r.o >= c.o AS INTEGER)), 6) AS p_value FROM r, c""")
def auc_permutation(spark: SparkSession, d: str) -> DataFrame:
    """The area under the curve of daily forecasts against 500 permutations of their labels in blocks of 24 days."""
    day = scored(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("p"), 6).alias("p"), (2 * F.sum("y") >= F.count("*")).cast("int").alias("y"))
    a = rs.auc_permutation(day, ["day"], 24, 500)
    area = lambda c: F.coalesce(c, F.lit(float("nan")))  # noqa: E731  as SQL divides 0 by 0 where all days' labels are alike
    return a.agg(F.round(F.max(area("observed")), 6).alias("observed"), F.round(F.avg(area("auc")), 6).alias("mean"), F.round(F.avg(F.col("as_high").cast("int")), 6).alias("p_value"))


@query("label_permutation", f"""
WITH {S}, l AS (SELECT p, y, l_orderkey * 10 + l_linenumber AS id FROM s), d AS (SELECT draw, p, count(*) AS n, sum(CAST((id * 7919 + draw * 104729 + id * draw * 31) % 100 < 25 AS INTEGER)) AS py FROM l, range(1, 51) x(draw) GROUP BY ALL UNION ALL SELECT 0, p, count(*), sum(y) FROM l GROUP BY p),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY draw ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rk FROM d), a AS (SELECT draw, {_AUC} AS auc FROM r GROUP BY draw)
SELECT round(max(CASE WHEN draw = 0 THEN auc END), 6) AS observed, round(avg(CASE WHEN draw > 0 THEN CAST(auc >= (SELECT auc FROM a WHERE draw = 0) AS INTEGER) END), 6) AS p_value FROM a""")
def label_permutation(spark: SparkSession, d: str) -> DataFrame:
    """The area under the curve against those of fifty random labellings with a quarter of positives."""
    ids = scored(spark, d).select("p", "y", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    each = ids.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(50).cast("long"))))
    mixed = (F.pmod(F.col("id") * 7919 + F.col("draw") * 104729 + F.col("id") * F.col("draw") * 31, F.lit(100)) < 25).cast("long")
    counts = each.groupBy("draw", "p").agg(F.count("*").alias("n"), F.sum(mixed).alias("py")).unionByName(ids.groupBy(F.lit(0).cast("long").alias("draw"), "p").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("py")))
    a = _auc_of_counts(counts, ["draw"])
    real = a.where("draw = 0").select(F.col("auc").alias("observed"))
    return a.where("draw > 0").crossJoin(F.broadcast(real)).agg(F.round(F.max("observed"), 6).alias("observed"), F.round(F.avg((F.col("auc") >= F.col("observed")).cast("int")), 6).alias("p_value"))  # one row


@query("promotion_gate", f"""WITH {S}, a AS (SELECT horizon AS model, avg(p) * 2 AS dsr, exp(-abs(avg(r)) * sqrt(count(*)) / stddev_samp(r)) AS pv, 100 * max(abs(r)) AS dd, avg((y - p) * (y - p)) AS br FROM s GROUP BY 1), b AS (SELECT * FROM a WHERE model = 'A')
SELECT a.model, a.dsr >= 0.95 AND a.pv < 0.05 AND a.dd <= b.dd + 0.5 AND a.br <= b.br AS promoted FROM a, b""")
def promotion_gate(spark: SparkSession, d: str) -> DataFrame:
    """Each horizon as a candidate against the production model A."""
    r = F.col("r")
    a = scored(spark, d).groupBy(F.col("horizon").alias("model")).agg((F.avg("p") * 2).alias("dsr"), F.exp(-F.abs(F.avg(r)) * F.sqrt(F.count("*").cast("double")) / F.stddev_samp(r)).alias("pv"), (100 * F.max(F.abs(r))).alias("dd"), fm.brier(F.col("p"), F.col("y")).alias("br")).persist()
    b = a.where("model = 'A'").select(F.col("dd").alias("dd0"), F.col("br").alias("br0"))
    return a.crossJoin(F.broadcast(b)).select("model", sv.promotion_gate(F.col("dsr"), F.col("pv"), F.col("dd"), F.col("dd0"), F.col("br"), F.col("br0")).alias("promoted"))  # one row


@query("feature_ranks", """
WITH w AS (SELECT event_type AS model, user_id % 12 AS feature, date_trunc('day', ts) AS step, value FROM events), n AS (SELECT *, dense_rank() OVER (PARTITION BY model ORDER BY step DESC) AS k FROM w), m AS (SELECT model, feature, avg(value) AS mean_weight FROM n WHERE k <= 20 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mean_weight DESC, feature) AS place FROM m), h AS (SELECT model, feature, avg(CASE WHEN k <= 10 THEN value END) AS a, avg(CASE WHEN k BETWEEN 11 AND 20 THEN value END) AS b FROM n GROUP BY ALL), g AS (SELECT * FROM h WHERE a IS NOT NULL AND b IS NOT NULL),
tau AS (SELECT x.model, sum(sign(x.a - z.a) * sign(x.b - z.b)) / nullif(sqrt(sum(abs(sign(x.a - z.a))) * sum(abs(sign(x.b - z.b)))), 0) AS tau FROM g x JOIN g z ON x.model = z.model AND x.feature < z.feature GROUP BY 1)
SELECT r.model, r.feature, CAST(place AS INTEGER) AS place, round(mean_weight, 6) AS mean_weight, round(coalesce(tau, 1), 6) AS stability FROM r JOIN tau USING (model) WHERE place <= 5""")
def feature_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Top five features of each model over its last twenty days, and how stable their ranks are between two halves."""
    w = t(spark, d, "events").select(F.col("event_type").alias("model"), F.pmod(F.col("user_id"), F.lit(12)).alias("feature"), F.to_date("ts").alias("step"), "value")
    top = sv.top_features(w, ["model"], "step", "feature", "value")
    k = F.dense_rank().over(Window.partitionBy("model").orderBy(F.desc("step")))
    days = w.select("model", "step").distinct().withColumn("k", k)  # a row a day
    h = w.join(days, ["model", "step"]).groupBy("model", "feature").agg(F.avg(F.when(F.col("k") <= 10, F.col("value"))).alias("a"), F.avg(F.when(F.col("k").between(11, 20), F.col("value"))).alias("b")).dropna()
    return top.join(sv.kendall_tau(h, ["model"], "feature", "a", "b"), "model").select("model", "feature", F.col("place").cast("int").alias("place"), R("mean_weight"), F.round("tau", 6).alias("stability"))


@query("expert_routing", f"WITH {S}, e AS (SELECT l_orderkey, l_linenumber, [p, x / 50, r * 10 + 0.5, 0.4, l_linenumber / 8.0] AS l FROM s), o AS (SELECT *, list_sort(list_transform(range(1, 6), lambda i: {{'x': CAST(l[i] AS DOUBLE), 'i': -i}}), 'DESC') AS z FROM e), w AS (SELECT *, exp(z[2].x - z[1].x) AS sh FROM o) SELECT l_orderkey, l_linenumber, CAST(-z[1].i - 1 AS INTEGER) AS first, CAST(-z[2].i - 1 AS INTEGER) AS second, round(1 / (1 + sh), 6) AS weight FROM w")
def expert_routing(spark: SparkSession, d: str) -> DataFrame:
    """Softmax over the two strongest of five experts."""
    s = scored(spark, d).withColumn("z", sv.top_two([F.col("p"), F.col("x") / 50, F.col("r") * 10 + 0.5, F.lit(0.4), F.col("l_linenumber") / 8.0]))
    return s.select("l_orderkey", "l_linenumber", F.col("z.first").alias("first"), F.col("z.second").alias("second"), F.round("z.weight", 6).alias("weight"))


@query("forecast_replay", f"WITH {FORECAST} SELECT CASE n % 10 WHEN 3 THEN 'MISMATCH' WHEN 4 THEN 'NOT_REPRODUCED' ELSE 'REPRODUCED' END AS status, count(*) AS n FROM fo GROUP BY 1")
def forecast_replay(spark: SparkSession, d: str) -> DataFrame:
    """Stored forecasts against a recomputation: bars of three ticks were stored wrongly, those of four are gone."""
    f = forecasts(spark, d)
    stored = f.select("symbol", "ts", (F.col("mfe_p50") + F.when(F.pmod("n", F.lit(10)) == 3, 0.01).otherwise(0.0)).alias("mfe_p50"), "mae_p50", "upper_p90")
    return sv.replayed(stored, f.where("n % 10 <> 4"), ["symbol", "ts"], ["mfe_p50", "mae_p50", "upper_p90"]).groupBy("status").agg(F.count("*").alias("n"))


ECON = f"{P}, ec AS (SELECT symbol, ts, CASE WHEN sma >= 0 THEN 1.0 ELSE -1.0 END AS side, fr, vol, n, close FROM (SELECT *, coalesce(close / nullif({q.rolling('avg', 'close', 20)}, 0) - 1, 0) AS sma, ln(lead(close, 24) OVER ({q.W}) / nullif(close, 0)) / 100 AS fr FROM v) WHERE fr IS NOT NULL)"
_STATS = "count(*) AS n, round(avg(net), 6) AS mean_net, round(avg(CAST(net > 0 AS INTEGER)), 6) AS win_rate, round(avg(net) / (stddev_pop(net) + 1e-6) * sqrt(8766), 3) AS sharpe, round(max(dd), 5) AS max_drawdown"


def _econ_sql(source: str, key: str) -> str:
    return f"eq AS (SELECT *, sum(ln(1 + greatest(net, -0.999999))) OVER (PARTITION BY symbol, {key} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS le FROM {source}), ddn AS (SELECT *, 1 - exp(le) / max(exp(le)) OVER (PARTITION BY symbol, {key} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS dd FROM eq)"


def directional(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d).withColumn("sma", F.coalesce(F.try_divide(F.col("close"), fw.sma("close", 20)) - 1, F.lit(0.0))).withColumn("fr", F.ln(F.try_divide(fw.lead("close", 24), F.nullif(F.col("close"), F.lit(0.0)))) / 100)
    return s.where("fr is not null").withColumn("side", F.when(F.col("sma") >= 0, 1.0).otherwise(-1.0))


def _stats(e: DataFrame, *key: str) -> DataFrame:
    return e.select(*key, "n", R("mean_net"), R("win_rate"), R("sharpe", 3), R("max_drawdown", 5))


@query("circuit_breakers", f"""WITH {ECON}, b AS (SELECT *, side * fr - 0.0014 AS net, isodow(ts) IN (3, 5) AND hour(ts) IN (12, 13, 14) AS macro, coalesce(n > 2 * stddev_samp(n) OVER ({q.W} ROWS 167 PRECEDING) + 1e-9 AND count(n) OVER ({q.W} ROWS 167 PRECEDING) >= 24, false) AS fund, coalesce(vol > 1.5, false) AS vs FROM ec),
x AS (SELECT symbol, ts, net, unnest(list_filter(['BASE', CASE WHEN NOT macro THEN 'MACRO' END, CASE WHEN NOT fund THEN 'FUNDING' END, CASE WHEN NOT vs THEN 'VOLATILITY' END, CASE WHEN NOT macro AND NOT fund AND NOT vs THEN 'ALL' END], lambda z: z IS NOT NULL)) AS variant FROM b), {_econ_sql('x', 'variant')}
SELECT symbol, variant, {_STATS} FROM ddn GROUP BY ALL""")
def circuit_breakers(spark: SparkSession, d: str) -> DataFrame:
    """A strategy that rests at releases, at extremes of flow (ticks a bar stand in for funding), in high volatility, or at any."""
    w = fw.BARS.last(168)
    s = directional(spark, d).withColumn("net", F.col("side") * F.col("fr") - 0.0014)
    s = s.withColumn("macro", F.weekday("ts").isin(2, 4) & F.hour("ts").isin(12, 13, 14)).withColumn("fund", F.coalesce((F.col("n") > 2 * F.stddev_samp("n").over(w) + 1e-9) & (F.count("n").over(w) >= 24), F.lit(False))).withColumn("vs", F.coalesce(F.col("vol") > 1.5, F.lit(False)))
    masks = {"BASE": F.lit(False), "MACRO": F.col("macro"), "FUNDING": F.col("fund"), "VOLATILITY": F.col("vs"), "ALL": F.col("macro") | F.col("fund") | F.col("vs")}
    return _stats(sv.circuit_breakers(s, masks, "net", ["symbol"], ["ts"]), "symbol", "variant")


@query("leverage_audit", f"""WITH {ECON}, x AS (SELECT symbol, ts, CAST(l AS DOUBLE) AS leverage, least(n / 5.0, 1) * side * CAST(l AS DOUBLE) * fr - abs(least(n / 5.0, 1) * CAST(l AS DOUBLE)) * 0 - least(n / 5.0, 1) * side * CAST(l AS DOUBLE) * 0.0014 AS net FROM ec, (VALUES (0.25), (0.5), (0.75), (1.0), (1.25), (1.5)) k(l)), {_econ_sql('x', 'leverage')}
SELECT symbol, leverage, {_STATS} FROM ddn GROUP BY ALL""")
def leverage_audit(spark: SparkSession, d: str) -> DataFrame:
    s = directional(spark, d).withColumn("w", F.least(F.col("n") / 5.0, F.lit(1.0)) * F.col("side"))
    return _stats(sv.leverage_sweep(s, "w", "fr", ["symbol"], ["ts"]), "symbol", "leverage")


@query("exposure_quantiles", f"WITH {ECON}, w AS (SELECT symbol, least(n / 5.0, 1) AS w FROM ec) SELECT symbol, round(min(w), 6) AS least, round(quantile_cont(CAST(w AS DOUBLE), 0.25), 6) AS p25, round(quantile_cont(CAST(w AS DOUBLE), 0.5), 6) AS median, round(avg(w), 6) AS mean, round(quantile_cont(CAST(w AS DOUBLE), 0.95), 6) AS p95, round(max(w), 6) AS most, CAST(sum(CAST(w = 0 AS INTEGER)) AS BIGINT) AS idle, CAST(sum(CAST(w > 1 AS INTEGER)) AS BIGINT) AS leveraged FROM w GROUP BY symbol")
def exposure_quantiles(spark: SparkSession, d: str) -> DataFrame:
    w = directional(spark, d).select("symbol", F.least(F.col("n") / 5.0, F.lit(1.0)).alias("w"))
    x = fr.exact_quantiles(w, ["symbol"], "w", {"p25": 0.25, "median": 0.5, "p95": 0.95})
    a = w.groupBy("symbol").agg(F.round(F.min("w"), 6).alias("least"), F.round(F.avg("w"), 6).alias("mean"), F.round(F.max("w"), 6).alias("most"), F.sum((F.col("w") == 0).cast("long")).alias("idle"), F.sum((F.col("w") > 1).cast("long")).alias("leveraged"))
    return a.join(x, "symbol").select("symbol", "least", R("p25"), R("median"), "mean", R("p95"), "most", "idle", "leveraged")


@query("sizing_comparison", f"""WITH {ECON}, z AS (SELECT *, unnest([{{'k': 'fixed', 'w': 1.0}}, {{'k': 'inverse_vol', 'w': least(greatest(0.015 / (vol + 1e-6), 0.2), 2.0)}}, {{'k': 'risk_adjusted', 'w': least(greatest(n / 3.0 - 0.5, 0.0), 2.0)}}]) AS s FROM ec WHERE vol IS NOT NULL), x AS (SELECT symbol, ts, s.k AS scheme, CAST(s.w AS DOUBLE) * fr - CAST(s.w AS DOUBLE) * 0.0014 AS net FROM z), {_econ_sql('x', 'scheme')}
SELECT symbol, scheme, {_STATS}, round(stddev_pop(CASE WHEN net < 0 THEN net END), 6) AS downside FROM ddn GROUP BY ALL""")
def sizing_comparison(spark: SparkSession, d: str) -> DataFrame:
    s = directional(spark, d).where("vol is not null")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), w.cast("double").alias("w")) for k, w in sv.sizing_schemes(F.col("vol"), F.col("n") / 3.0).items()]))
    x = s.withColumn("z", each).select("symbol", "ts", F.col("z.k").alias("scheme"), (F.col("z.w") * F.col("fr") - F.col("z.w") * 0.0014).alias("net"))
    return bt.economics(x, "net", ["symbol", "scheme"], ["ts"]).select("symbol", "scheme", "n", R("mean_net"), R("win_rate"), R("sharpe", 3), R("max_drawdown", 5), R("downside"))


@query("opportunities", f"""
WITH {P}, a AS (SELECT symbol, ts, close AS price, p, CASE WHEN p > 0.5 THEN 'LONG' WHEN p < 0.5 THEN 'SHORT' ELSE 'SKIP' END AS dir, close * CASE WHEN p > 0.5 THEN 1.03 ELSE 0.97 END AS tk, close * CASE WHEN p > 0.5 THEN 0.985 ELSE 1.015 END AS st, ret_1 / 100 AS ex, least(100, n * 20) AS ql FROM v WHERE p IS NOT NULL AND close > 0),
b AS (SELECT *, CASE dir WHEN 'LONG' THEN 1.0 ELSE -1.0 END AS sd FROM a WHERE dir <> 'SKIP'), c AS (SELECT *, sd * (tk - price) / price * 100 AS pf, sd * (price - st) / price * 100 AS rk FROM b), e AS (SELECT *, round(pf / greatest(0.01, rk), 2) AS rr, greatest(pf, abs(coalesce(ex, 0)) * 100) AS pp FROM c),
f AS (SELECT *, least(35, CAST(trunc(abs(p - 0.5) * 2 * 70) AS INTEGER)) + least(35, CAST(trunc(pp * 12) AS INTEGER)) + least(15, CAST(trunc(rr * 5) AS INTEGER)) + least(15, CAST(trunc(ql / 100.0 * 15) AS INTEGER)) AS sc FROM e)
SELECT symbol, ts, dir AS direction, rr AS reward_risk, sc AS score, ((dir = 'LONG' AND p >= 0.54) OR (dir = 'SHORT' AND p <= 0.46)) AND pp >= 1.5 AND rr >= 1.5 AND ql >= 70 OR sc >= 75 AS qualifies, CASE WHEN sc >= 85 AND pp >= 2.5 THEN 'ULTRA_HIGH_PROFIT' WHEN sc >= 75 THEN 'HIGH_CONVICTION' ELSE 'PRIME_SETUP' END AS tier FROM f""")
def opportunities(spark: SparkSession, d: str) -> DataFrame:
    """Signals scored as opportunities; ``cooldown`` spaces the alerts (see ``event_cooldown``)."""
    p, c = F.col("p"), F.col("close")
    s = signals(spark, d).where("p is not null and close > 0")
    s = s.select("symbol", "ts", c.alias("price"), "p", F.when(p > 0.5, "LONG").when(p < 0.5, "SHORT").otherwise("SKIP").alias("direction"), (c * F.when(p > 0.5, 1.03).otherwise(0.97)).alias("take"), (c * F.when(p > 0.5, 0.985).otherwise(1.015)).alias("stop"), F.coalesce(F.col("ret_1") / 100, F.lit(0.0)).alias("expected"), F.least(F.lit(100), F.col("n") * 20).alias("quality"))
    return fc.opportunity(s).select("symbol", T(), "direction", "reward_risk", "score", "qualifies", "tier")


@query("counterfactuals", f"""
WITH {P}, a AS (SELECT symbol, ts, p, vol, CASE WHEN vol > 1.5 THEN 'HIGH_VOLATILITY' WHEN vol < 1 THEN 'TRENDING_BULL' ELSE 'BREAKOUT' END AS rg FROM v WHERE p IS NOT NULL AND vol IS NOT NULL),
b AS (SELECT *, CASE WHEN rg = 'HIGH_VOLATILITY' THEN 'SKIP' WHEN p > 0.53 THEN 'LONG' WHEN p < 0.47 THEN 'SHORT' ELSE 'SKIP' END AS d0, CASE WHEN 2 * (p - 0.5) > 0.1 THEN 'LONG' WHEN 2 * (p - 0.5) < -0.1 THEN 'SHORT' ELSE 'SKIP' END AS d1, CASE WHEN p > 0.54 THEN 'LONG' WHEN p < 0.46 THEN 'SHORT' ELSE 'SKIP' END AS d2,
  CASE WHEN vol > 0 AND CASE WHEN p > 0.54 THEN 1 WHEN p < 0.46 THEN -1 ELSE 0 END * least(0.02 / vol, 2) > 0.1 THEN 'LONG' WHEN vol > 0 AND CASE WHEN p > 0.54 THEN 1 WHEN p < 0.46 THEN -1 ELSE 0 END * least(0.02 / vol, 2) < -0.1 THEN 'SHORT' ELSE 'SKIP' END AS d3 FROM a),
c AS (SELECT *, greatest(len(list_filter([d0, d1, d2, d3], lambda x: x = 'LONG')), len(list_filter([d0, d1, d2, d3], lambda x: x = 'SHORT')), len(list_filter([d0, d1, d2, d3], lambda x: x = 'SKIP'))) / 4.0 AS m FROM b)
SELECT symbol, ts, d0 AS ensemble, d1 AS prob_scaled, d2 AS fixed, d3 AS vol_target, CASE WHEN m >= 0.75 THEN 'HIGH' WHEN m >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS consensus FROM c""")
def counterfactuals(spark: SparkSession, d: str) -> DataFrame:
    """What other sizings would have decided, and how far they agree with the ensemble."""
    s = signals(spark, d).where("p is not null and vol is not null")
    regime = F.when(F.col("vol") > 1.5, "HIGH_VOLATILITY").when(F.col("vol") < 1, "TRENDING_BULL").otherwise("BREAKOUT")
    side = lambda x: F.when(x > 0.1, "LONG").when(x < -0.1, "SHORT").otherwise("SKIP")
    s = s.withColumn("ensemble", fc.ensemble_decision(F.col("p"), regime))
    for k in ("prob_scaled", "fixed", "vol_target"):
        s = s.withColumn(f"d_{k}", side(bt.positions(s, k)))
    every = [F.col("ensemble"), *[F.col(f"d_{k}") for k in ("prob_scaled", "fixed", "vol_target")]]
    return s.select("symbol", T(), "ensemble", *[F.col(f"d_{k}").alias(k) for k in ("prob_scaled", "fixed", "vol_target")], fc.consensus(every).alias("consensus"))


@query("degraded_monitor", "WITH k AS (SELECT coalesce(CASE WHEN CAST(props->>'$.k' AS BIGINT) % 7 = 0 THEN 'DEGRADED' WHEN CAST(props->>'$.k' AS BIGINT) % 11 = 0 THEN 'INVALID' END, 'VALID') AS q FROM events WHERE event_type NOT LIKE 'sign%'), c AS (SELECT count(*) AS total, CAST(sum(CAST(q = 'VALID' AS INT)) AS BIGINT) AS valid, CAST(sum(CAST(q = 'DEGRADED' AS INT)) AS BIGINT) AS degraded, CAST(sum(CAST(q = 'INVALID' AS INT)) AS BIGINT) AS invalid FROM k) SELECT *, round(degraded / total * 100, 2) AS degraded_rate_pct, CASE WHEN degraded / total > 0.01 THEN 'DATA_OPERATIONAL_WARNING' ELSE 'HEALTHY' END AS status FROM c")
def degraded_monitor(spark: SparkSession, d: str) -> DataFrame:
    """Quality from the JSON context of each record that isn't synthetic; without one it is valid."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = t(spark, d, "events").where(~F.col("event_type").like("sign%"))
    return og.degraded_rate(e, F.when(F.pmod(k, F.lit(7)) == 0, "DEGRADED").when(F.pmod(k, F.lit(11)) == 0, "INVALID"))


@query("milestone_gate", "WITH e AS (SELECT date_trunc('day', ts) AS block, CASE WHEN value < 0.5 THEN 'INVALID' WHEN value > 480 THEN 'DEGRADED' ELSE 'VALID' END AS q FROM events), b AS (SELECT block, CASE WHEN bool_or(q = 'INVALID') THEN 'INVALID' WHEN bool_and(q = 'VALID') THEN 'VALID' WHEN bool_and(q = 'DEGRADED') THEN 'DEGRADED' ELSE 'MIXED' END AS bq FROM e GROUP BY 1), c AS (SELECT CAST(sum(CAST(bq = 'VALID' AS INT)) AS BIGINT) AS valid_blocks, CAST(sum(CAST(bq = 'MIXED' AS INT)) AS BIGINT) AS mixed_blocks, CAST(sum(CAST(bq = 'DEGRADED' AS INT)) AS BIGINT) AS degraded_blocks, CAST(sum(CAST(bq = 'INVALID' AS INT)) AS BIGINT) AS invalid_blocks FROM b) SELECT *, CASE WHEN valid_blocks >= 5 THEN 'REVIEW_COMPLETE' ELSE 'WAITING_FOR_BLOCKS' END AS decision, valid_blocks >= 5 AS locked FROM c")
def milestone_gate(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").withColumn("quality", F.when(F.col("value") < 0.5, "INVALID").when(F.col("value") > 480, "DEGRADED").otherwise("VALID"))
    return og.milestone(og.block_quality(e))


@query("stop_rule", f"WITH {S}, d AS (SELECT horizon, CAST(ts AS DATE) AS day, avg(CAST(abs(r) <= 0.03 AS INTEGER)) < 0.75 AS bad FROM s GROUP BY ALL), r AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY horizon ORDER BY day) AS run FROM d), k AS (SELECT *, sum(CAST(bad AS INT)) OVER (PARTITION BY horizon, run ORDER BY day) AS streak FROM r) SELECT horizon, day, CAST(streak AS BIGINT) AS streak, CASE WHEN streak >= 3 THEN 'RESEARCH_TRIGGERED' ELSE 'NO_NEW_RESEARCH_REQUIRED' END AS status FROM k")
def stop_rule(spark: SparkSession, d: str) -> DataFrame:
    """Daily reviews of coverage; three failures in a row trigger research."""
    r = scored(spark, d).groupBy("horizon", F.to_date("ts").alias("day")).agg((F.avg((F.abs("r") <= 0.03).cast("int")) < 0.75).alias("bad"))
    return og.stop_rule(r, ["horizon"], "day", F.col("bad")).select("horizon", "day", "streak", "status")


@query("stress_scenarios", f"""
WITH {q.BARS}, b AS (SELECT symbol, ts, row_number() OVER ({q.W}) - 1 AS f, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) - 1 AS k, close / 1000 AS ema_20, n / 10.0 AS volume, (high - low) / 1000 AS atr, 0.2 AS sentiment FROM bars),
s AS (SELECT *, unnest(['FLASH_CRASH', 'LOW_LIQUIDITY', 'HIGH_VOLATILITY', 'NEWS_SHOCK', 'FUNDING_SPIKE']) AS scenario FROM b)
SELECT symbol, ts, scenario, round(CASE WHEN scenario = 'FLASH_CRASH' AND k < 10 THEN ema_20 - 0.18 WHEN scenario = 'HIGH_VOLATILITY' THEN ema_20 + 0.12 * sin(f * 0.8) WHEN scenario = 'NEWS_SHOCK' AND k < 15 THEN ema_20 - 0.09 WHEN scenario = 'FUNDING_SPIKE' THEN ema_20 + 0.04 ELSE ema_20 END, 6) AS ema_20,
  round(CASE WHEN scenario = 'FLASH_CRASH' AND k < 10 THEN 4.5 WHEN scenario = 'LOW_LIQUIDITY' THEN 0.1 WHEN scenario = 'HIGH_VOLATILITY' THEN 2.8 ELSE volume END, 6) AS volume, round(CASE WHEN scenario = 'FLASH_CRASH' AND k < 10 THEN 0.085 WHEN scenario = 'LOW_LIQUIDITY' THEN 0.008 WHEN scenario = 'HIGH_VOLATILITY' THEN 0.075 WHEN scenario = 'NEWS_SHOCK' AND k < 15 THEN 0.055 ELSE atr END, 6) AS atr,
  round(CASE WHEN scenario = 'FLASH_CRASH' AND k < 10 THEN -0.8 WHEN scenario = 'NEWS_SHOCK' AND k < 15 THEN -0.98 ELSE sentiment END, 6) AS sentiment FROM s""")
def stress_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """Every bar under five shocks."""
    b = ob.bars(spark, d).withColumn("forth", F.row_number().over(fw.BARS.base()) - 1).withColumn("back", F.count("*").over(fw.BARS.whole()) - 1 - F.col("forth"))
    b = b.select("symbol", "ts", "forth", "back", (F.col("close") / 1000).alias("ema_20"), (F.col("n") / 10.0).alias("volume"), ((F.col("high") - F.col("low")) / 1000).alias("atr"), F.lit(0.2).alias("sentiment"))
    names = ["ema_20", "volume", "atr", "sentiment"]
    return sv.stressed(b, "back", "forth", names).select("symbol", T(), "scenario", *map(R, names))


@query("export_round_trip", f"WITH {q.BARS} SELECT symbol, ts, close FROM bars WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def export_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A whitelisted table written, exported for a closed range of time as CSV, and read back with its schema."""
    path = shared_dir(spark)
    ob.bars(spark, d).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "close").write.parquet(f"{path}/bars")
    sinks.export(spark, path, "bars", "2024-01-05", "2024-01-12", f"{path}/out", "csv")
    return scans.csv_back_filled(spark, f"{path}/out", "symbol string, ts timestamp, close double, funding double").drop("funding").select("symbol", T(), "close")


@query("recent_interest", "SELECT event_id, ts, value AS open_interest FROM events WHERE event_type = 'signup' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 29 DAY")
def recent_interest(spark: SparkSession, d: str) -> DataFrame:
    """Open interest of the last 29 days, under whichever name a source gives it."""
    e = t(spark, d, "events")
    rows = scans.coalesced(e.where("event_type = 'signup'"), {"event_id": ["event_id"], "ts": ["timestamp", "ts"], "open_interest": ["openInterest", "value"]})
    return scans.last_days(rows, "ts", 29, e.agg(F.max("ts")).first()[0])
