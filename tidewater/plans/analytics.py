"""Aggregations, metrics, joins, ledgers, sets and orders over the ledger-like tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics as fm
from ..functions import ranks as fr
from ..functions import windows as fw
from ..operators import bars as ob
from ..operators import ledger as og
from ..sources.shared import shared_dir
from . import sql as q
from .registry import query

R = lambda c, n=6: F.round(F.col(c), n).alias(c)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Shipments as scored forecasts: probability, outcome, horizon, return."""
    return t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_linestatus").alias("regime"), F.col("l_returnflag").alias("horizon"),
        (F.col("l_tax") - 0.04).alias("r"), F.col("l_quantity").alias("x"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("price"),
    )


S = "s AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS p, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_linestatus AS regime, l_returnflag AS horizon, l_tax - 0.04 AS r, l_quantity AS x, l_shipdate AS ts, l_extendedprice AS price FROM lineitem)"


@query("regime_accuracy", f"WITH {S} SELECT regime, round(avg(CAST((p >= 0.5) = (y = 1) AS INTEGER)), 6) AS accuracy, count(y) AS n FROM s GROUP BY regime")
def regime_accuracy(spark: SparkSession, d: str) -> DataFrame:
    hit = ((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int")
    return scored(spark, d).groupBy("regime").agg(F.round(F.avg(hit), 6).alias("accuracy"), F.count("y").alias("n"))


@query("horizon_summary", f"WITH {S} SELECT horizon, count(*) AS n, round(avg(CAST(r > 0 AS INTEGER)), 6) AS win_rate, round(sum(r), 4) AS total, round(avg(r), 6) AS mean FROM s GROUP BY horizon")
def horizon_summary(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("horizon").agg(F.count("*").alias("n"), F.round(F.avg((F.col("r") > 0).cast("int")), 6).alias("win_rate"), F.round(F.sum("r"), 4).alias("total"), F.round(F.avg("r"), 6).alias("mean"))


@query("confidence_buckets", f"WITH {S} SELECT CASE WHEN p > 0 AND p <= 0.25 THEN '(0,0.25]' WHEN p <= 0.5 AND p > 0.25 THEN '(0.25,0.5]' WHEN p > 0.5 AND p <= 0.75 THEN '(0.5,0.75]' WHEN p > 0.75 AND p <= 1 THEN '(0.75,1]' END AS bucket, count(*) AS n, round(avg(y), 6) AS rate FROM s GROUP BY 1 HAVING bucket IS NOT NULL")
def confidence_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Right-closed buckets; what is in none is dropped."""
    p, b = F.col("p"), F.lit(None).cast("string")
    for lo, hi, name in ((0, 0.25, "(0,0.25]"), (0.25, 0.5, "(0.25,0.5]"), (0.5, 0.75, "(0.5,0.75]"), (0.75, 1, "(0.75,1]")):
        b = F.when((p > lo) & (p <= hi), name).otherwise(b)
    return scored(spark, d).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("rate")).where("bucket is not null")


@query("grouping_sets", f"WITH {S} SELECT regime, horizon, dayofweek(ts) AS dow, count(*) AS n, round(avg(r), 6) AS mean FROM s GROUP BY GROUPING SETS ((regime), (horizon), (dayofweek(ts)), ())")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).withColumn("dow", (F.dayofweek("ts") - 1).cast("long"))
    return s.groupingSets([["regime"], ["horizon"], ["dow"], []], "regime", "horizon", "dow").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean"))


@query("monthly_auc", f"""
WITH {S}, m AS (SELECT *, strftime(ts, '%Y-%m') AS month FROM s), k AS (SELECT month, y, rank() OVER (PARTITION BY month ORDER BY p) + (count(*) OVER (PARTITION BY month, p) - 1) / 2.0 AS r FROM m)
SELECT month, count(*) AS n, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auc FROM k GROUP BY month HAVING count(*) > 40""")
def monthly_auc(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).withColumn("month", F.date_format("ts", "yyyy-MM"))
    out = fm.auc(s, "p", "y", ("month",)).withColumn("n", F.col("positives") + F.col("negatives"))
    return out.where("n > 40").select("month", "n", R("auc"))


@query("monthly_ic", f"""
WITH {S}, m AS (SELECT *, strftime(ts, '%Y-%m') AS month FROM s), k AS (SELECT month, rank() OVER (PARTITION BY month ORDER BY p) + (count(*) OVER (PARTITION BY month, p) - 1) / 2.0 AS a, rank() OVER (PARTITION BY month ORDER BY x) + (count(*) OVER (PARTITION BY month, x) - 1) / 2.0 AS b FROM m),
c AS (SELECT month, count(*) AS n, corr(a, b) AS ic FROM k GROUP BY month HAVING count(*) > 40)
SELECT month, n, round(ic, 6) AS ic, round(avg(ic) OVER (), 6) AS mean_ic, round(avg(ic) OVER () / nullif(stddev_samp(ic) OVER (), 0), 5) AS information_ratio FROM c""")
def monthly_ic(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of forecast and outcome for each month, their mean and its ratio to their deviation."""
    s = scored(spark, d).withColumn("month", F.date_format("ts", "yyyy-MM"))
    ic = fm.spearman(s, "p", "x", ("month",)).where("n > 40")
    whole = ic.agg(F.avg("ic").alias("_m"), F.stddev_samp("ic").alias("_d"))
    return ic.crossJoin(F.broadcast(whole)).select("month", "n", R("ic"), F.round("_m", 6).alias("mean_ic"), F.round(F.try_divide("_m", F.nullif("_d", F.lit(0.0))), 5).alias("information_ratio"))  # one row


@query("global_auc", f"WITH {S}, k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM s) SELECT CAST(sum(y) AS BIGINT) AS positives, CAST(count(*) - sum(y) AS BIGINT) AS negatives, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auc FROM k")
def global_auc(spark: SparkSession, d: str) -> DataFrame:
    return fm.auc(scored(spark, d), "p", "y").select("positives", "negatives", R("auc"))


@query("spearman_ic", f"WITH {S}, k AS (SELECT horizon, rank() OVER (PARTITION BY horizon ORDER BY x) + (count(*) OVER (PARTITION BY horizon, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY horizon ORDER BY r) + (count(*) OVER (PARTITION BY horizon, r) - 1) / 2.0 AS b FROM s) SELECT horizon, round(corr(a, b), 6) AS ic, count(*) AS n FROM k GROUP BY horizon")
def spearman_ic(spark: SparkSession, d: str) -> DataFrame:
    return fm.spearman(scored(spark, d), "x", "r", ("horizon",)).select("horizon", R("ic"), "n")


@query("reliability_bins", f"WITH {S} SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate, count(*) AS n FROM s GROUP BY 1")
def reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    return fm.reliability(scored(spark, d), "p", "y").select("bin", R("mean_p"), R("rate"), "n")


@query("calibration_error", f"WITH {S}, b AS (SELECT CASE WHEN p < 1 THEN floor(p * 10) END AS bin, avg(p) AS m, avg(y) AS r, count(*) AS n FROM s GROUP BY 1) SELECT round(sum(CASE WHEN bin IS NOT NULL THEN n * abs(m - r) END) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b")
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return fm.calibration_error(scored(spark, d), "p", "y").select(R("ece"), "n")


@query("brier_pinball_winkler", f"WITH {S} SELECT round(avg((y - p) * (y - p)), 6) AS brier, round(avg(greatest(0.1 * (r - 0.01), -0.9 * (r - 0.01))), 6) AS pinball_10, round(avg(greatest(0.9 * (r - 0.01), -0.1 * (r - 0.01))), 6) AS pinball_90, round(avg(0.04 + CASE WHEN r < -0.02 THEN 10 * (-0.02 - r) WHEN r > 0.02 THEN 10 * (r - 0.02) ELSE 0 END), 6) AS winkler, round(avg(0.04 + 2 * greatest(-0.02 - r, r - 0.02, 0)), 6) AS winkler_flat FROM s")
def brier_pinball_winkler(spark: SparkSession, d: str) -> DataFrame:
    r, lo, hi = F.col("r"), F.lit(-0.02), F.lit(0.02)
    return scored(spark, d).agg(
        F.round(fm.brier(F.col("p"), F.col("y")), 6).alias("brier"), F.round(fm.pinball(r, F.lit(0.01), 0.1), 6).alias("pinball_10"), F.round(fm.pinball(r, F.lit(0.01), 0.9), 6).alias("pinball_90"),
        F.round(F.avg(fm.winkler(r, lo, hi)), 6).alias("winkler"), F.round(F.avg(fm.winkler_flat(r, lo, hi)), 6).alias("winkler_flat"),
    )


@query("regime_transitions", f"""
WITH {q.BARS}, g AS (SELECT symbol, ts, CASE WHEN close > open THEN 'UP' WHEN close < open THEN 'DOWN' ELSE 'FLAT' END AS a FROM bars), l AS (SELECT symbol, a, lead(a) OVER (PARTITION BY symbol ORDER BY ts) AS b FROM g)
SELECT symbol, a, b, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY symbol, a), 6) AS share FROM l WHERE b IS NOT NULL GROUP BY symbol, a, b""")
def regime_transitions(spark: SparkSession, d: str) -> DataFrame:
    a = F.when(F.col("close") > F.col("open"), "UP").when(F.col("close") < F.col("open"), "DOWN").otherwise("FLAT")
    b = ob.bars(spark, d).withColumn("a", a).withColumn("b", fw.lead("a")).where("b is not null")
    n = b.groupBy("symbol", "a", "b").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("symbol", "a")), 6))


@query("last_n_summaries", f"WITH {S}, k AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM s) SELECT horizon, " + ", ".join(f"CASE WHEN count(*) >= {n} THEN round(avg(CASE WHEN rn <= {n} THEN r END), 6) END AS mean_{n}, CASE WHEN count(*) >= {n} THEN 'OK' ELSE 'INSUFFICIENT' END AS status_{n}" for n in (25, 50, 100, 250)) + " FROM k GROUP BY horizon")
def last_n_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Only the newest 250 of a group are ranked: the limit is applied before the shuffle as well."""
    w = Window.partitionBy("horizon").orderBy(F.desc("ts"), F.desc("l_orderkey"), F.desc("l_linenumber"))
    s = scored(spark, d)
    k = s.withColumn("rn", F.row_number().over(w)).where("rn <= 250").join(F.broadcast(s.groupBy("horizon").agg(F.count("*").alias("total"))), "horizon")  # a row a horizon
    out = []
    for n in (25, 50, 100, 250):
        enough = F.max("total") >= n
        out += [F.when(enough, F.round(F.avg(F.when(F.col("rn") <= n, F.col("r"))), 6)).alias(f"mean_{n}"), F.when(enough, "OK").otherwise("INSUFFICIENT").alias(f"status_{n}")]
    return k.groupBy("horizon").agg(*out)


@query("quantile_table", f"WITH {S} SELECT horizon, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.9), 6) AS p90, round(quantile_cont(CAST(price AS DOUBLE), 0.99), 6) AS price_p99 FROM s GROUP BY horizon")
def quantile_table(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles with linear interpolation."""
    s = scored(spark, d)
    x = fr.exact_quantiles(s, ["horizon"], "x", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return x.join(fr.exact_quantiles(s, ["horizon"], "price", {"price_p99": 0.99}), "horizon").select("horizon", R("p10"), R("p50"), R("p90"), R("price_p99"))


@query("quantile_calibration", f"WITH {S}, u AS (SELECT r, unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS q, unnest([-0.03, -0.02, 0.0, 0.02, 0.03]) AS f FROM s) SELECT CAST(q AS DOUBLE) AS q, round(avg(CAST(r <= f AS INTEGER)), 6) AS coverage, round(avg(CAST(r <= f AS INTEGER)) - CAST(q AS DOUBLE), 6) AS coverage_error, round(avg(greatest(q * (r - f), (q - 1) * (r - f))), 6) AS pinball FROM u GROUP BY q")
def quantile_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Quantile columns unpivoted, then one group per quantile."""
    u = scored(spark, d).select("r", F.expr("stack(5, 0.1D, -0.03D, 0.25D, -0.02D, 0.5D, 0.0D, 0.75D, 0.02D, 0.9D, 0.03D) AS (q, f)"))
    cov, e = F.avg((F.col("r") <= F.col("f")).cast("int")), F.col("r") - F.col("f")
    return u.groupBy("q").agg(F.round(cov, 6).alias("coverage"), F.round(cov - F.col("q"), 6).alias("coverage_error"), F.round(F.avg(F.greatest(F.col("q") * e, (F.col("q") - 1) * e)), 6).alias("pinball"))


@query("regime_coverage", f"WITH {S} SELECT regime, horizon, count(*) AS n, round(avg(CAST(r BETWEEN -0.03 AND 0.03 AS INTEGER)), 6) AS coverage_80, round(avg(CAST(r BETWEEN -0.03 AND 0.03 AS INTEGER)) - 0.8, 6) AS coverage_error FROM s GROUP BY ALL HAVING count(*) >= 10")
def regime_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of the 80 % interval (P10 to P90) in each regime and horizon of ten forecasts or more."""
    inside = F.avg(F.col("r").between(-0.03, 0.03).cast("int"))
    a = scored(spark, d).groupBy("regime", "horizon").agg(F.count("*").alias("n"), inside.alias("_c")).where("n >= 10")
    return a.select("regime", "horizon", "n", F.round("_c", 6).alias("coverage_80"), F.round(F.col("_c") - 0.8, 6).alias("coverage_error"))


@query("univariate_auc", f"""
WITH {S}, u AS (SELECT unnest([{{'feature': 'x', 'v': x}}, {{'feature': 'p', 'v': p}}, {{'feature': 'r', 'v': r}}, {{'feature': 'price', 'v': price}}], recursive := true), y FROM s),
k AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS rk FROM u),
a AS (SELECT feature, (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc FROM k GROUP BY feature)
SELECT feature, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS strength, rank() OVER (ORDER BY round(greatest(auc, 1 - auc), 6) DESC) AS rank FROM a""")
def univariate_auc(spark: SparkSession, d: str) -> DataFrame:
    """Area under the curve of each feature alone, and which tells most whatever its direction."""
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in ("x", "p", "r", "price")])
    a = fm.auc(scored(spark, d).select("y", F.explode(parts).alias("f")).select("y", "f.*"), "v", "y", ("feature",))
    strength = F.round(F.greatest("auc", 1 - F.col("auc")), 6)
    return a.select("feature", R("auc"), strength.alias("strength")).withColumn("rank", F.rank().over(Window.orderBy(F.desc("strength"))).cast("long"))  # a row a feature


@query("confusion_metrics", f"""
WITH {S}, c AS (SELECT horizon AS y, CASE WHEN p < 0.3 THEN 'A' WHEN p < 0.6 THEN 'N' ELSE 'R' END AS p, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT DISTINCT y AS k FROM c UNION SELECT DISTINCT p FROM c),
m AS (SELECT k, coalesce((SELECT sum(n) FROM c WHERE y = k), 0) AS t, coalesce((SELECT sum(n) FROM c WHERE p = k), 0) AS s, coalesce((SELECT sum(n) FROM c WHERE y = k AND p = k), 0) AS c FROM k),
e AS (SELECT *, coalesce(c / nullif(s, 0), 0) AS pr, coalesce(c / nullif(t, 0), 0) AS re FROM m)
SELECT round(sum(c) / sum(t), 6) AS accuracy, round(avg(re) FILTER (t > 0), 6) AS balanced_accuracy, round(avg(pr), 6) AS precision, round(avg(re), 6) AS recall, round(avg(coalesce(2 * pr * re / nullif(pr + re, 0), 0)), 6) AS f1,
  round((CAST(sum(c) AS DOUBLE) * sum(t) - sum(t * s)) / nullif(sqrt((CAST(sum(t) AS DOUBLE) * sum(t) - sum(t * t)) * (CAST(sum(t) AS DOUBLE) * sum(t) - sum(s * s))), 0), 6) AS mcc FROM e""")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).withColumn("guess", F.when(F.col("p") < 0.3, "A").when(F.col("p") < 0.6, "N").otherwise("R"))
    return fm.confusion(s, "horizon", "guess").select(*map(R, ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "mcc")))


@query("entropy_and_mi", f"""
WITH {S}, h AS (SELECT count(*) / sum(count(*)) OVER () AS p FROM s GROUP BY horizon), j AS (SELECT horizon, regime, count(*) AS n FROM s GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY horizon) AS a, sum(n) OVER (PARTITION BY regime) AS b, sum(n) OVER () AS t FROM j)
SELECT (SELECT round(-sum(p * log2(p)), 6) FROM h) AS bits, (SELECT round(-sum(p * log2(p)) / log2(count(*)), 6) FROM h) AS normalised, (SELECT round(sum(n / t * ln(n * t / (a * b))), 6) FROM m) AS mi""")
def entropy_and_mi(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    return fm.entropy(s, "horizon").crossJoin(fm.mutual_information(s, "horizon", "regime")).select(R("bits"), R("normalised"), R("mi"))


_TAIL = "greatest(0, least(1, CASE WHEN lam < 0.2 THEN 1 ELSE 2 * list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * lam * lam))) END))"
_STATUS = "CASE WHEN p < 0.01 THEN 'ALERT' WHEN p < 0.05 THEN 'WATCH' ELSE 'NORMAL' END"


@query("ks_drift", f"""
WITH {S}, u AS (SELECT unnest([{{'f': 'x', 'v': x}}, {{'f': 'p', 'v': p}}, {{'f': 'r', 'v': r * 100}}, {{'f': 'price', 'v': price}}], recursive := true), horizon, regime, 100 * extract(year FROM ts) + extract(month FROM ts) AS month FROM s),
z AS (SELECT f, v, month <= 199806 AS base FROM u WHERE month BETWEEN 199804 AND 199808 AND month <> 199807), v AS (SELECT f, v, sum(CAST(base AS INTEGER)) AS a, sum(CAST(NOT base AS INTEGER)) AS b FROM z GROUP BY ALL),
c AS (SELECT f, sum(a) OVER g AS n, sum(b) OVER g AS m, abs(sum(a) OVER o / sum(a) OVER g - sum(b) OVER o / sum(b) OVER g) AS d FROM v WINDOW g AS (PARTITION BY f), o AS (PARTITION BY f ORDER BY v)),
k AS (SELECT f, max(n) AS n, max(m) AS m, max(d) AS d, sqrt(max(n) * max(m) / (max(n) + max(m))) * max(d) AS lam FROM c GROUP BY f), h AS (SELECT f, avg(v) FILTER (WHERE base) AS mb, avg(v) FILTER (WHERE NOT base) AS mc FROM z GROUP BY f),
q AS (SELECT *, CASE WHEN least(n, m) < 15 THEN 1 ELSE {_TAIL} END AS p, abs(mc - mb) / greatest(mb, 1e-4) AS shift FROM k JOIN h USING (f))
SELECT f AS feature, CAST(n AS BIGINT) AS n_base, CAST(m AS BIGINT) AS n_current, CASE WHEN least(n, m) < 15 THEN 0 ELSE round(d, 6) END AS ks, round(p, 6) AS p_value, {_STATUS} AS status, round(shift, 6) AS mean_shift, CASE WHEN shift > 0.4 THEN 'ALERT' WHEN shift > 0.2 THEN 'WATCH' ELSE 'NORMAL' END AS shift_status FROM q""")
def ks_drift(spark: SparkSession, d: str) -> DataFrame:
    """Drift of four features between a quarter and the month after next: distance, p-value, status, mean shift."""
    month = F.year("ts") * 100 + F.month("ts")
    s = scored(spark, d).withColumn("month", month).where("month between 199804 and 199808 and month <> 199807")
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) * k).cast("double").alias("value")) for c, k in (("x", 1), ("p", 1), ("r", 100), ("price", 1))])
    rows = s.select((F.col("month") <= 199806).alias("base"), F.explode(parts).alias("f")).select("base", "f.*")
    out = fm.drift(rows.where("base"), rows.where("not base"), "value", ("feature",))
    return out.select("feature", "n_base", "n_current", R("ks"), R("p_value"), "status", R("mean_shift"), "shift_status")


@query("event_shocks", f"""
WITH {q.BARS}, f AS (SELECT *, ln(lead(close) OVER ({q.W}) / nullif(close, 0)) AS nxt, (volume - {q.rolling('avg', 'volume', 24)}) / nullif({q.rolling('stddev_samp', 'volume', 24)}, 0) AS z FROM bars),
m AS (SELECT nxt, unnest(list_filter([CASE WHEN z > 2 THEN 'VOLUME_SPIKE' END, CASE WHEN high / nullif(low, 0) > 5 THEN 'WIDE_RANGE' END, CASE WHEN n >= 6 THEN 'BUSY' END, CASE WHEN close > open THEN 'UP_BAR' END, CASE WHEN close < open THEN 'DOWN_BAR' END], lambda x: x IS NOT NULL)) AS shock FROM f WHERE nxt IS NOT NULL)
SELECT shock, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(avg(abs(nxt)), 6) END AS mean_move, CASE WHEN count(*) >= 20 THEN round(avg(CAST(nxt > 0 AS INTEGER)), 6) END AS hit_rate FROM m GROUP BY shock""")
def event_shocks(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping event masks: a row belongs to several groups; small groups are suppressed."""
    f = ob.bars(spark, d).withColumn("nxt", F.ln(F.try_divide(fw.lead("close"), F.col("close")))).withColumn("z", fw.zscore("volume", 24)).where("nxt is not null")
    masks = F.array(F.when(F.col("z") > 2, "VOLUME_SPIKE"), F.when(F.try_divide(F.col("high"), F.col("low")) > 5, "WIDE_RANGE"), F.when(F.col("n") >= 6, "BUSY"), F.when(F.col("close") > F.col("open"), "UP_BAR"), F.when(F.col("close") < F.col("open"), "DOWN_BAR"))
    m = f.select("nxt", F.explode(F.filter(masks, lambda x: x.isNotNull())).alias("shock"))
    some = F.count("*") >= 20
    return m.groupBy("shock").agg(F.count("*").alias("n"), F.when(some, F.round(F.avg(F.abs("nxt")), 6)).alias("mean_move"), F.when(some, F.round(F.avg((F.col("nxt") > 0).cast("int")), 6)).alias("hit_rate"))


@query("parameter_ladder", f"WITH {S} SELECT CAST(c AS DOUBLE) AS cost, CAST(h AS DOUBLE) AS least_p, count(*) AS n, round(avg(CAST(r - c > 0 AS INTEGER)), 6) AS win_rate, round(sum(r - c), 4) AS net, round(sum(CASE WHEN r > c THEN r - c ELSE 0 END) / nullif(sum(CASE WHEN r < c THEN c - r ELSE 0 END), 0), 6) AS profit_factor FROM s, (VALUES (0.0), (0.005), (0.01)) k(c), (VALUES (0.3), (0.6), (0.9)) g(h) WHERE p >= h GROUP BY ALL")
def parameter_ladder(spark: SparkSession, d: str) -> DataFrame:
    """A literal grid of thresholds and costs (nine rows) against every forecast."""
    grid = spark.createDataFrame([(c, h) for c in (0.0, 0.005, 0.01) for h in (0.3, 0.6, 0.9)], "cost double, least_p double")
    s = scored(spark, d).crossJoin(F.broadcast(grid)).where("p >= least_p").withColumn("net", F.col("r") - F.col("cost"))
    up, down = F.sum(F.when(F.col("net") > 0, F.col("net")).otherwise(0.0)), F.sum(F.when(F.col("net") < 0, -F.col("net")).otherwise(0.0))
    return s.groupBy("cost", "least_p").agg(F.count("*").alias("n"), F.round(F.avg((F.col("net") > 0).cast("int")), 6).alias("win_rate"), F.round(F.sum("net"), 4).alias("net"), F.round(F.try_divide(up, F.nullif(down, F.lit(0.0))), 6).alias("profit_factor"))


@query("worst_days", f"WITH {S}, d AS (SELECT CAST(ts AS DATE) AS day, sum(CAST(round(r * 100) AS BIGINT)) AS pnl FROM s GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY pnl, day) AS rn, count(*) OVER () AS n FROM d), w AS (SELECT day FROM k WHERE rn <= ceil(n * 0.1)) SELECT horizon, count(*) AS n, round(avg(r), 6) AS mean FROM s SEMI JOIN w ON CAST(s.ts AS DATE) = w.day GROUP BY horizon")
def worst_days(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts on the worst tenth of days: aggregate, top-k, semi-join."""
    s = scored(spark, d).withColumn("day", F.to_date("ts"))
    days = s.groupBy("day").agg(F.sum(F.round(F.col("r") * 100).cast("long")).alias("pnl"))
    share = days.agg(F.ceil(F.count("*") * 0.1).alias("k")).first()["k"]
    worst = days.orderBy("pnl", "day").limit(int(share)).select("day")
    return s.join(worst, "day", "left_semi").groupBy("horizon").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean"))


@query("prefix_progress", f"WITH {S}, b AS (SELECT CAST(ts AS DATE) AS day, avg(r) AS r FROM s GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY day) AS id, count(*) OVER () AS n FROM b) SELECT step AS step, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS dev FROM k, LATERAL (SELECT unnest([5, 10, 20, 30, n]) AS step) g WHERE id <= step GROUP BY step")
def prefix_progress(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates over the first 5 to 30 daily blocks, and over all."""
    b = scored(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.avg("r").alias("r"))
    k = b.withColumn("id", F.row_number().over(Window.orderBy("day"))).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))  # a row a day
    steps = k.withColumn("step", F.explode(F.array_union(F.array(*[F.lit(x).cast("long") for x in (5, 10, 20, 30)]), F.array("n"))))
    return steps.where("id <= step").groupBy("step").agg(F.round(F.avg("r"), 6).alias("mean"), F.round(F.stddev_samp("r"), 6).alias("dev"))


@query("value_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# --- joins, ledger, sets, orders -----------------------------------------------------------
@query("forecast_outcome_join", "SELECT o_orderkey, o_totalprice, count(l_linenumber) AS parts, round(sum(l_extendedprice), 2) AS shipped FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def forecast_outcome_join(spark: SparkSession, d: str) -> DataFrame:
    o, li = t(spark, d, "orders"), t(spark, d, "lineitem")
    agg = li.groupBy("l_orderkey").agg(F.count("l_linenumber").alias("parts"), F.round(F.sum("l_extendedprice"), 2).alias("shipped"))
    return o.join(agg, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_totalprice", "parts", "shipped")


@query("interval_join", "SELECT o_orderkey, count(*) AS n, round(max(l_extendedprice), 2) AS most, round(min(l_extendedprice), 2) AS least FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 30 DAY GROUP BY o_orderkey")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes in (t, t + 30 days] of their forecast."""
    o, li = t(spark, d, "orders"), t(spark, d, "lineitem")
    j = o.join(li, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate")) & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("interval 30 days")))
    return j.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.round(F.max("l_extendedprice"), 2).alias("most"), F.round(F.min("l_extendedprice"), 2).alias("least"))


# --- resolution of forecasts ----------------------------------------------------------------
@query("range_resolution", f"""
WITH {q.BARS}, f AS (SELECT event_id AS forecast_id, event_type AS symbol, ts AS made_at, value AS price FROM events),
o AS (SELECT forecast_id, max(high) AS hi, min(low) AS lo, arg_max(close, b.ts) AS c, count(*) AS n FROM f JOIN bars b ON f.symbol = b.symbol AND b.ts > made_at AND b.ts <= made_at + INTERVAL 24 HOUR GROUP BY 1)
SELECT forecast_id, round(hi / nullif(price, 0) - 1, 6) AS mfe, round(1 - lo / nullif(price, 0), 6) AS mae, c AS window_close, n AS window_bars, n IS NOT NULL AS resolved, CAST(hi <= price * 4 AS INTEGER) AS upper_covered, CAST(lo >= price / 4 AS INTEGER) AS lower_covered, CAST(hi <= price * 4 AND lo >= price / 4 AS INTEGER) AS path_contained FROM f LEFT JOIN o USING (forecast_id)""")
def range_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Every event is a forecast of a range of a quarter to four times its price; all are resolved."""
    f = t(spark, d, "events").select(F.col("event_id").alias("forecast_id"), F.col("event_type").alias("symbol"), F.col("ts").alias("made_at"), F.col("value").alias("price"))
    up, low = F.col("window_high") <= F.col("price") * 4, F.col("window_low") >= F.col("price") / 4
    out = og.resolve(f, ob.bars(spark, d), 24, ["symbol"]).withColumn("upper_covered", up.cast("int")).withColumn("lower_covered", low.cast("int")).withColumn("path_contained", (up & low).cast("int"))
    return out.select("forecast_id", R("mfe"), R("mae"), "window_close", "window_bars", "resolved", "upper_covered", "lower_covered", "path_contained")


@query("orphans_and_semi", "SELECT c_custkey, 'orphan' AS kind FROM customer ANTI JOIN orders ON c_custkey = o_custkey UNION ALL SELECT c_custkey, 'active' FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
def orphans_and_semi(spark: SparkSession, d: str) -> DataFrame:
    c, o = t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return og.orphans(c, o, ["c_custkey"]).withColumn("kind", F.lit("orphan")).unionByName(c.join(o, "c_custkey", "left_semi").withColumn("kind", F.lit("active")))


@query("lookup_map", "SELECT o_orderpriority, count(*) AS n, CASE left(o_orderpriority, 1) WHEN '1' THEN 'HIGH_VOLATILITY' WHEN '2' THEN 'BREAKOUT' WHEN '3' THEN 'RANGING' WHEN '4' THEN 'BULL' WHEN '5' THEN 'BEAR' END AS regime FROM orders GROUP BY ALL")
def lookup_map(spark: SparkSession, d: str) -> DataFrame:
    """Vocabulary map; an unknown word is a hard error."""
    names = F.create_map(*[F.lit(x) for kv in {"1": "HIGH_VOLATILITY", "2": "BREAKOUT", "3": "RANGING", "4": "BULL", "5": "BEAR"}.items() for x in kv])
    regime = F.coalesce(F.element_at(names, F.substring("o_orderpriority", 1, 1)), F.raise_error(F.concat(F.lit("unknown regime "), "o_orderpriority")))
    return t(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn("regime", regime)


@query("overlap_uniqueness", f"""
WITH {q.BARS}, l AS (SELECT symbol, ts AS t0, ts + INTERVAL (1 + n % 6) HOUR AS t1 FROM bars)
SELECT a.symbol, a.t0, count(*) AS overlaps, round(1.0 / count(*), 6) AS uniqueness FROM l a JOIN l b ON a.symbol = b.symbol AND b.t0 <= a.t1 AND b.t1 >= a.t0 GROUP BY ALL""")
def overlap_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import validation as ov

    return ov.uniqueness(ob.bars(spark, d).select("symbol", F.col("ts").alias("t0"), F.expr("ts + make_interval(0, 0, 0, 0, CAST(1 + n % 6 AS INT))").alias("t1")), ["symbol"], 6).select("symbol", F.col("t0").cast("timestamp_ntz").alias("t0"), "overlaps", R("uniqueness"))


@query("lineage_recursive", "WITH RECURSIVE r AS (SELECT c_custkey AS id, c_custkey AS node, 0 AS depth FROM customer UNION ALL SELECT id, node // 2, depth + 1 FROM r WHERE node > 1 AND depth < 8) SELECT id, max(depth) AS depth, min(node) AS ancestor FROM r GROUP BY id")
def lineage_recursive(spark: SparkSession, d: str) -> DataFrame:
    """First parents of every node followed to a depth limit, which also ends cycles."""
    nodes = t(spark, d, "customer").select("c_custkey")
    text = "WITH RECURSIVE r (id, at, depth) AS (SELECT c_custkey, c_custkey, 0 FROM {nodes} UNION ALL SELECT id, at div 2, depth + 1 FROM r WHERE at > 1 AND depth < 8) SELECT id, max(depth) AS depth, min(at) AS ancestor FROM r GROUP BY id"
    limit = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(limit, "-1")
    return spark.sql(text, nodes=nodes)


@query("upsert_latest", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM k WHERE rn = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return og.latest(t(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("insert_if_absent", "SELECT c_custkey, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer")
    table = c.where("c_custkey % 2 = 0").select("c_custkey", F.col("c_name").alias("name"))
    return og.insert_new(table, c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("name")), ["c_custkey"])


@query("keyed_update", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def keyed_update(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changes = o.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice"))
    return og.update(o, changes, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query("predicate_delete", "SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT (o_orderpriority LIKE '1-%' OR o_orderstatus = 'P')")
def predicate_delete(spark: SparkSession, d: str) -> DataFrame:
    return og.delete(t(spark, d, "orders"), F.col("o_orderpriority").like("1-%") | (F.col("o_orderstatus") == "P")).select("o_orderkey", "o_orderpriority")


@query("record_audit", """
WITH k AS (SELECT *, l_partkey % 50 AS id, l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS seq FROM lineitem), o AS (SELECT l_suppkey, list({'id': id, 'ts': l_shipdate, 'seq': seq} ORDER BY l_shipdate, seq) AS log FROM k GROUP BY 1),
f AS (SELECT l_suppkey, list_reduce(list_prepend({'ids': [-1], 'tss': [TIMESTAMP '1900-01-01'], 'kept': [CAST(-1 AS BIGINT)], 'x': log[1]}, list_transform(log, lambda e: {'ids': [-1], 'tss': [TIMESTAMP '1900-01-01'], 'kept': [CAST(-1 AS BIGINT)], 'x': e})),
  lambda a, b: CASE WHEN list_contains(a.ids, b.x.id) OR list_contains(a.tss, CAST(b.x.ts AS TIMESTAMP)) THEN a ELSE {'ids': list_append(a.ids, b.x.id), 'tss': list_append(a.tss, CAST(b.x.ts AS TIMESTAMP)), 'kept': list_append(a.kept, CAST(b.x.seq AS BIGINT)), 'x': b.x} END).kept AS kept FROM o),
u AS (SELECT l_suppkey, unnest(kept) AS seq FROM f), j AS (SELECT k.*, u.seq IS NULL AS dup FROM k LEFT JOIN u ON k.l_suppkey = u.l_suppkey AND k.seq = u.seq)
SELECT CASE WHEN dup THEN 'DUPLICATE' WHEN l_tax = 0 THEN 'INVALID_SCHEMA' WHEN l_returnflag = 'A' THEN 'SYNTHETIC' WHEN l_linestatus = 'O' THEN 'UNRESOLVED' WHEN l_quantity < 23.5 THEN 'INVALID_HORIZON' WHEN l_discount < 0.05 THEN 'PRE' ELSE 'VALID' END AS kind, count(*) AS n FROM j GROUP BY 1""")
def record_audit(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's ledger: a record that shares an id or a time with an accepted one is a duplicate."""
    r = t(spark, d, "lineitem").select(
        "l_suppkey", (F.col("l_partkey") % 50).alias("id"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 10_000_000 + F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("seq"), F.when(F.col("l_tax") != 0, 1).alias("schema_version"),
        F.when(F.col("l_returnflag") == "A", "SYNTHETIC").otherwise("LIVE").alias("source"), (F.col("l_linestatus") != "O").alias("resolved"), F.col("l_quantity").alias("hours"), (F.col("l_discount") < 0.05).alias("before"),
    )
    return og.classified(r, ["l_suppkey"], shared_dir(spark)).groupBy("kind").agg(F.count("*").alias("n"))


@query("block_quality", "WITH e AS (SELECT ts, CASE WHEN value < 2 THEN 'INVALID' WHEN value > 400 THEN 'DEGRADED' ELSE 'VALID' END AS quality FROM events) SELECT date_trunc('day', ts) AS block, count(*) AS rows, CASE WHEN bool_or(quality = 'INVALID') THEN 'INVALID' WHEN bool_and(quality = 'VALID') THEN 'VALID' WHEN bool_and(quality = 'DEGRADED') THEN 'DEGRADED' ELSE 'MIXED' END AS block_quality FROM e GROUP BY 1")
def block_quality(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").withColumn("quality", F.when(F.col("value") < 2, "INVALID").when(F.col("value") > 400, "DEGRADED").otherwise("VALID"))
    return og.block_quality(e)


@query("set_operations", "(SELECT 'except' AS op, c_custkey AS k FROM customer EXCEPT SELECT 'except', o_custkey FROM orders) UNION ALL (SELECT 'intersect', c_custkey FROM customer INTERSECT SELECT 'intersect', o_custkey FROM orders)")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    c, o = t(spark, d, "customer").select(F.col("c_custkey").alias("k")), t(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    mark = lambda x, op: x.select(F.lit(op).alias("op"), "k")
    return mark(c.exceptAll(o).distinct().join(o, "k", "left_anti"), "except").unionByName(mark(c.intersect(o), "intersect"))


@query("top_k_with_fallback", "WITH a AS (SELECT o_orderkey, o_totalprice, 0 AS tier FROM orders WHERE o_orderpriority = 'none' ORDER BY o_totalprice DESC, o_orderkey LIMIT 5), b AS (SELECT o_orderkey, o_totalprice, 1 AS tier FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT o_orderkey, o_totalprice FROM u WHERE tier = (SELECT min(tier) FROM u)")
def top_k_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The most similar context, or globally if none matches."""
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    top = lambda x, tier: x.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).withColumn("tier", F.lit(tier))
    u = top(o.where("o_orderpriority = 'none'"), 0).unionByName(top(o, 1))
    return u.withColumn("least", F.min("tier").over(Window.partitionBy(F.lit(1)))).where("tier = least").select("o_orderkey", "o_totalprice")


@query("nulls_last_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END DESC NULLS LAST, o_orderkey) AS place FROM orders QUALIFY place <= 10")
def nulls_last_rank(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc_nulls_last(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))), "o_orderkey")
    return t(spark, d, "orders").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 10").select("o_orderkey", "place")


@query("arg_max_row", "SELECT o_orderpriority, arg_max(o_orderkey, o_totalprice) AS best FROM orders GROUP BY o_orderpriority")
def arg_max_row(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", "o_totalprice").alias("best"))


@query("dedup_keep_first", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn FROM events) SELECT event_id, user_id FROM k WHERE rn = 1")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").withColumn("h", F.date_trunc("hour", "ts"))
    return ob.keep_first(e, ["user_id", "h"], [F.col("ts"), F.col("event_id")]).select("event_id", "user_id")


@query("last_n_ascending", "SELECT * FROM (SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50) ORDER BY ts, event_id")
def last_n_ascending(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", "ts", "value").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).orderBy("ts", "event_id")


@query("top_quantile_selection", f"WITH {S}, c AS (" + " UNION ALL ".join(f"SELECT CAST({k} AS DOUBLE) AS coverage, quantile_cont(x, CAST({1 - k} AS DOUBLE)) AS cut FROM s" for k in (0.1, 0.25, 0.5, 1.0)) + ") SELECT coverage, round(cut, 6) AS cut, count(*) AS n, round(avg(r), 6) AS mean FROM s JOIN c ON x >= cut GROUP BY coverage, cut")
def top_quantile_selection(spark: SparkSession, d: str) -> DataFrame:
    """Selective prediction: the most confident share, for several shares (four thresholds)."""
    s, shares = scored(spark, d), (0.1, 0.25, 0.5, 1.0)
    cuts = fr.exact_quantiles(s, [], "x", {f"c{i}": 1 - c for i, c in enumerate(shares)})
    cuts = cuts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("coverage"), F.col(f"c{i}").alias("cut")) for i, c in enumerate(shares)])).alias("z")).select("z.*")
    return s.crossJoin(F.broadcast(cuts)).where("x >= cut").groupBy("coverage", "cut").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean")).withColumn("cut", F.round("cut", 6))


@query("range_export", "SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-06' ORDER BY ts, event_id")
def range_export(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("event_id", "ts", "value")
    return e.where(F.col("ts").between(F.expr("timestamp_ntz'2024-01-05 00:00:00'"), F.expr("timestamp_ntz'2024-01-06 00:00:00'"))).orderBy("ts", "event_id")


@query("calendar_and_flags", "SELECT event_id, isodow(ts) - 1 AS weekday, hour(ts) AS hour, CASE WHEN isodow(ts) IN (3, 5) AND hour(ts) BETWEEN 12 AND 16 THEN 0.85 ELSE 0.15 END AS event_intensity, array_to_string(list_filter([CASE WHEN value > 400 THEN 'LARGE' END, CASE WHEN value < 5 THEN 'SMALL' END, CASE WHEN hour(ts) < 6 THEN 'NIGHT' END], lambda x: x IS NOT NULL), ',') AS flags, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def calendar_and_flags(spark: SparkSession, d: str) -> DataFrame:
    """Release windows, all flags of an event and a field of the JSON context."""
    e, h = t(spark, d, "events"), F.hour("ts")
    flags = F.filter(F.array(F.when(F.col("value") > 400, "LARGE"), F.when(F.col("value") < 5, "SMALL"), F.when(h < 6, "NIGHT")), lambda x: x.isNotNull())
    macro = F.when(F.weekday("ts").isin(2, 4) & h.between(12, 16), 0.85).otherwise(0.15)
    return e.select("event_id", F.weekday("ts").cast("long").alias("weekday"), h.cast("long").alias("hour"), macro.alias("event_intensity"), F.array_join(flags, ",").alias("flags"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("embedding_agreement", "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT *, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM e) SELECT vec_id, round(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))), 5) AS cosine FROM p WHERE w IS NOT NULL")
def embedding_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of neighbouring vectors of a label."""
    e = t(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    e = e.withColumn("w", F.lead("v").over(Window.partitionBy("label").orderBy("vec_id"))).where("w is not null")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", F.round(dot("v", "w") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("w", "w"))), 5).alias("cosine"))


@query("manifest_hashes", "SELECT o_orderkey, sha256(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority) AS digest FROM orders")
def manifest_hashes(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"), 256).alias("digest"))


_FACTORS = {
    "quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "line": "l_linenumber", "revenue": "l_extendedprice * (1 - l_discount)", "charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "part": "l_partkey",
    "supplier": "l_suppkey", "saved": "l_extendedprice * l_discount",
}


def _correlation_sql() -> str:
    names = list(_FACTORS)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in names)
    each = " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS pearson, corr(r_{a}, r_{b}) AS spearman FROM r" for a, b in pairs)
    return f"""WITH f AS (SELECT {", ".join(f"CAST(round({v}, 4) AS DOUBLE) AS {k}" for k, v in _FACTORS.items())} FROM lineitem), r AS (SELECT *, {ranks} FROM f), p AS ({each})
SELECT feature_a, feature_b, round(pearson, 5) AS pearson, round(spearman, 5) AS spearman, CASE WHEN abs(spearman) >= 0.95 THEN 'Near Duplicate' WHEN abs(spearman) >= 0.8 THEN 'High Collinearity' END AS relationship FROM p"""


def _to_digits(x: Column, digits: int = 4) -> Column:
    """Half away from zero by floating point, as DuckDB's round; Spark's own goes through decimals, ten times as long."""
    scale = 10.0**digits
    near = F.abs(x) * scale
    return F.when(near < 2.0**52, F.signum(x) * F.floor(near + 0.5) / scale).otherwise(F.round(x, digits))


@query("factor_correlations", _correlation_sql())
def factor_correlations(spark: SparkSession, d: str) -> DataFrame:
    """Pearson and Spearman correlation of every pair of factors, and what pairs from 0.80 on are called."""
    rows = t(spark, d, "lineitem").select(*[_to_digits(F.expr(v).cast("double")).alias(k) for k, v in _FACTORS.items()])
    both = fm.correlations(rows, list(_FACTORS)).withColumnRenamed("rho", "pearson").join(fm.correlations(fm.ranked(rows, list(_FACTORS)), list(_FACTORS)).withColumnRenamed("rho", "spearman"), ["feature_a", "feature_b"])
    strong = F.abs("spearman")
    return both.select("feature_a", "feature_b", R("pearson", 5), R("spearman", 5), F.when(strong >= 0.95, "Near Duplicate").when(strong >= 0.8, "High Collinearity").alias("relationship"))
