"""Properties and edge cases of the market operators."""

import datetime as dt
import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tidewater.functions import blocks, metrics, ranks, scalar, windows
from tidewater.operators import bars, evolve, forecast, labels, ledger, sequential, validation
from tidewater.sources import scans, sinks

START = dt.datetime(2024, 1, 1)
BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, n long"


def series(spark, closes, symbol="a"):
    rows = [(symbol, START + dt.timedelta(hours=i), c, c, c, c, 1.0, 1) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BAR)


@pytest.mark.parametrize("closes", [[], [5.0], [3.0] * 40, [float(i + 1) for i in range(60)]])
def test_edges_run(spark, closes):
    b = series(spark, closes)
    out = labels.triple_barrier(labels.excursions(b, 24)).collect()
    assert len(out) == len(closes)
    if len(set(closes)) <= 1:
        assert all(r.label is None for r in out)


def test_past_features_do_not_change_when_rows_are_added(spark):
    closes = [100 + math.sin(i) for i in range(80)]
    f = lambda c: [r.z for r in series(spark, c).select("ts", windows.zscore("close", 24).alias("z")).orderBy("ts").collect()]
    assert f(closes)[:60] == f(closes[:60])


def test_asof_ties_and_unmatched(spark):
    left = spark.createDataFrame([("k", i, dt.datetime(2024, 1, i)) for i in (1, 2, 3)], "k string, id int, at timestamp_ntz")
    right = spark.createDataFrame([("k", 20.0, dt.datetime(2024, 1, 2))], "k string, v double, at timestamp_ntz")
    got = {r.id: r.v for r in bars.asof_backward(left, right, ["v"], ["k"], on="at").collect()}
    assert got == {1: None, 2: 20.0, 3: 20.0}


def test_walk_forward_keeps_train_before_test(spark):
    b = series(spark, [1.0 + i for i in range(120)]).withColumn("t0", F.col("ts")).withColumn("t1", F.expr("ts + interval 5 hours"))
    out = validation.walk_forward(b, ["symbol"], 4, 6, ["ts"]).toPandas()
    for _, g in out.groupby("fold"):
        assert g[g.role == "train"].t1.max() < g[g.role == "test"].t0.min()
    cp = validation.combinatorial(b, ["symbol"], 6, 2, ["ts"])
    assert cp.select("split").distinct().count() == 15


def test_auc_and_reliability_edges(spark):
    one = spark.createDataFrame([(0.5, 1), (0.5, 0), (1.0, 1), (0.0, 0)], "p double, y int")
    assert metrics.auc(one, "p", "y").first().auc == 0.875
    assert metrics.auc(one.where("y = 1"), "p", "y").first().auc is None
    assert {r.bin for r in metrics.reliability(one, "p", "y").collect()} == {0, 5, 9}
    assert metrics.calibration_error(one, "p", "y").first().n == 4


def test_uniqueness_matches_brute_force(spark):
    rows = [("a", START + dt.timedelta(hours=i), START + dt.timedelta(hours=i + 1 + i % 6)) for i in range(50)]
    got = {r.t0: r.overlaps for r in validation.uniqueness(spark.createDataFrame(rows, "s string, t0 timestamp_ntz, t1 timestamp_ntz"), ["s"], 6).collect()}
    assert got == {a[1]: sum(b[1] <= a[2] and b[2] >= a[1] for b in rows) for a in rows}


def test_ledger_operations(spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert {tuple(r) for r in ledger.update(t, spark.createDataFrame([(1, None)], "id int, v string"), ["id"], ["v"]).collect()} == {(1, None), (2, None)}
    assert {tuple(r) for r in ledger.update(t, spark.createDataFrame([(2, "b")], "id int, v string"), ["id"], ["v"]).collect()} == {(1, "a"), (2, "b")}
    assert ledger.delete(t, F.col("v") == "a").collect() == [(2, None)]
    assert ledger.insert_new(t, t.unionByName(spark.createDataFrame([(3, "c")], "id int, v string")), ["id"]).count() == 3


def test_longest_hold(spark):
    e = series(spark, [1.0] * 10).withColumn("signal", F.when(F.hour("ts") == 0, 1.0))
    assert sequential.max_hold(e, ["symbol"], ["ts"], "signal", 3).where("held <> 0").count() == 3


def test_exits_stay_flat_until_the_signal_changes(spark):
    closes = [100, 101, 103, 104, 104, 104, 104, 98, 97, 97]
    side = [1, 1, 1, 1, 0, -1, -1, -1, -1, 1]
    rows = [("a", START + dt.timedelta(hours=i), float(c), float(s), None if i == 9 else 1.0) for i, (c, s) in enumerate(zip(closes, side, strict=True))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, signal double, atr double")
    out = sequential.exit_policy(df, ["symbol"], ["ts"], "signal", "atr").orderBy("ts").collect()
    assert [r.exit_reason for r in out] == [None, None, "TP", None, None, None, None, "TP", None, None]
    assert [r.held for r in out] == [1, 1, 0, 0, 0, -1, -1, 0, 0, 1]


def test_hawkes_equals_the_recursion(spark):
    rng = random.Random(4)
    t, rows = 0.0, []
    for i in range(600):
        t += rng.choice([0.001, 0.3, 2.0, 40.0, 400.0])
        rows.append((i, START + dt.timedelta(seconds=t), rng.choice(["trade", "bid_update", "imbalance_change"]), rng.choice([-1.0, 1.0])))
    got = {r.event_id: r for r in sequential.hawkes(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, kind string, signed_volume double")).collect()}
    kernel = [[0.0] * 4 for _ in range(4)]
    before = None
    for i, at, kind, volume in rows:
        if before is not None:
            gap = (at - before[0]).total_seconds()
            kernel = [[x * math.exp(-sequential.BETA[r] * gap) + (sequential.ALPHA[r][c] * math.exp(-sequential.BETA[r] * gap) if c == before[1] else 0.0) for c, x in enumerate(row)] for r, row in enumerate(kernel)]
        rate = [m + sum(k) for m, k in zip(sequential.MU, kernel, strict=True)]
        assert got[i].lambda_buy == pytest.approx(rate[0]) and got[i].event_cluster_score == pytest.approx(sum(rate) / sum(sequential.MU))
        before = (at, (0 if volume > 0 else 1) if kind == "trade" else 2 if kind == "bid_update" else 3)


def test_normal_functions_and_overfitting(spark):
    xs = [-30.0, -6.5, -3.01, -2.99, -1.0, 0.0, 1e-9, 1.96, 4.2, 9.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", scalar.erf("x").alias("e"), scalar.norm_cdf("x").alias("c")).collect()
    for r in got:
        assert r.e == pytest.approx(math.erf(r.x), abs=1e-12) and r.c == pytest.approx(NormalDist().cdf(r.x), abs=1e-12)
    ps = [0.0, 1e-9, 0.01, 0.3, 0.5, 0.975, 1 - 1e-9, 1.0]
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", scalar.norm_ppf("p").alias("z")).collect():
        assert r.z is None if r.p in (0.0, 1.0) else r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-7)

    def pbo(matrix, trades=50):
        rows = [(g, f, float(x), trades) for g, m in enumerate(matrix) for f, x in enumerate(m)]
        return scalar.probability_of_overfitting(spark.createDataFrame(rows, "genome int, fold int, sharpe double, trades int"), len(matrix[0])).first().pbo

    assert pbo([[3, 3, 3, 3], [1, 1, 1, 1], [2, 2, 2, 2]]) == 0.0 and pbo([[3, 3], [1, 1]], trades=5) is None
    assert pbo([[9, -9, 0, 0], [-9, 9, 0, 0], [0, 0, 9, -9], [0, 0, -9, 9]]) > 0.5
    one = spark.createDataFrame([(0.2, 500, 0.0, 3.0)], "s double, n int, skew double, k double")
    less, more = (one.select(scalar.deflated_sharpe(F.col("s"), F.col("n"), F.col("skew"), F.col("k"), trials, "haircut").alias("d")).first().d for trials in (1000, 10))
    assert less < more < 0.2


def test_pareto_fronts_and_crowding(spark):
    rng = random.Random(9)
    rows = [(i, *[float(rng.randint(0, 6)) for _ in range(5)]) for i in range(80)] + [(80, None, 9.0, 9.0, 9.0, 9.0)]
    names = evolve.OBJECTIVES
    points = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names))
    got = {r.id: r.front for r in evolve.dominance_fronts(points).collect()}
    value = {r[0]: [-math.inf if x is None else x for x in r[1:]] for r in rows}
    beats = lambda a, b: -math.inf not in a and all(x >= y for x, y in zip(a, b, strict=True)) and a != b
    left, k = set(value), 1
    while left:
        front = {i for i in left if not any(beats(value[j], value[i]) for j in left)}
        assert {i for i in front if got[i] != k} == set()
        left, k = left - front, k + 1
    crowd = evolve.crowding(points.where("sharpe is not null").withColumn("front", F.lit(1))).collect()
    assert sum(r.crowding == math.inf for r in crowd) >= 2 and len(crowd) == 80
    assert evolve.survivors(evolve.dominance_fronts(points), 10).agg(F.max("front")).first()[0] <= k


def test_conformal_radius_takes_the_largest_of_a_few(spark):
    r = spark.createDataFrame([("a", float(i)) for i in range(1, 20)] + [("b", 1.0)], "k string, e double")
    assert {x.k: x.radius for x in forecast.conformal_radius(r, "e", ["k"]).collect()} == {"a": 18.0, "b": 1.0}


def test_duplicates_add_no_keys(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), rng.randint(0, 12), START + dt.timedelta(hours=rng.randint(0, 15)), i) for i in range(120)]
    got = {r.seq: r.duplicate for r in ledger.first_of_their_keys(spark.createDataFrame(rows, "book int, id int, ts timestamp_ntz, seq long"), ["book"], str(tmp_path / "x")).collect()}
    seen = set()
    for book, i, ts, seq in sorted(rows, key=lambda r: (r[2], r[3])):
        again = (book, "id", i) in seen or (book, "ts", ts) in seen
        assert got[seq] == again
        if not again:
            seen |= {(book, "id", i), (book, "ts", ts)}


def test_blocks_of_ticks_equal_one_pass(spark):
    rng = random.Random(7)
    rows = [(i, "ab"[i % 3 > 1], START + dt.timedelta(seconds=rng.randint(0, 40_000)), float(rng.randint(0, 9))) for i in range(700)]
    ticks = spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp_ntz, value double")
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    got = {r.event_id: r._rn for r in blocks.numbered(ticks, [], "event_id").collect()}
    assert got == {r[0]: k for k, r in enumerate(order)}
    one = {(r.event_type, r.cluster): r.events for r in bars.clusters(ticks, 60, width=3_600_000_000).collect()}
    assert one == {(r.event_type, r.cluster): r.events for r in bars.clusters(ticks, 60, width=10**15).collect()}
    ahead = blocks.time_blocks(ticks, 3_600_000_000, after=900_000_000)
    from pyspark.sql import Window

    w = Window.partitionBy("event_type", "_block").orderBy("_us").rangeBetween(1, 900_000_000)
    n = {r.event_id: r.n for r in ahead.withColumn("n", F.count("*").over(w)).where("_own").collect()}
    assert n == {a[0]: sum(b[1] == a[1] and dt.timedelta() < b[2] - a[2] <= dt.timedelta(seconds=900) for b in rows) for a in rows}


def test_exact_quantiles_and_ranks(spark):
    rng = random.Random(5)
    rows = [("a", rng.choice([1.0, 2.0, rng.random()])) for _ in range(900)] + [("b", 3.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: r for r in ranks.exact_quantiles(df, ["k"], "x", {"lo": 0.1, "mid": 0.5, "hi": 0.99}).collect()}
    import numpy as np

    values = [x for k, x in rows if k == "a"]
    assert [got["a"].lo, got["a"].mid, got["a"].hi] == pytest.approx(np.quantile(values, [0.1, 0.5, 0.99]).tolist()) and got["b"].mid == 3.0
    r = ranks.average_ranks(df, ["k"], "x", "r").where("k = 'a'").toPandas()
    assert r.r.tolist() == r.x.rank().tolist()


def test_sources_and_sinks(spark, tmp_path):
    assert scans.parquet_or_empty(spark, str(tmp_path / "no"), "a int").count() == 0
    (tmp_path / "x.csv").write_text("a,c\n1,z\n")
    assert scans.csv_back_filled(spark, str(tmp_path / "x.csv"), "a int, b double").collect() == [(1, None)]
    df = series(spark, [1.0, 2.0])
    assert sinks.manifest(df, ["symbol", "close"]).first() == sinks.manifest(df.orderBy(F.desc("ts")), ["symbol", "close"]).first()
    sinks.write_series(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    assert scans.synthetic_candles(spark, 50).where("high < low").count() == 0
    ticks = scans.synthetic_ticks(spark, 20_000).cache()
    assert ticks.where("timestamp_ms < 10").count() == 0 and 190 < ticks.agg(F.max("timestamp_ms") / 20_000).first()[0] < 230
    h = scans.synthetic_horizons(spark, 2000).where("high < close or low > close").count()
    assert h < 1000 and scans.synthetic_onchain(spark).where("nupl between -0.2 and 0.8").count() == 180
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    props = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).withColumnRenamed("id", "K").write.format("jdbc").options(url=url, dbtable="T", **props).save()
    assert scans.jdbc_table(spark, url, "T", "K", 4, props).agg(F.sum("K")).first()[0] == 4950
    assert "| symbol |" in sinks.markdown(df.select("symbol"))


def test_late_ticks_do_not_change_closed_bars(spark, tmp_path):
    from tidewater.streaming import live

    rows = [(i, START + dt.timedelta(minutes=10 * i), 1, "a", float(i), "") for i in range(40)]
    late = (99, START + dt.timedelta(minutes=5), 1, "a", 1e9, "")
    slices = [rows[:15], rows[15:30], [late, *rows[30:]]]
    out = live.replay([spark.createDataFrame(s, live.TICK) for s in slices], live.live_bars, live.TICK, str(tmp_path / "s"))
    got = {r.ts: (r.open, r.high, r.n) for r in out.collect()}
    first = START.replace(tzinfo=None)
    assert got[first] == (0.0, 5.0, 6) and all(n == 6 for _, _, n in got.values()) and len(got) == 6


def test_expired_forecasts_are_reported(spark, tmp_path):
    from tidewater.streaming import live

    rows = [(i, START + dt.timedelta(hours=3 * i), 1, "a" if i else "lonely", 1.0, "") for i in range(20)]

    def build(s):
        f = s.select(F.col("event_id").alias("forecast_id"), F.col("event_type").alias("forecast_symbol"), F.col("ts").alias("made_at"))
        return live.resolved(f, s.select("event_id", F.col("event_type").alias("symbol"), "ts"), 6).select("forecast_id", "event_id")

    out = live.replay([spark.createDataFrame(s, live.TICK) for s in (rows[:8], rows[8:14], rows[14:])], build, live.TICK, str(tmp_path / "r"))
    got = [(r.forecast_id, r.event_id) for r in out.collect()]
    assert (0, None) in got and (1, 2) in got and (1, 3) in got and (2, 5) not in got


def _shuffled_ticks(n):
    """Ticks of one key, every 450 s, in no order; more than one Arrow frame of 10,000 rows."""
    rows = [(i, START + dt.timedelta(seconds=450 * i, microseconds=123_457), 1, "a", None if i % 3 else float(i), "") for i in range(n)]
    return random.Random(4).sample(rows, n)


def test_carry_forward_orders_all_rows_of_a_large_key(spark, tmp_path):
    from tidewater.streaming import live

    n = 25_000
    out = live.replay([spark.createDataFrame(_shuffled_ticks(n), live.TICK).repartition(7)], live.carry_forward, live.TICK, str(tmp_path / "c"))
    assert sorted((r.event_id, r.value, r.degraded) for r in out.collect()) == [(i, float(i - i % 3), i % 3 != 0) for i in range(n)]


def test_cooldown_of_a_large_key_keeps_exact_distances(spark, tmp_path):
    from tidewater.streaming import live

    n = 25_000
    out = live.replay([spark.createDataFrame(_shuffled_ticks(n), live.TICK).repartition(7)], live.cooled, live.TICK, str(tmp_path / "d"))
    assert sorted(r.event_id for r in out.collect()) == list(range(0, n, 2))


def test_forecasts_meet_outcomes_of_their_slots_only(spark):
    from tidewater.streaming import live

    f = spark.createDataFrame([(i, "a", START + dt.timedelta(hours=i)) for i in range(40)], "forecast_id long, forecast_symbol string, made_at timestamp")
    o = spark.createDataFrame([(i, "a", START + dt.timedelta(hours=i)) for i in range(0, 40, 5)], "event_id long, symbol string, ts timestamp")
    out = live.resolved(f, o, 6)
    want = [(i, j) for i in range(40) for j in range(0, 40, 5) if i < j <= i + 6] + [(i, None) for i in range(35, 40)]
    assert sorted(((r.forecast_id, r.event_id) for r in out.collect()), key=str) == sorted(want, key=str)
    keys = out._jdf.queryExecution().sparkPlan().toString().split("Join [")[1].split("]")[0]
    assert "forecast_symbol" in keys and "_made_in" in keys


def test_dense_forecasts_are_resolved_from_sorted_columns(spark, tmp_path):
    """Pairs of held and new rows, equal times, kinds without outcomes and without a name."""
    from tidewater.streaming import live

    rnd = random.Random(9)
    at = lambda: rnd.choice((rnd.randint(0, 40 * 3_600_000_000), 3_600_000_000 * rnd.randint(0, 40)))
    rows = [(i, START + dt.timedelta(microseconds=at()), 1, rnd.choice("ab"), 1.0, "") for i in range(600)] + [(600, START, 1, "lonely", 1.0, ""), (601, START, 1, None, 1.0, ""), (602, START, 1, None, 1.0, "")]
    cut = START + dt.timedelta(hours=17)

    def build(s):
        f = s.select(F.col("event_id").alias("forecast_id"), F.col("event_type").alias("forecast_symbol"), F.col("ts").alias("made_at"))
        return live.resolutions(f, s.select("event_id", F.col("event_type").alias("symbol"), "ts"), 6)

    slices = [[r for r in rows if r[1] <= cut], [r for r in rows if r[1] > cut]]
    out = live.replay([spark.createDataFrame(rnd.sample(s, len(s)), live.TICK).repartition(3) for s in slices], build, live.TICK, str(tmp_path / "d"))
    want = [(f[0], o[0]) for f in rows for o in rows if f[3] and f[3] == o[3] and f[1] < o[1] <= f[1] + dt.timedelta(hours=6)]
    by = max(r[1] for r in rows) - dt.timedelta(hours=1, microseconds=max(r[1] for r in rows).microsecond % 1000)
    want += [(f[0], None) for f in rows if f[1] + dt.timedelta(hours=6) < by and f[0] not in {a for a, _ in want}]
    assert {(600, None), (601, None), (602, None)} <= set(want)
    assert sorted(((r.forecast_id, r.event_id) for r in out.collect()), key=str) == sorted(want, key=str)


def test_pairs_come_in_frames_of_bounded_size():
    import numpy as np

    from tidewater.streaming import live

    made, ts = np.sort(np.random.default_rng(1).integers(0, 5 * 3_600_000_000, 400)), np.sort(np.random.default_rng(2).integers(0, 9 * 3_600_000_000, 500))
    frames = list(live.Resolution(2, 1000)._pairs(made, np.arange(400), ts, np.arange(500)))
    got = [p for f in frames for p in zip(f.forecast_id.tolist(), f.event_id.tolist(), strict=True)]
    assert got == [(i, j) for i in range(400) for j in range(500) if made[i] < ts[j] <= made[i] + 7_200_000_000]
    assert len(frames) > 30 and max(map(len, frames)) <= 1000


def test_ranks_do_not_hang_on_how_often_edges_are_computed(spark, monkeypatch):
    """A sketch that comes out differently each time it is computed, as one merged in another order may."""
    import numpy as np

    real = F.percentile_approx

    def unsteady(x, shares, accuracy):
        drawn = F.udf(lambda edges: sorted(random.SystemRandom().choices(edges, k=len(edges))) if edges else edges, "array<double>").asNondeterministic()
        return drawn(real(x, shares, accuracy))

    monkeypatch.setattr(ranks.F, "percentile_approx", unsteady)
    rnd = random.Random(3)
    rows = [("a" if i % 3 else "b", float(rnd.randint(0, 40)), rnd.random() if i % 2 else 0.5) for i in range(900)]
    data = spark.createDataFrame(rows, "k string, x double, y double").repartition(3)
    frame = data.toPandas()
    for _ in range(3):
        got = {r.k: (r.ic, r.n) for r in metrics.spearman(data, "x", "y", ("k",)).collect()}
        for k, g in frame.groupby("k"):
            assert got[k] == (pytest.approx(g.x.rank().corr(g.y.rank()), abs=1e-12), len(g))
        q = {r.k: r.mid for r in ranks.exact_quantiles(data, ["k"], "y", {"mid": 0.37}).collect()}
        assert q == {k: pytest.approx(np.quantile(g.y, 0.37)) for k, g in frame.groupby("k")}


def test_rank_correlation_counts_equal_pairs_once(spark):
    rows = [("a", 1.0, 2.0)] * 50 + [("a", 2.0, 1.0)] * 30 + [("a", 1.0, 1.0)] * 20 + [("a", None, 1.0)] + [("flat", 1.0, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r.k: r for r in metrics.spearman(df, "x", "y", ("k",)).collect()}
    f = df.where("k = 'a' and x is not null").toPandas()
    assert got["a"].ic == pytest.approx(f.x.rank().corr(f.y.rank()), abs=1e-14) and got["a"].n == 100
    assert math.isnan(got["flat"].ic) and got["flat"].n == 5
    assert metrics.spearman(df.where("k = 'a'"), "x", "y").first().n == 100
