"""Arena, resampling, drift, correlations and market intelligence against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.functions import metrics
from tidewater.operators import arena, intelligence, resampling

START = dt.datetime(2024, 1, 1)


def candles(n, seed=1, symbols="ab"):
    rnd, out = random.Random(seed), []
    for s in symbols:
        price = 1000.0
        for i in range(n):
            o, price = price, price * math.exp(rnd.gauss(0, 0.01))
            out.append((s, START + dt.timedelta(hours=i), o, max(o, price) * (1 + rnd.random() / 200), min(o, price) * (1 - rnd.random() / 200), price, rnd.random() * 100))
    return pd.DataFrame(out, columns=["symbol", "ts", "open", "high", "low", "close", "volume"])


# --- arena -----------------------------------------------------------------------


def test_positions_close_on_high_low_and_time():
    a = arena.Arena()
    assert a.step(101, 99, 100, 2.0, "SKIP", 0.9) is None and a.step(101, 99, 100, 2.0, "LONG", 0.5) is None and a.step(1, 1, 0.0, 1.0, "LONG", 0.9) is None
    assert a.step(101, 99, 100, 2.0, "LONG", 0.6)[0] == "POSITION_OPENED" and (a.take, a.stop) == (104.0, 97.0)
    assert a.size == pytest.approx(0.2 / 0.03) and a.quantity == pytest.approx(0.2 / 0.03 / 100)
    assert a.step(103.99, 97.01, 100, 2.0, "SHORT", 0.1) is None and a.bars == 1
    # both levels in one candle: the take-profit counts, and nothing opens on that candle
    event, why, price, pnl, balance, drawdown, bars = a.step(104, 97, 100, 2.0, "LONG", 0.9)
    assert (event, why, price, bars, drawdown) == ("TRADE_CLOSED", "TP_HIT", 104.0, 2, 0.0) and a.side == 0
    assert pnl == round(0.2 / 0.03 / 100 * 4 - 0.2 / 0.03 * 0.001, 4) and balance == round(10 + pnl, 4)
    a.step(101, 99, 100, None, "SHORT", 0.3)
    assert (a.take, a.stop) == (98.4, 101.2)
    for _ in range(29):
        assert a.step(100.5, 99.5, 100, None, "SKIP", None) is None
    out = a.step(100.5, 99.5, 99.0, None, "SKIP", None)
    assert out[1] == "TIME_EXPIRED" and out[2] == 99.0 and out[6] == 30
    poor = arena.Arena(balance=0.11, peak=10.0)
    poor.step(100, 100, 100, 1.0, "LONG", 0.9)
    poor.quantity = 1.0
    assert poor.step(100, 90, 95, 1.0, "SKIP", 0.5)[4] == arena.FLOOR


def test_batch_of_series(spark):
    bars = candles(150)
    rnd = random.Random(2)
    bars["atr"] = [rnd.choice((None, 5.0, 8.0)) for _ in range(len(bars))]
    bars["direction"] = [rnd.choice(("LONG", "SHORT", "SKIP")) for _ in range(len(bars))]
    bars["probability"] = [rnd.choice((0.3, 0.5, 0.7, None)) for _ in range(len(bars))]
    rows = bars.astype(object).where(bars.notna(), None)
    df = spark.createDataFrame([(r[0], r[1].to_pydatetime(), *r[2:]) for r in rows.values.tolist()], "symbol string, ts timestamp, open double, high double, low double, close double, volume double, atr double, direction string, probability double").repartition(3)
    got = arena.played(df).toPandas()
    for s, g in rows.groupby("symbol"):
        a, want = arena.Arena(), []
        for r in g.itertuples():
            if out := a.step(r.high, r.low, r.close, r.atr, r.direction, r.probability):
                want.append((r.ts, out[0], out[4]))
        mine = got[got.symbol == s].sort_values("ts")
        assert want and list(zip(mine.ts, mine.event, mine.balance, strict=True)) == want
    assert arena.played(df.limit(0)).count() == 0


# --- resampling --------------------------------------------------------------------


def test_bootstrap_equals_row_by_row(spark):
    rnd = random.Random(3)
    values = [round(rnd.gauss(0.001, 0.02), 6) for _ in range(103)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "ts int, r double").repartition(4)
    got = resampling.bootstrap(df, "r", ["ts"], 10, 600).toPandas().sort_values("draw").reset_index(drop=True)
    assert len(got) == 600
    pick = resampling.picks(np.arange(600), 11)
    for k in (0, 1, 2, 77, 255, 256, 599):
        x = np.concatenate([values[b * 10 : b * 10 + 10] for b in pick[k]])
        eq = np.cumprod(1 + x)
        row = got.loc[k]
        assert row["mean"] == pytest.approx(x.mean()) and row["sharpe"] == pytest.approx(x.mean() / (x.std() + 1e-8) * 8766**0.5)
        assert row["sortino"] == pytest.approx(x.mean() / (x[x < 0].std() + 1e-8) * 8766**0.5)
        assert row["profit_factor"] == pytest.approx(x[x > 0].sum() / -x[x < 0].sum())
        assert row["max_drawdown"] == pytest.approx((1 - eq / np.maximum.accumulate(eq)).max())
    assert resampling.bootstrap(df.limit(0), "r", ["ts"], 10, 50).count() == 0


def auc(p, y):
    rank = pd.Series(p).rank().to_numpy()
    pos = y.sum()
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def test_auc_draws_and_permutations(spark):
    rnd = random.Random(4)
    rows = [(i, i // 20, round(rnd.random(), 1), rnd.randint(0, 1)) for i in range(205)]
    data = pd.DataFrame(rows, columns=["ts", "b", "p", "y"])
    df = spark.createDataFrame(rows, "ts int, b int, p double, y int").repartition(3)
    counts = df.selectExpr("b", "p", "y").groupBy("b", "p").agg({"y": "sum"}).withColumnRenamed("sum(y)", "py").join(df.groupBy("b", "p").count().withColumnRenamed("count", "n"), ["b", "p"])
    got = resampling.auc_bootstrap(counts, 300).toPandas().set_index("draw").auc
    pick = resampling.picks(np.arange(300), 11)
    for k in (0, 3, 299):
        x = pd.concat([data[data.b == b] for b in pick[k]])
        assert got[k] == pytest.approx(auc(x.p.to_numpy(), x.y.to_numpy()))
    perm = resampling.auc_permutation(df, ["ts"], 20, 50).toPandas().set_index("draw")
    whole = data.iloc[:200]
    order = resampling.orders(np.arange(50), 10)
    assert all(sorted(o) == list(range(10)) for o in order.tolist()) and perm.observed.iloc[0] == pytest.approx(auc(whole.p.to_numpy(), whole.y.to_numpy()))
    for k in (0, 9, 49):
        y = np.concatenate([whole.y.to_numpy()[b * 20 : b * 20 + 20] for b in order[k]])
        assert perm.auc[k] == pytest.approx(auc(whole.p.to_numpy(), y))


# --- drift, correlations -------------------------------------------------------------


def test_drift_statuses_and_tail(spark):
    rnd = random.Random(5)
    side = lambda name, n, mean: [(name, rnd.gauss(mean, 1)) for _ in range(n)]
    base = spark.createDataFrame([*side("same", 400, 5), *side("moved", 400, 5), *side("few", 400, 5), ("gone", 1.0)], "k string, v double")
    now = spark.createDataFrame([*side("same", 300, 5), *side("moved", 300, 8), *side("few", 14, 50)], "k string, v double")
    got = {r.k: r for r in metrics.drift(base, now, "v", ("k",)).collect()}
    assert got["same"].status == "NORMAL" and got["same"].p_value > 0.05
    assert got["moved"].status == "ALERT" and got["moved"].shift_status == "ALERT" and got["moved"].p_value < 1e-6
    assert (got["few"].status, got["few"].ks, got["few"].p_value) == ("NORMAL", 0.0, 1.0) and got["gone"].status == "NORMAL"
    one = spark.createDataFrame([(1.0,), (1.36,), (0.1,), (3.0,)], "x double")
    tail = [r.p for r in one.select(metrics.kolmogorov_tail(one.x).alias("p")).collect()]
    assert tail[0] == pytest.approx(0.26999967) and tail[1] == pytest.approx(0.04948588, rel=1e-5) and tail[2] == 1.0 and tail[3] == pytest.approx(3.045996e-8, rel=1e-4)


def test_correlations_equal_pandas(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice((0.0, 0.0, 0.0, rnd.random())), rnd.random(), None if i % 9 == 0 else float(rnd.randint(0, 5))) for i in range(500)]
    data = pd.DataFrame(rows, columns=["a", "b", "c"]).astype(float)
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(4)
    for frame, method in ((df, "pearson"), (metrics.ranked(df, ["a", "b", "c"]), None)):
        for r in metrics.correlations(frame, ["a", "b", "c"]).collect():
            x, y = data[r.feature_a], data[r.feature_b]
            want = x.corr(y) if method else x.rank().corr(y.rank())
            assert r.rho == pytest.approx(want, abs=1e-9)


# --- intelligence --------------------------------------------------------------------


def test_intelligence_as_of_each_bar(spark):
    bars = candles(120, seed=7, symbols="a")
    bars.loc[40:43, "high"] = bars.loc[40, "high"]
    df = spark.createDataFrame(bars).repartition(3)
    s, q, m, v = (f(df).toPandas().sort_values("ts").reset_index(drop=True) for f in (intelligence.structure, intelligence.liquidity, intelligence.momentum, intelligence.volatility))
    h, lo, c, o = (bars[k].tolist() for k in ("high", "low", "close", "open"))
    for n in (1, 2, 5, 8, 20, 33, 60, 90, 120):
        sh = [h[i] for i in range(3, n - 3) if h[i] == max(h[i - 3 : i + 4])]
        sl = [lo[i] for i in range(3, n - 3) if lo[i] == min(lo[i - 3 : i + 4])]
        up, down = len(sh) > 1 and sh[-1] > sh[-2], len(sh) > 1 and sh[-1] < sh[-2]
        rise, fall = len(sl) > 1 and sl[-1] > sl[-2], len(sl) > 1 and sl[-1] < sl[-2]
        want = ("Bullish", 84) if up and rise else ("Bearish", 78) if down and fall else ("Consolidating Bullish", 65) if up else ("Consolidating Bearish", 60) if down else ("Ranging", 52)
        r = s.loc[n - 1]
        assert (r.structure, r.trend_strength) == want and r.last_swing_high == (sh[-1] if sh else c[n - 1])
        assert r.change_of_character == bool((up and sl and c[n - 1] < sl[-1]) or (fall and sh and c[n - 1] > sh[-1]))
        highs, lows = sorted(h[max(0, n - 20) : n]), sorted(lo[max(0, n - 20) : n])
        eh = next((b for a, b in zip(highs, highs[1:]) if (b - a) / a < 0.0015), None)
        el = next((a for a, b in zip(lows, lows[1:]) if (b - a) / a < 0.0015), None)
        body = 2.5 * max(abs(c[n - 1] - o[n - 1]), 10.0)
        sweep = "UPPER_WICK" if h[n - 1] - max(c[n - 1], o[n - 1]) > body else "LOWER_WICK" if min(c[n - 1], o[n - 1]) - lo[n - 1] > body else "NONE"
        r = q.loc[n - 1]
        assert (r.equal_highs, r.equal_lows, r.sweep) == (eh is not None, el is not None, sweep)
        assert r.sweep_target == pytest.approx(eh if eh is not None else el if el is not None else c[n - 1] * 1.012)
        roc = (c[n - 1] - c[n - 15]) / c[n - 15] if n >= 15 else 0.01
        vol = bars.volume[:n]
        strength = int(np.clip(50 + roc * 500 + (vol.iloc[-1] / vol.tail(20).mean() - 1) * 20, 15, 95))
        r = m.loc[n - 1]
        assert r.momentum_strength == strength and r.persistence == int((bars.close[:n].pct_change().tail(10) > 0).mean() * 100)
        ret = np.log(bars.close[:n]).diff().dropna()
        past = ret.tail(720).rolling(24).std().dropna()
        share = (past < ret.tail(24).std() - 1e-12).mean() * 100 if len(past) else 35.0  # the current one is among them
        assert v.loc[n - 1].volatility_percentile == int(share)


def test_permutation_of_labels_that_are_all_alike(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i % 7), 0) for i in range(100)]
    got = resampling.auc_permutation(spark.createDataFrame(rows, "ts date, p double, y int"), ["ts"], 20, 50).collect()
    assert len(got) == 50 and all(r.auc is None and r.observed is None and r.as_high for r in got)


def test_ranks_of_few_values_are_broadcast(spark):
    rng = random.Random(8)
    rows = [(float(rng.randint(0, 5)) if i % 9 else None, rng.random(), float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(3)
    want = sorted(map(tuple, df.toPandas().rank().fillna(-1.0).to_numpy().tolist()))
    for few in (0, 100, 1000):
        assert sorted(tuple(-1.0 if x is None else x for x in r) for r in metrics.ranked(df, ["a", "b", "c"], few).collect()) == want
    plan = metrics.ranked(df, ["a", "b", "c"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_correlations_of_constant_missing_and_far_columns(spark):
    rnd = random.Random(12)
    rows = [(0.1, None, 1e9 + rnd.random(), rnd.random() if i % 5 else None, float(i % 2)) for i in range(3000)]
    rows = [(*r, r[2] + (r[3] or 0.0)) for r in rows]
    names = ["flat", "none", "far", "gaps", "two", "near"]
    data = pd.DataFrame(rows, columns=names).astype(float)
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(6)
    got = {(r.feature_a, r.feature_b): r.rho for r in metrics.correlations(df, names).collect()}
    assert len(got) == 15
    for (a, b), rho in got.items():
        if "none" in (a, b):
            assert rho is None
        elif "flat" in (a, b):
            assert math.isnan(rho)
        else:
            both = data[[a, b]].dropna()
            x, y = (both[c] - both[c].mean() for c in (a, b))
            assert rho == pytest.approx((x * y).sum() / math.sqrt((x * x).sum() * (y * y).sum()), abs=1e-7)
    assert [r.rho for r in metrics.correlations(df.limit(0), names).collect()] == [None] * 15


@pytest.mark.parametrize("common", [1, 3])
def test_ranks_of_many_values_with_common_and_missing_ones(spark, monkeypatch, common):
    monkeypatch.setattr(metrics, "COMMON", common)
    rnd = random.Random(common)
    rows = [(rnd.choice((7.0, None, 2.0, rnd.random())), float(i % 4), rnd.choice((0.0, rnd.random()))) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    want = sorted(map(tuple, df.toPandas().rank().fillna(-1.0).to_numpy().tolist()))
    got = metrics.ranked(df, ["a", "b", "c"], 20)
    assert sorted(tuple(-1.0 if x is None else x for x in r) for r in got.collect()) == want


def test_digits_are_rounded_as_in_sql(spark):
    import duckdb

    from tidewater.plans import analytics

    rnd = random.Random(5)
    values = [0.0, -0.00005, 0.00005, 1.00005, 2.675, 1e9 + 0.12345, 123456.78905, -3.14155, *[rnd.uniform(900, 1e5) * (1 - rnd.randint(0, 10) / 100) * (1 + rnd.randint(0, 8) / 100) for _ in range(5000)]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.x for r in df.select(analytics._to_digits(F.col("v")).alias("x")).collect()]
    c = duckdb.connect()
    c.register("t", pd.DataFrame({"v": values}))
    assert got == [x for (x,) in c.sql("SELECT round(v, 4) FROM t").fetchall()]
