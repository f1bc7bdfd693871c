"""Live features in constant work a bar against windows computed anew, through restarts and repeated bars."""

import math
import random
import tempfile

import numpy as np
import pandas as pd
import pytest

from tidewater.streaming import features, live


def anew(bars: list[dict], size: int) -> dict[str, float]:
    """Everything from the window's bars, as the definitions read."""
    b = pd.DataFrame(bars[-size:]).reset_index(drop=True)
    c, h, lo, v, n = b.close, b.high, b.low, b.volume, len(b)
    now = c.iloc[-1] if c.iloc[-1] > 0 else 1.0
    ema = lambda s, k: s.ewm(span=k, adjust=False).mean()
    out = {f"ema_{k}_ratio": now / ema(c, k).iloc[-1] - 1 for k in (20, 50, 200)}
    macd = ema(c, 12) - ema(c, 26)
    out["macd"], out["macd_signal"] = macd.iloc[-1] / now, (ema(macd, 9).iloc[-1] if n >= 9 else macd.iloc[-1]) / now
    d = c.diff().iloc[1:]
    wilder = lambda s: s.ewm(alpha=1 / 14, adjust=False).mean().iloc[-1]
    out["rsi_14"] = 1 - 2 / (1 + wilder(d.clip(lower=0)) / (wilder((-d).clip(lower=0)) + 1e-8)) if n >= 15 else 0.0
    reach = np.maximum(h - lo, np.maximum(abs(h - c.shift()), abs(lo - c.shift()))).iloc[1:]
    atr = ema(reach, 14).iloc[-1] if n > 1 else h.iloc[-1] - lo.iloc[-1]
    out["atr_14_ratio"] = atr / now
    up, down = h.diff().iloc[1:], -lo.diff().iloc[1:]
    plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
    p, m = (100 * ema(x, 14).iloc[-1] / (atr + 1e-8) if n > 1 else 0.0 for x in (plus, minus))
    out["adx_14"] = abs(p - m) / (p + m + 1e-8) if n >= 15 else 0.25
    out["plus_minus_di_spread"] = (p - m) / (p + m + 1e-8) if n >= 15 else 0.0
    out["vwap_ratio"] = now / (((h + lo + c) / 3 * v).sum() / v.sum()) - 1 if v.sum() > 0 else 0.0
    out["roc_10"] = now / (c.iloc[-11] if n > 10 else c.iloc[0]) - 1
    tail = c.tail(20)
    out["bollinger_width"] = 4 * (tail.std(ddof=0) + 1e-8) / tail.mean()
    out["norm_volume"] = (v.iloc[-1] - v.tail(20).mean()) / (v.tail(20).std(ddof=0) + 1e-8)
    r = np.log(c).diff().iloc[1:].tail(24)
    out["realized_vol_24"] = r.std(ddof=0) * math.sqrt(24) if len(r) else 0.0
    obv = (np.sign(d) * v.iloc[1:]).cumsum()
    out["obv_norm"] = (obv.iloc[-1] - obv.tail(20).mean()) / (obv.tail(20).std(ddof=0) + 1e-8) if len(obv) >= 20 else 0.0
    return out


def series(n: int, seed: int = 1) -> list[dict]:
    rnd, price, out = random.Random(seed), 100.0, []
    for i in range(n):
        open_, price = price, price * math.exp(rnd.gauss(0, 0.02))
        price = open_ if i % 17 == 3 else price
        out.append({"open": open_, "high": max(open_, price) * (1 + rnd.random() / 100), "low": min(open_, price) * (1 - rnd.random() / 100), "close": price, "volume": 0.0 if i % 23 == 5 else rnd.random() * 1e6})
    return out


@pytest.mark.parametrize("size", [30, 100, 500])
def test_window_equals_recomputed(size):
    bars, held, rows = series(3 * size if size < 500 else 1100), features.LiveWindow(size), {}
    for i, bar in enumerate(bars):
        if i % 7 == 0:
            held = features.LiveWindow.load(size, *held.dump())
        found = held.add(dict(bar), rows.__getitem__)
        rows[i] = held.made
        if size < 500 or i > 1000 or i % 50 < 3:
            for k, x in anew(bars[: i + 1], size).items():
                assert found[k] == pytest.approx(x, rel=1e-7, abs=1e-9), (k, i)


def test_missing_values_and_context():
    held, rows = features.LiveWindow(), {}
    first = held.add({"open": 5.0, "high": None, "low": None, "close": None, "volume": None}, rows.__getitem__)
    assert set(first) == set(features.NAMES) and first["norm_high"] == 0 and first["vwap_ratio"] == 0 and first["depth_liquidity_score"] == math.log1p(200)
    second = held.add({"open": 5.0, "high": 6.0, "low": 4.0, "close": 5.0, "volume": 1.0, "open_interest": 1100.0, "bid_depth": 3.0, "ask_depth": 1.0, "spread": 2.5}, rows.__getitem__)
    assert second["open_interest_delta"] == 0 and second["order_book_imbalance"] == pytest.approx(0.5) == second["microstructure_pressure"] and second["bid_ask_spread"] == 0.5
    third = held.add({"open": 5.0, "high": 6.0, "low": 4.0, "close": 5.0, "volume": 1.0, "open_interest": 1210.0}, rows.__getitem__)
    assert third["open_interest_delta"] == pytest.approx(0.1)
    assert [features.sane(x) for x in (math.nan, math.inf, -math.inf, 2.0)] == [0.0, 1.0, -1.0, 2.0]


def test_stream_restarts_and_repeated_bars(spark):
    size, start = 30, pd.Timestamp("2024-01-01")
    rows = [(s, (start + pd.Timedelta(hours=i)).to_pydatetime(), *[b[k] for k in features.PRICES]) for s, seed in (("a", 1), ("b", 2)) for i, b in enumerate(series(90, seed))]
    schema = "symbol string, ts timestamp_ntz, " + ", ".join(f"{k} double" for k in features.PRICES)
    at = lambda lo, hi: [r for r in rows if lo <= (pd.Timestamp(r[1]) - start) / pd.Timedelta(hours=1) < hi]
    slices = [spark.createDataFrame(x, schema) for x in (at(0, 40), at(30, 41), at(41, 90))]
    out = live.replay(slices, lambda s: features.live_features(s, size), schema, tempfile.mkdtemp(prefix="shared-")).toPandas()
    assert len(out) == 180 and not out.duplicated(["symbol", "ts"]).any()
    for s, seed in (("a", 1), ("b", 2)):
        bars, mine = series(90, seed), out[out.symbol == s].sort_values("ts").reset_index(drop=True)
        for i in (0, 1, 20, 35, 60, 89):
            for k, x in anew(bars[: i + 1], size).items():
                assert mine[k][i] == pytest.approx(x, rel=1e-7, abs=1e-9), (k, i)
