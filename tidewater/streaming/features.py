"""The 32 live features of the last 500 bars, kept up to date in constant work a bar.

The definitions look at a window of ``size`` bars and start every exponential mean afresh at the
window's first bar. Such a mean equals one over an endless past that repeats the first value:
with a = 1 - alpha, n values x_s..x_t and A = sum of a^i x_(t-i) over the window,

    mean = alpha A + a^n x_s,

and A follows from the bar before by A' = a A + x_(t+1) - a^size x_(t+1-size). The signal line is
a mean of means; its kernel is a difference of two geometric series, so it needs A of two decays
and x_s only. Sums of the whole window gain a bar and lose one, with the rounding error carried
along; deviations look at the last 20 or 24 values. So a bar costs one read of the ring of past
bars (the one that comes to its edge) and one write, whatever the window's length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PRICES = ("open", "high", "low", "close", "volume")
#: Columns of a bar that a feed may lack, and what stands for them.
CONTEXT = {"bid_depth": 100.0, "ask_depth": 100.0, "spread": 0.0001, "imbalance": None, "funding_rate": 0.0001, "open_interest": None, "fear_greed": 50.0, "sentiment_score": 0.0, "embed_dim0": 0.0, "embed_dim1": 0.0, "embed_dim2": 0.0}
#: The features' names in their order.
NAMES = (
    "norm_open", "norm_high", "norm_low", "norm_close_ret", "norm_volume", "ema_20_ratio", "ema_50_ratio", "ema_200_ratio", "vwap_ratio", "roc_10", "rsi_14", "macd", "macd_signal", "macd_hist",
    "atr_14_ratio", "bollinger_width", "bollinger_pct_b", "realized_vol_24", "adx_14", "obv_norm", "plus_minus_di_spread", "bid_ask_spread", "order_book_imbalance", "depth_liquidity_score",
    "microstructure_pressure", "funding_rate", "open_interest_delta", "fear_greed_index", "sentiment_score", "sentiment_embed_dim0", "sentiment_embed_dim1", "sentiment_embed_dim2",
)
SPANS = (9, 12, 20, 26, 50, 200)
#: Series that begin with the second bar, and the decay of their means.
MOVES = {"gain": 13 / 14, "loss": 13 / 14, "range": 13 / 15, "plus": 13 / 15, "minus": 13 / 15}
ROW = ("close", "volume", "paid", *MOVES)
_TINY = 1e-8


def _keep(a: float) -> float:
    return 1 - 2 / (a + 1)


def _added(total: tuple[float, float], x: float) -> tuple[float, float]:
    """Sum and rounding error, after adding x."""
    s = total[0] + x
    big = total[0] if abs(total[0]) >= abs(x) else x
    small = x if big is total[0] else total[0]
    return s, total[1] + ((big - s) + small)


def _spread(values: list[float]) -> tuple[float, float]:
    """Mean and population deviation."""
    mean = math.fsum(values) / len(values)
    return mean, math.sqrt(math.fsum([(v - mean) ** 2 for v in values]) / len(values))


class LiveWindow:
    """State of one series. ``past(i)`` gives the ring's row of bar i, which is ``size - 2`` bars old or less."""

    def __init__(self, size: int = 500):
        self.size, self.n = size, 0
        self.closes, self.volumes, self.flow = [], [], []
        self.decayed = dict.fromkeys([*SPANS, *MOVES], 0.0)
        self.paid = self.traded = (0.0, 0.0)
        self.edge: list[tuple[float, ...]] = []
        self.high = self.low = self.balance = 0.0
        self.interest: float | None = None
        self.made: tuple[float, ...] = ()

    def dump(self) -> tuple:
        return (self.n, self.closes, self.volumes, self.flow, list(self.decayed.values()), [*self.paid, *self.traded, self.high, self.low, self.balance], self.interest, [v for r in self.edge for v in r])

    @classmethod
    def load(cls, size: int, n, closes, volumes, flow, decayed, rest, interest, edge) -> LiveWindow:
        out = cls(size)
        out.n, out.closes, out.volumes, out.flow, out.interest = n, list(closes), list(volumes), list(flow), interest
        out.decayed = dict(zip(out.decayed, decayed, strict=True))
        out.paid, out.traded, (out.high, out.low, out.balance) = tuple(rest[:2]), tuple(rest[2:4]), rest[4:]
        k = len(ROW)
        out.edge = [tuple(edge[i : i + k]) for i in range(0, len(edge), k)]
        return out

    def _mean(self, alpha: float, decayed: float, n: int, first: float) -> float:
        return alpha * decayed + (1 - alpha) ** n * first

    def add(self, bar: dict[str, float | None], past: Callable[[int], tuple[float, ...]]) -> dict[str, float]:
        """Take the next bar in and give its features. A missing price is the open's, a missing volume 0."""
        i, d = self.n, self.decayed
        o = bar["open"] if bar["open"] is not None else 0.0
        h, lo, c = (bar[k] if bar[k] is not None else o for k in ("high", "low", "close"))
        v = bar["volume"] if bar["volume"] is not None else 0.0
        before = self.closes[-1] if i else c
        up, down = h - self.high, self.low - lo
        moves = (max(c - before, 0.0), max(before - c, 0.0), max(h - lo, abs(h - before), abs(lo - before)), up if up > down and up > 0 else 0.0, down if down > up and down > 0 else 0.0)
        paid = (h + lo + c) / 3 * v
        self.made = row = (c, v, paid, *(moves if i else (0.0,) * len(MOVES)))
        for k in SPANS:
            d[k] = _keep(k) * d[k] + c
        if i:
            for k, x in zip(MOVES, moves, strict=True):
                d[k] = MOVES[k] * d[k] + x
        self.paid, self.traded = _added(self.paid, paid), _added(self.traded, v)
        if i < 2:
            self.edge.append(row)
        if i >= self.size:
            gone, next_gone = self.edge
            for k in SPANS:
                d[k] -= _keep(k) ** self.size * gone[0]
            for j, (k, a) in enumerate(MOVES.items()):
                d[k] -= a ** (self.size - 1) * next_gone[3 + j]
            self.paid, self.traded = _added(self.paid, -gone[2]), _added(self.traded, -gone[1])
            self.edge = [next_gone, past(i - self.size + 2) if self.size > 2 else row]
        self.n = i + 1
        self.balance += (1 if c > before else -1 if c < before else 0) * v
        self.closes, self.volumes = [*self.closes, c][-25:], [*self.volumes, v][-20:]
        self.flow = [*self.flow, self.balance][-20:] if i else []
        out = self._features(o, h, lo, c, v, before)
        self.high, self.low = h, lo
        return out | self._context(bar, c if c > 0 else 1.0)

    def _features(self, o: float, h: float, lo: float, c: float, v: float, before: float) -> dict[str, float]:
        n, d = min(self.n, self.size), self.decayed
        now, first = (c if c > 0 else 1.0), self.edge[0][0]
        share = lambda a, b: a / b - 1 if b > 0 else 0.0
        ema = {k: self._mean(2 / (k + 1), d[k], n, first) for k in SPANS[1:]}
        fast = ema[12] - ema[26]
        signal = self._signal(12, n, first) - self._signal(26, n, first) if n >= 9 else fast
        move = {k: self._mean(1 - a, d[k], n - 1, self.edge[1][3 + j]) if n > 1 else 0.0 for j, (k, a) in enumerate(MOVES.items())}
        reach = move["range"] if n > 1 else h - lo
        enough = n >= 15
        strength = 100 - 100 / (1 + move["gain"] / (move["loss"] + _TINY)) if enough else 50.0
        plus, minus = (100 * move[k] / (reach + _TINY) for k in ("plus", "minus"))
        v_mean, v_dev = _spread(self.volumes)
        mid, dev = _spread(self.closes[-20:])
        dev += _TINY
        logs = [math.log(max(x, _TINY)) for x in self.closes[-25:]]
        returns = [b - a for a, b in zip(logs, logs[1:])][-(min(24, n - 1)) :] if n > 1 else []
        traded = self.traded[0] + self.traded[1]
        vwap = (self.paid[0] + self.paid[1]) / traded if traded > 0 else now
        since = self.closes[-11] if n > 10 else first
        flow, flow_dev = _spread(self.flow) if len(self.flow) == 20 else (0.0, 0.0)
        return {
            "norm_open": (o - now) / now, "norm_high": (h - now) / now, "norm_low": (lo - now) / now,
            "norm_close_ret": math.log(max(now, _TINY) / max(before if n > 1 and before > 0 else now, _TINY)), "norm_volume": (v - v_mean) / (v_dev + _TINY),
            "ema_20_ratio": share(now, ema[20]), "ema_50_ratio": share(now, ema[50]), "ema_200_ratio": share(now, ema[200]), "vwap_ratio": share(now, vwap), "roc_10": (now - since) / since if since > 0 else 0.0,
            "rsi_14": (strength - 50) / 50, "macd": fast / now, "macd_signal": signal / now, "macd_hist": (fast - signal) / now, "atr_14_ratio": reach / now,
            "bollinger_width": 4 * dev / mid if mid > 0 else 0.0, "bollinger_pct_b": (now - (mid - 2 * dev)) / (4 * dev + _TINY), "realized_vol_24": _spread(returns)[1] * math.sqrt(24) if returns else 0.0,
            "adx_14": abs(plus - minus) / (plus + minus + _TINY) if enough else 0.25, "obv_norm": (self.flow[-1] - flow) / (flow_dev + _TINY) if len(self.flow) == 20 and n > 20 else 0.0, "plus_minus_di_spread": (plus - minus) / (plus + minus + _TINY) if enough else 0.0,
        }

    def _signal(self, k: int, n: int, first: float) -> float:
        """Mean of span 9 of the mean of span k."""
        alpha, beta, a, b = 2 / (k + 1), 2 / 10, _keep(k), _keep(9)
        inside = alpha * beta * (a * self.decayed[k] - b * self.decayed[9])
        return (inside + (beta * a ** (n + 1) - alpha * b ** (n + 1)) * first) / (a - b)

    def _context(self, bar: dict[str, float | None], now: float) -> dict[str, float]:
        x = {k: bar.get(k) if bar.get(k) is not None else v for k, v in CONTEXT.items()}
        bid, ask, spread = x["bid_depth"], x["ask_depth"], x["spread"]
        balance = (bid - ask) / (bid + ask + _TINY)
        interest = x["open_interest"] if x["open_interest"] is not None else 1000.0
        earlier = self.interest if self.interest is not None else interest
        self.interest = x["open_interest"]
        return {
            "bid_ask_spread": spread / now if spread > 1 else spread, "order_book_imbalance": balance, "depth_liquidity_score": math.log1p(bid + ask), "microstructure_pressure": x["imbalance"] if x["imbalance"] is not None else balance,
            "funding_rate": x["funding_rate"], "open_interest_delta": (interest - earlier) / (earlier + _TINY), "fear_greed_index": (x["fear_greed"] - 50) / 50,
            "sentiment_score": x["sentiment_score"], "sentiment_embed_dim0": x["embed_dim0"], "sentiment_embed_dim1": x["embed_dim1"], "sentiment_embed_dim2": x["embed_dim2"],
        }


def sane(x: float) -> float:
    return 0.0 if x != x else 1.0 if x == math.inf else -1.0 if x == -math.inf else x


class LiveFeatures(StatefulProcessor):
    """Two state variables a symbol: running sums with the last 25 values, and the ring of past bars, one entry each."""

    def __init__(self, size: int, keep_days: int | None):
        self.size, self.keep = size, keep_days and keep_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        sums = "n long, closes array<double>, volumes array<double>, flow array<double>, decayed array<double>, rest array<double>, interest double, edge array<double>, last long"
        self.sums = handle.getValueState("sums", sums, self.keep)
        self.ring = handle.getMapState("ring", "slot int", ", ".join(f"{k} double" for k in ROW), self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(rows)).sort_values("ts", kind="stable").reset_index(drop=True)
        held, last = LiveWindow(self.size), None
        if self.sums.exists():
            *state, last = self.sums.get()
            held = LiveWindow.load(self.size, *state)
        fresh: dict[int, tuple[float, ...]] = {}

        def past(i: int) -> tuple[float, ...]:
            return fresh[i] if i in fresh else tuple(self.ring.getValue((i % self.size,)))

        out = []
        for bar in bars.to_dict("records"):
            at = bar["ts"].value
            if last is not None and at <= last:
                continue  # a bar is taken once
            last = at
            values = {k: None if v is None or v != v else float(v) for k, v in bar.items() if k in PRICES or k in CONTEXT}
            i = held.n
            found = held.add(values, past)
            fresh[i] = held.made
            out.append((key[0], bar["ts"], min(held.n, self.size), *[sane(found[k]) for k in NAMES]))
        for i in sorted(fresh)[-self.size :]:
            self.ring.updateValue((i % self.size,), fresh[i])
        if out:
            self.sums.update((*held.dump(), last))
        yield pd.DataFrame(out, columns=["symbol", "ts", "held", *NAMES])

    def close(self) -> None:
        pass


def live_features(bars: DataFrame, size: int = 500, keep_days: int | None = None) -> DataFrame:
    """All live features of each new bar of ``symbol, ts, open, high, low, close, volume`` and, where there, the columns of ``CONTEXT``.

    A bar not newer than the last one of its symbol is passed over, so one that arrives again
    changes nothing. With ``keep_days``, the state of a symbol without a bar for so many days goes;
    Spark then needs processing time, in which a query never runs out of batches, so that is for
    streams that stay up, not for ``availableNow``.
    """
    schema = ", ".join(["symbol string, ts timestamp, held long", *[f"{k} double" for k in NAMES]])
    return bars.groupBy("symbol").transformWithStateInPandas(LiveFeatures(size, keep_days), schema, "append", "processingTime" if keep_days else "none")
