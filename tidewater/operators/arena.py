"""Paper trading on candles: entry by conviction, take-profit and stop on the candle's high and low, a longest hold.

One state machine serves a batch of whole series and a stream with state per symbol.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Start and floor of the balance, share and cap of risk, fee on the position, bars held at most, distances in ATR.
START, FLOOR, RISK, MOST_RISK, FEE, LONGEST, TAKE, STOP = 10.0, 0.10, 0.02, 0.20, 0.0010, 30, 2.0, 1.5
SURE, UNSURE, LEAST_STOP, ATR_SHARE = 0.55, 0.45, 0.005, 0.008
EVENTS = "event string, exit_reason string, price double, pnl double, balance double, drawdown double, bars_held long"


@dataclass
class Arena:
    """Balance, its peak, and the open position: side (0: none), entry, levels, quantity, size, bars held."""

    balance: float = START
    peak: float = START
    side: float = 0.0
    entry: float = 0.0
    take: float = 0.0
    stop: float = 0.0
    quantity: float = 0.0
    size: float = 0.0
    bars: int = 0

    def step(self, high: float, low: float, close: float, atr: float | None, direction: str | None, p: float | None) -> tuple | None:
        """Take the next candle; what it did, or nothing. A candle that closes a position opens none."""
        if close is None or not close > 0:
            return None
        high, low = close if high is None else high, close if low is None else low
        if self.side:
            return self._watch(high, low, close)
        if direction in ("LONG", "SHORT") and p is not None and (p >= SURE or p <= UNSURE):
            return self._open(close, atr, 1.0 if direction == "LONG" else -1.0)
        return None

    def _watch(self, high: float, low: float, close: float) -> tuple | None:
        self.bars += 1
        price, why = None, None
        if min(self.take, self.stop, high, low) > 0:
            good, bad = (high >= self.take, low <= self.stop) if self.side > 0 else (low <= self.take, high >= self.stop)
            price, why = (self.take, "TP_HIT") if good else (self.stop, "SL_HIT") if bad else (None, None)
        if why is None and self.bars >= LONGEST:
            price, why = close, "TIME_EXPIRED"
        if why is None:
            return None
        pnl = round(self.quantity * self.side * (price - self.entry) - self.size * FEE, 4)
        self.balance, self.side = round(max(FLOOR, self.balance + pnl), 4), 0.0
        self.peak = max(self.peak, self.balance)
        return "TRADE_CLOSED", why, price, pnl, self.balance, min(0.0, (self.balance - self.peak) / self.peak), self.bars

    def _open(self, close: float, atr: float | None, side: float) -> tuple:
        atr = close * ATR_SHARE if atr is None or math.isnan(atr) or atr <= 0 else atr
        self.side, self.entry, self.bars = side, close, 0
        self.take, self.stop = round(close + side * TAKE * atr, 2), round(close - side * STOP * atr, 2)
        self.size = min(RISK * self.balance, MOST_RISK) / max(LEAST_STOP, side * (close - self.stop) / close)
        self.quantity = self.size / max(1.0, close)
        return "POSITION_OPENED", None, close, None, self.balance, min(0.0, (self.balance - self.peak) / self.peak), 0


def _none(x) -> float | None:
    return None if x is None or x != x else float(x)


def _played(arena: Arena, bars: pd.DataFrame, symbol) -> list[tuple]:
    out = []
    for r in bars.itertuples():
        did = arena.step(_none(r.high), _none(r.low), _none(r.close), _none(r.atr), r.direction, _none(r.probability))
        if did:
            out.append((symbol, r.ts, *did))
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["symbol", "ts", *[c.split()[0] for c in EVENTS.split(", ")]])


def played(bars: DataFrame) -> DataFrame:
    """What each symbol's account does over ``symbol, ts, high, low, close, atr, direction, probability``: a row an event.

    A group is one series of bars, which is bounded; a candle without a close is passed over.
    """
    schema = f"symbol string, ts {bars.schema['ts'].dataType.simpleString()}, {EVENTS}"
    return bars.groupBy("symbol").applyInPandas(lambda pdf: _frame(_played(Arena(), pdf.sort_values("ts", kind="stable"), pdf["symbol"].iloc[0])), schema)


class LiveArena(StatefulProcessor):
    """The account of a symbol as one state value, and the time of its last candle, so that one that comes again does nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.account = handle.getValueState("account", "balance double, peak double, side double, entry double, take double, stop double, quantity double, size double, bars long")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(rows)).sort_values("ts", kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        at = bars["ts"].map(lambda x: x.value)
        bars = bars[~at.duplicated() & ((at > last) if last is not None else True)]
        arena = Arena(*self.account.get()) if self.account.exists() else Arena()
        out = _played(arena, bars, key[0])
        if len(bars):
            self.account.update(astuple(arena))
            self.last.update((int(bars["ts"].iloc[-1].value),))
        yield _frame(out)

    def close(self) -> None:
        pass


def live(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").transformWithStateInPandas(LiveArena(), f"symbol string, ts timestamp, {EVENTS}", "append", "none")
