"""Path-dependent operators: what happens at a row depends on decisions at earlier rows.

Those over bars are one grouped, Arrow-batched pass per series, which is bounded. Those over raw
ticks hold no series in memory: Hawkes intensities forget, so they are computed in blocks of time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions.blocks import micros, time_blocks
from ..functions.windows import Key, series_pass


def _per_series(rows: DataFrame, by: list[str], order: list[str], fields: list[StructField], run) -> DataFrame:
    return series_pass(rows, fields, run, Key(tuple(by), tuple(order)))


def cusum(rows: DataFrame, by: list[str], order: list[str], x: str, threshold: float) -> DataFrame:
    """Symmetric CUSUM filter with reset: ``cusum_event`` is 1, -1 or 0."""

    def run(pdf: pd.DataFrame):
        up = down = 0.0
        out = []
        for v in pdf[x].fillna(0.0).to_numpy():
            up, down = max(0.0, up + v), min(0.0, down + v)
            if up > threshold:
                out.append(1)
                up = 0.0
            elif down < -threshold:
                out.append(-1)
                down = 0.0
            else:
                out.append(0)
        return [out]

    return _per_series(rows, by, order, [StructField("cusum_event", LongType())], run)


def max_hold(rows: DataFrame, by: list[str], order: list[str], signal: str, bars: int) -> DataFrame:
    """Hold a position at most ``bars`` bars; a new signal of the other side restarts."""

    def run(pdf: pd.DataFrame):
        pos, left, out = 0.0, 0, []
        for s in pdf[signal].fillna(0.0).to_numpy():
            if s and s != pos:
                pos, left = s, bars
            elif pos:
                left -= 1
                if left <= 0:
                    pos = 0.0
            out.append(pos)
        return [out]

    return _per_series(rows, by, order, [StructField("held", DoubleType())], run)


def exit_policy(rows: DataFrame, by: list[str], order: list[str], position: str, atr: str, take: float = 2.0, stop: float = 1.0, hold: int = 24) -> DataFrame:
    """``held``, the position after exits, and ``exit_reason`` where one ends: TP, SL, TIME, FLIP or FLAT.

    A position opens where the signal turns from flat or to the other side. It ends on the first
    close beyond take-profit or stop (in units of ATR at entry, or 0.1 % of the price without one)
    or after ``hold`` bars; then it stays flat until the signal changes. A signal that flips or
    goes flat ends it too, checked first.
    """

    def run(pdf: pd.DataFrame):
        side = entry = unit = 0.0
        age, done = 0, False
        held, why = [], []
        for s, c, a in zip(pdf[position].fillna(0.0), pdf["close"], pdf[atr], strict=True):
            now, reason = float(np.sign(s)), None
            if now != side:
                if side and not done:
                    reason = "FLIP" if now else "FLAT"
                side, entry, unit, age, done = now, c, a if a == a and a > 0 else 0.001 * c, 0, False
            elif side and not done:
                age += 1
                move = side * (c - entry)
                reason = "TP" if move >= take * unit else "SL" if move <= -stop * unit else "TIME" if age >= hold else None
                done = reason is not None
            held.append(0.0 if done else float(s))
            why.append(reason)
        return [held, why]

    return _per_series(rows, by, order, [StructField("held", DoubleType()), StructField("exit_reason", StringType())], run)


#: Fixed values of the intensities: base rates, excitation of row by column, decay of each row a second (buy, sell, liquidity, volatility).
MU = (0.5, 0.5, 0.3, 0.1)
ALPHA = ((0.25, 0.05, 0.10, 0.15), (0.05, 0.25, 0.10, 0.15), (0.10, 0.10, 0.20, 0.10), (0.20, 0.20, 0.15, 0.30))
BETA = (1.5, 1.5, 1.0, 2.0)
HAWKES = ("lambda_buy", "lambda_sell", "lambda_liquidity", "lambda_volatility", "buy_sell_intensity_ratio", "event_pressure", "event_cluster_score")


def _decayed(t: np.ndarray, jump: np.ndarray, beta: float, width: float = 250.0) -> np.ndarray:
    """Sum of the jumps before each time, each decayed by exp(-beta x age); times ascend and begin near 0.

    Within segments of ``width`` seconds by running sums; only the segment before reaches into the
    next (exp(-250) of the rest is left).
    """
    segment = np.floor(t / width).astype(np.int64)
    tau = t - segment * width
    grown = pd.Series(jump * np.exp(beta * tau)).groupby(segment).cumsum().to_numpy()
    ends = np.r_[segment[1:] != segment[:-1], True]
    after = dict(zip(segment[ends].tolist(), (grown[ends] * np.exp(-beta * width)).tolist(), strict=True))
    before = np.array([after.get(int(s) - 1, 0.0) for s in segment])
    own = np.r_[0.0, np.where(ends[:-1], 0.0, grown[:-1])]
    return (own + before) * np.exp(-beta * tau)


def hawkes(events: DataFrame, width: int = 21_600_000_000) -> DataFrame:
    """``event_id`` and seven measures of four-dimensional Hawkes intensities of one stream of order-book events.

    Trades excite as buys or sells by their sign, quote updates as liquidity, the rest as
    volatility; an event's own jump starts with the next event, the first has the base rates.
    Events are dealt to blocks of six hours with the ten minutes before them, beyond which nothing
    is left of a jump.
    """
    kind = F.when(F.col("kind") == "trade", F.when(F.col("signed_volume") > 0, 0).otherwise(1)).when(F.col("kind").isin("bid_update", "ask_update", "depth_update"), 2).otherwise(3)
    dealt = time_blocks(events.select("event_id", "ts", kind.alias("_kind")), width, before=600_000_000).select("event_id", "_us", "_kind", "_own", "_block")
    schema = "event_id long, " + ", ".join(f"{c} double" for c in HAWKES)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_us", "event_id"], kind="stable")
        t = (pdf["_us"].to_numpy() - int(pdf["_us"].iloc[0])) / 1e6
        kinds = pdf["_kind"].to_numpy()
        felt = {b: [_decayed(t, (kinds == j).astype(float), b) for j in range(4)] for b in {*BETA}}
        rate = np.array([MU[i] + sum(ALPHA[i][j] * felt[BETA[i]][j] for j in range(4)) for i in range(4)])
        values = [*rate, rate[0] / (rate[1] + 1e-6), rate[0] - rate[1], rate.sum(axis=0) / sum(MU)]
        out = pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), **dict(zip(HAWKES, values, strict=True))})
        return out[pdf["_own"].to_numpy()]

    return dealt.groupBy("_block").applyInPandas(run, schema)
