"""Exit policies (genomes) judged over purged folds: take-profit, stop and longest hold in units of ATR, per regime.

A genome owns how long a position is kept and how it is sized; entries come from the forecasts.
It is judged on the bars of its regime in every test fold of a walk-forward split. ``tapes``
builds those bars as a table; a task takes one tape with a chunk of the genomes of its regime.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Regimes, sizing methods and ranges of the genes.
REGIMES = ("TRENDING_BULL", "TRENDING_BEAR", "RANGING", "BREAKOUT", "HIGH_VOLATILITY")
SIZINGS = ("fixed", "vol_target", "prob_scaled")
TAKE, STOP, HOLD = (1.0, 5.0), (0.5, 3.0), (4, 96)
LEAST_BARS, COST, TARGET = 20, 0.001, 0.02
#: Genomes that a task judges on one tape.
CHUNK = 256
TAPE = ["symbol", "fold", "regime"]


def tapes(rows: DataFrame, folds: int = 5) -> DataFrame:
    """``symbol, fold, regime, ts, price, atr, vol, p``: the bars of a regime within each test fold, where there are enough.

    A series of n bars has chunks of n // (folds + 1); fold k tests on chunk k, the last on all that is left.
    """
    w = Window.partitionBy("symbol")
    i, n = F.row_number().over(w.orderBy("ts")) - 1, F.count("*").over(w)
    at = rows.withColumn("_i", i).withColumn("_c", F.floor(n / (folds + 1)))
    at = at.withColumn("fold", F.when(F.col("_c") > 0, F.least(F.floor(F.col("_i") / F.nullif(F.col("_c"), F.lit(0))), F.lit(folds)).cast("int"))).where("fold >= 1")
    enough = (F.count("*").over(Window.partitionBy(*TAPE)) >= LEAST_BARS) & (F.count("*").over(Window.partitionBy("symbol", "fold")) >= LEAST_BARS)
    return at.withColumn("_enough", enough).where("_enough").select(*TAPE, "ts", "price", "atr", "vol", "p")


class Passage:
    """First bars after an entry at or beyond a price, by running extremes of lengths 1, 2, 4, ..."""

    def __init__(self, price: np.ndarray):
        self.n = len(price)
        self.high, self.low = [price], [price]
        while 2 * (step := 1 << len(self.high) - 1) <= self.n:
            a, b = self.high[-1], self.low[-1]
            self.high.append(np.maximum(a[: len(a) - step], a[step:]))
            self.low.append(np.minimum(b[: len(b) - step], b[step:]))

    def first(self, after: np.ndarray, level: np.ndarray, above: bool) -> np.ndarray:
        """Index of the first price past ``after`` that is >= level (or <= level); n where there is none."""
        at, table = after + 1, self.high if above else self.low
        for k in range(len(table) - 1, -1, -1):
            fits = np.flatnonzero(at + (1 << k) <= self.n)
            extreme = table[k][at[fits]]
            idle = extreme < level[fits] if above else extreme > level[fits]
            at[fits[idle]] += 1 << k
        return at


def _last_of_run(value: np.ndarray) -> np.ndarray:
    """For each bar the last bar of its run of equal values."""
    ends = np.flatnonzero(np.append(value[1:] != value[:-1], True))
    return ends[np.searchsorted(ends, np.arange(len(value)))]


def exited(position: np.ndarray, price: np.ndarray, atr: np.ndarray, take: float, stop: float, hold: int, passage: Passage) -> np.ndarray:
    """Positions after the exits.

    Every bar with a position is an entry until one is closed: at the first later bar, the signal
    staying at that full side, whose price is past the take-profit or stop or that is ``hold`` bars
    on. The position is then flat to the end of the side's run. Of a run that reaches the last bar
    only the first entry is followed.
    """
    n, side = len(position), np.sign(position)
    full = np.where(np.abs(position) == 1, position, 0.0)
    run = _last_of_run(full)
    flat_to = _last_of_run(np.where(np.abs(np.abs(position) - 1) < 0.01, side, 0.0))
    i = np.arange(n)
    stays = np.append(full[1:] == side[:-1], False) & (side != 0)
    last = np.where(stays, run[np.minimum(i + 1, n - 1)], i)
    unit = np.where((atr > 0) & np.isfinite(atr), atr, 0.001 * price)
    up = price + unit * np.where(side > 0, take, stop)
    down = price - unit * np.where(side > 0, stop, take)
    exit_at = np.minimum(np.minimum(passage.first(i, up, True), passage.first(i, down, False)), i + hold)
    closes = (side != 0) & (exit_at <= last)
    ends = (side != 0) & ~closes & (last == n - 1)
    stop_walk = np.flatnonzero(closes | ends)
    out, at = position.copy(), 0
    while (k := np.searchsorted(stop_walk, at)) < len(stop_walk):
        e = stop_walk[k]
        if ends[e]:
            break
        at = flat_to[exit_at[e]] + 1
        out[exit_at[e] : at] = 0.0
    return out


def sized(method: str, p: np.ndarray, vol: np.ndarray) -> np.ndarray:
    p = np.where(np.isfinite(p), p, 0.5)
    if method == "fixed":
        return np.where(p > 0.55, 1.0, np.where(p < 0.45, -1.0, 0.0))
    if method == "vol_target":
        return np.clip(np.sign(p - 0.5) * (TARGET / np.maximum(np.where(np.isfinite(vol), vol, 0.01), 1e-6)), -1.0, 1.0)
    return np.clip((p - 0.5) * 2, -1.0, 1.0)


def outcome(price: np.ndarray, position: np.ndarray) -> tuple[float, float, float, float, int]:
    """Sharpe ratio, drawdown (negative), turnover a bar, total return and trades of one tape."""
    held = np.append(0.0, position[:-1])
    change = np.abs(position - held)
    earned = held * np.append(0.0, price[1:] / price[:-1] - 1) - COST * change
    equity = np.cumprod(1 + earned)
    dev = earned.std(ddof=1) if len(earned) > 1 else 0.0
    sharpe = round(float(earned.mean() / dev * math.sqrt(8760)), 4) if dev > 0 else 0.0
    return sharpe, -round(float((1 - equity / np.maximum.accumulate(equity)).max()), 6), float(change.mean()), float(equity[-1] - 1), int((change > 1e-5).sum())


def fold_results(genomes: DataFrame, tape: DataFrame) -> DataFrame:
    """``id, symbol, fold, sharpe, max_drawdown, turnover, total_return, trades`` of each genome on each tape of its regime."""
    chunks = -(-genomes.count() // CHUNK) or 1
    chunk = F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk")
    keys = tape.select(*[F.col(c).alias(c) for c in TAPE]).distinct()
    left = genomes.select("id", "regime", "take", "stop", "hold", "sizing", chunk).join(keys, "regime")
    right = tape.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def judge(genes: pd.DataFrame, bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("ts")
        price, atr, vol, p = (bars[c].to_numpy(dtype=float) for c in ("price", "atr", "vol", "p"))
        passage, base, out = Passage(price), {}, []
        for g in genes.itertuples():
            if g.sizing not in base:
                base[g.sizing] = sized(g.sizing, p, vol)
            out.append((g.id, g.symbol, g.fold, *outcome(price, exited(base[g.sizing], price, atr, g.take, g.stop, int(g.hold), passage))))
        return pd.DataFrame(out, columns=["id", "symbol", "fold", "sharpe", "max_drawdown", "turnover", "total_return", "trades"])

    schema = "id long, symbol string, fold int, sharpe double, max_drawdown double, turnover double, total_return double, trades long"
    return left.groupBy(*TAPE, "chunk").cogroup(right.groupBy(*TAPE, "chunk")).applyInPandas(judge, schema)


def fitness(genomes: DataFrame, rows: DataFrame, folds: int = 5) -> DataFrame:
    """Objectives of each genome as means over its folds; NULL, with no folds, where its regime is too rare.

    ``calmar`` is the mean return over the mean drawdown, ``win_rate`` the share of folds with a
    positive Sharpe ratio, ``thrift`` minus the turnover: all better when larger.
    """
    each = fold_results(genomes, tapes(rows, folds))
    a = each.groupBy("id").agg(
        F.avg("sharpe").alias("sharpe"), F.avg("max_drawdown").alias("max_drawdown"), F.avg("turnover").alias("turnover"), F.avg("total_return").alias("_r"),
        F.avg((F.col("sharpe") > 0).cast("double")).alias("win_rate"), F.sum("trades").alias("trades"), F.count("*").alias("folds"),
    )
    calmar = F.when(F.col("max_drawdown") == 0, 0.0).otherwise(F.try_divide(F.col("_r"), F.abs(F.col("max_drawdown"))))
    out = genomes.select("id").join(a.withColumn("calmar", calmar), "id", "left")
    return out.select("id", "sharpe", "calmar", "win_rate", "max_drawdown", (-F.col("turnover")).alias("thrift"), F.coalesce("trades", F.lit(0)).alias("trades"), F.coalesce("folds", F.lit(0)).alias("folds"))


def seeded(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """A first generation with reproducible genes; regimes in turn."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1_000_000)) / 1e6
    within = lambda span, k: F.lit(span[0]) + u(k) * (span[1] - span[0])
    of = lambda names, x: F.element_at(F.array(*map(F.lit, names)), (x + 1).cast("int"))
    return spark.range(n).select(
        "id", F.lit(0).alias("generation"), of(REGIMES, F.pmod("id", F.lit(len(REGIMES)))).alias("regime"), within(TAKE, 1).alias("take"), within(STOP, 2).alias("stop"),
        F.floor(within((HOLD[0], HOLD[1] + 1), 3)).cast("int").alias("hold"), of(SIZINGS, F.floor(u(4) * len(SIZINGS))).alias("sizing"), F.array().cast("array<long>").alias("parents"),
    )


def bred(generation: DataFrame, best: DataFrame, n: int, seed: int = 42, sigma: float = 0.25) -> DataFrame:
    """``n`` children of pairs within a regime, genes from either parent, then mutated: Gaussian steps in the distances, up to 4 bars of hold, one in ten a new sizing.

    Parents meet by their rank within the regime, so no parent list is gathered in one place but
    ranks of ``best``, which a selection has made small.
    """
    ranked = best.withColumn("_r", F.row_number().over(Window.partitionBy("regime").orderBy("id")) - 1)
    sizes = ranked.groupBy("regime").agg(F.count("*").alias("_n"))
    top = generation.agg(F.max("id")).first()[0] + 1
    h = lambda k: F.xxhash64("child", F.lit(seed), F.lit(k))
    u = lambda k: (F.pmod(h(k), F.lit(1_000_000)) + 0.5) / 1e6
    regime = F.element_at(F.array(*map(F.lit, REGIMES)), (F.pmod("child", F.lit(len(REGIMES))) + 1).cast("int"))
    pairs = generation.sparkSession.range(n).select(F.col("id").alias("child")).withColumn("regime", regime).join(sizes, "regime").withColumn("_a", F.pmod(h(1), F.col("_n"))).withColumn("_b", F.pmod(h(2), F.col("_n")))
    genes = ("id", "take", "stop", "hold", "sizing", "generation")
    for side in "ab":
        pairs = pairs.join(ranked.select("regime", F.col("_r").alias(f"_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in genes]), ["regime", f"_{side}"])
    either = lambda c, k: F.when(F.pmod(h(k), F.lit(2)) == 0, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    gauss = lambda k: F.sqrt(-2 * F.ln(u(k))) * F.cos(2 * math.pi * u(k + 1))
    near = lambda x, span: F.greatest(F.lit(span[0]), F.least(F.lit(span[1]), x))
    fresh = F.element_at(F.array(*map(F.lit, SIZINGS)), (F.pmod(h(30), F.lit(len(SIZINGS))) + 1).cast("int"))
    return pairs.select(
        (F.col("child") + top).alias("id"), (F.greatest("a_generation", "b_generation") + 1).alias("generation"), "regime", near(either("take", 3) + sigma * gauss(10), TAKE).alias("take"),
        near(either("stop", 4) + sigma * gauss(20), STOP).alias("stop"), near(either("hold", 5) + F.pmod(h(40), F.lit(9)) - 4, HOLD).cast("int").alias("hold"),
        F.when(u(50) < 0.1, fresh).otherwise(either("sizing", 6)).alias("sizing"), F.array("a_id", "b_id").alias("parents"),
    )
