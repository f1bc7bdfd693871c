"""Resampling of blocks: draws dealt to tasks, each one product of a weight matrix with the blocks' summaries.

A series is reduced to a few numbers a block (a day of hours, say), so what every task gets grows
with the series' length in blocks, not with rows; more than ``MOST`` blocks are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 200_000
#: Draws that a task works on at once.
CHUNK = 256
TINY = 1e-8


def _small(df: DataFrame) -> pd.DataFrame:
    out = df.limit(MOST + 1).toPandas()
    if len(out) > MOST:
        raise ValueError(f"over {MOST} blocks")
    return out


def picks(draw: np.ndarray, total: int) -> np.ndarray:
    """Block numbers of each draw (rows), by a hash that any engine can repeat."""
    d, s = draw.astype(np.int64)[:, None], np.arange(total, dtype=np.int64)[None, :]
    return (d * 7919 + s * 104729 + d * s * 31) % total


def orders(draw: np.ndarray, total: int) -> np.ndarray:
    """A permutation of the blocks for each draw, by the order of a hash."""
    d, b = draw.astype(np.int64)[:, None], np.arange(total, dtype=np.int64)[None, :]
    return np.argsort((d * 7919 + b * 104729 + d * b * 31) % 1_000_003, axis=1, kind="stable")


def _over_draws(spark, resamples: int, work, schema: str) -> DataFrame:
    """``work(draw numbers) -> columns`` over all draws, some hundreds a call."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), CHUNK):
                draw = pdf["draw"].to_numpy()[at : at + CHUNK]
                yield pd.DataFrame({"draw": draw, **work(draw)})

    return spark.range(resamples).withColumnRenamed("id", "draw").mapInPandas(run, schema)


def series_blocks(rows: DataFrame, value: str, order: list[str], block: int) -> DataFrame:
    """Sums, and the shape of the log equity within each block: its end, highest and lowest point and deepest fall."""
    i = F.row_number().over(Window.orderBy(*order)) - 1  # one series, reduced to a row an hour
    w = Window.partitionBy("b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(value)
    e = rows.withColumn("_i", i).withColumn("b", F.floor(F.col("_i") / block)).withColumn("_e", F.sum(F.log1p(F.greatest(x, F.lit(-0.999999)))).over(w)).withColumn("_top", F.max("_e").over(w))
    down = F.when(x < 0, x)
    return e.groupBy("b").agg(
        F.sum(x).alias("s"), F.sum(x * x).alias("ss"), F.sum(F.greatest(x, F.lit(0.0))).alias("up"), F.coalesce(F.sum(down), F.lit(0.0)).alias("sd"), F.coalesce(F.sum(down * down), F.lit(0.0)).alias("ssd"),
        F.count(down).alias("nd"), F.count(x).alias("n"), F.max_by("_e", "_i").alias("e"), F.max("_e").alias("top"), F.min("_e").alias("low"), F.max(F.col("_top") - F.col("_e")).alias("dd"),
    )


def bootstrap(rows: DataFrame, value: str, order: list[str], block: int, resamples: int, per_year: float = 8766) -> DataFrame:
    """``draw, mean, sharpe, sortino, profit_factor, max_drawdown`` of each resample of whole blocks.

    Sums are a weight matrix (how often a draw has each block) times the blocks' sums. Drawdowns
    of two stretches in a row combine, so all draws of a task go through their blocks in the drawn
    order side by side; the equity's first value counts as its first peak.
    """
    blocks = _small(series_blocks(rows, value, order, block).orderBy("b"))
    total, sums = len(blocks), blocks[["s", "ss", "up", "sd", "ssd", "nd", "n"]].to_numpy(dtype=float)
    end, top, low, deep = (blocks[c].to_numpy(dtype=float) for c in ("e", "top", "low", "dd"))

    def work(draw: np.ndarray) -> dict[str, np.ndarray]:
        pick = picks(draw, total)
        weight = np.zeros((len(draw), total))
        np.add.at(weight, (np.arange(len(draw))[:, None], pick), 1.0)
        s, ss, up, sd, ssd, nd, n = (weight @ sums).T
        mean = s / n
        dev = np.sqrt(np.maximum(ss / n - mean**2, 0))
        with np.errstate(invalid="ignore", divide="ignore"):
            down = np.where(nd > 0, np.sqrt(np.maximum(ssd / nd - (sd / nd) ** 2, 0)) + TINY, 1e-6)
        level, peak, fall = np.zeros(len(draw)), np.full(len(draw), -np.inf), np.zeros(len(draw))
        for k in pick.T:
            fall = np.maximum(np.maximum(fall, deep[k]), peak - level - low[k])
            peak = np.maximum(peak, level + top[k])
            level = level + end[k]
        root = per_year**0.5
        return {"mean": mean, "sharpe": mean / (dev + TINY) * root, "sortino": mean / down * root, "profit_factor": np.where(up > 0, up, 1e-6) / np.maximum(1e-6, np.abs(sd)), "max_drawdown": 1 - np.exp(-fall)}

    return _over_draws(rows.sparkSession, resamples if total else 0, work, "draw long, mean double, sharpe double, sortino double, profit_factor double, max_drawdown double")


def auc_bootstrap(blocks: DataFrame, resamples: int) -> DataFrame:
    """``draw, auc`` of blocks ``b`` drawn with their counts ``p, n, py`` (a score, its rows, its positives).

    Scores of a probability have few values; the counts are one matrix, blocks by scores.
    """
    p = _small(blocks)
    wide = lambda c: p.pivot_table(index="b", columns="p", values=c, aggfunc="sum", fill_value=0).sort_index().to_numpy(dtype=float)
    n, py = wide("n"), wide("py")

    def work(draw: np.ndarray) -> dict[str, np.ndarray]:
        weight = np.zeros((len(draw), len(n)))
        np.add.at(weight, (np.arange(len(draw))[:, None], picks(draw, len(n))), 1.0)
        rows, hits = weight @ n, weight @ py
        rank = np.cumsum(rows, axis=1) - rows + (rows + 1) / 2
        pos, neg = hits.sum(axis=1), (rows - hits).sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return {"auc": ((rank * hits).sum(axis=1) - pos * (pos + 1) / 2) / (pos * neg)}

    return _over_draws(blocks.sparkSession, resamples if len(p) else 0, work, "draw long, auc double")


def auc_permutation(series: DataFrame, order: list[str], block: int, resamples: int) -> DataFrame:
    """``draw, auc, observed``: labels ``y`` in permuted blocks against forecasts ``p`` in place; rows after the last whole block go.

    Areas are NULL where all labels are alike; ``as_high`` (the positives' rank sum is at least the
    observed one) is known even then.

    ``series`` is a reduced series (a row a day), of which a task holds the ranks.
    """
    s = _small(series.select(*order, "p", "y").orderBy(*order))
    s = s.iloc[: len(s) // block * block]
    rank, y = s["p"].rank().to_numpy(), s["y"].to_numpy(dtype=float).reshape(-1, block) if len(s) else np.zeros((0, block))
    pos = y.sum()
    area = lambda sums: (sums - pos * (pos + 1) / 2) / (pos * (len(s) - pos)) if 0 < pos < len(s) else sums * np.nan
    real = float(y.reshape(-1) @ rank)

    def work(draw: np.ndarray) -> dict[str, np.ndarray]:
        sums = (y[orders(draw, len(y))].reshape(len(draw), -1) * rank).sum(axis=-1)
        return {"auc": area(sums), "observed": area(np.full(len(draw), real)), "as_high": sums >= real}

    return _over_draws(series.sparkSession, resamples if len(s) else 0, work, "draw long, auc double, observed double, as_high boolean")


def paired(diff: DataFrame, value: str, order: list[str], block: int, resamples: int) -> DataFrame:
    """``draw, mean`` of a paired difference over resampled blocks."""
    return bootstrap(diff, value, order, block, resamples).select("draw", "mean")


def interval(draws: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Mean and 95 % interval of each column over the draws."""
    at = lambda c, q: F.round(F.percentile(c, F.lit(q)), digits)
    cells: list[Column] = []
    for c in columns:
        cells += [F.round(F.avg(c), digits).alias(f"{c}_mean"), at(c, 0.025).alias(f"{c}_low"), at(c, 0.975).alias(f"{c}_high")]
    return draws.agg(*cells)
