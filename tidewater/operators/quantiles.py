"""Linear quantile regressions by sums over all rows, and the distribution of excursions they give."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .forecast import non_crossing

QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)


def _sums(rows: DataFrame, models: np.ndarray | None, count: int, wide: int, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """X'WX, X'Wy and X'1 for ``count`` weightings in one pass; a task gives one value an entry.

    Weights are 1 over a row's distance from each model (``near`` is added), or 1 without models.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(count * wide * (wide + 1) + wide)
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            x, y = np.column_stack([*columns[:-1], np.ones(len(columns[-1]))]), columns[-1]
            parts = []
            for k in range(count):
                w = np.ones(len(y)) if models is None else 1 / (near + np.abs(y - x @ models[k]))
                parts += [((x * w[:, None]).T @ x).ravel(), x.T @ (w * y)]
            total += np.concatenate([*parts, x.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    found = rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()  # one row an entry
    flat = np.zeros(count * wide * (wide + 1) + wide)
    flat[found.i.to_numpy()] = found.v.to_numpy()
    each = flat[:-wide].reshape(count, wide * (wide + 1))
    return each[:, : wide * wide].reshape(count, wide, wide), each[:, wide * wide :], flat[-wide:]


def fitted(rows: DataFrame, features: list[str], y: str, quantiles: tuple[float, ...] = QUANTILES, penalty: float = 0.01, ridge: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients, the intercept last: a row a quantile, and those of the ridge regression.

    A quantile's have the least mean pinball loss plus ``penalty`` times their absolute sum (not the
    intercept's). Each round replaces both by parabolas that touch them at the present model from
    above, so that sums over all rows give the next one; rounds end when models rest. Rows without
    a target or with a null feature don't count; without any row all coefficients are 0.
    """
    table = written(rows.select(*[F.col(c).cast("double") for c in features], F.col(y).cast("double")).dropna())
    wide, q = len(features) + 1, np.array(quantiles)
    (square,), (cross,), ones = _sums(table, None, 1, wide, 0.0)
    n = ones[-1]
    if not n:
        return np.zeros((len(q), wide)), np.zeros(wide)
    slopes = np.r_[np.ones(wide - 1), 0.0]
    mean = np.linalg.solve(square + np.diag(ridge * slopes + 1e-12), cross)
    models, scale = np.tile(mean, (len(q), 1)), max(float(np.abs(mean).max()), 1e-9)
    for k in range(rounds):
        near = scale * max(1e-7, 0.1 * 0.6**k)
        squares, crosses, _ = _sums(table, models, len(q), wide, near)
        pull = 2 * n * penalty / (near + np.abs(models)) * slopes
        after = np.stack([np.linalg.solve(a + np.diag(p + 1e-12), c + (2 * at - 1) * ones) for a, c, p, at in zip(squares, crosses, pull, q, strict=True)])
        moved, models = np.abs(after - models).max(), after
        if near <= 1e-6 * scale and moved < 1e-6 * scale:
            break
    models[np.abs(models) < 1e-6 * scale] = 0.0
    return models, mean


def excursion_distribution(train: DataFrame, rows: DataFrame, features: list[str], y: str) -> DataFrame:
    """``rows`` with the five quantiles of ``y``, its expectation, the interval's width and the uncertainty.

    Features are scaled by the mean and deviation of ``train``; a missing one counts as the mean.
    Quantiles never cross, the expectation is never below 0.
    """
    got = train.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in features for f in (F.avg, F.stddev_pop)]).first()
    scaled = {f"_z_{c}": F.coalesce((F.col(c) - F.lit(got[f"avg_{c}"])) / F.lit((got[f"stddev_pop_{c}"] or 0.0) + 1e-6), F.lit(0.0)) for c in features}
    models, mean = fitted(train.withColumns(scaled), list(scaled), y)
    line = lambda b: sum((F.col(c) * float(v) for c, v in zip(scaled, b[:-1], strict=True)), F.lit(float(b[-1])))
    names = [f"p{round(100 * q)}_mfe" for q in QUANTILES]
    out = rows.withColumns(scaled).withColumns({"exp_mfe": F.greatest(F.lit(0.0), line(mean)), **{c: line(b) for c, b in zip(names, models, strict=True)}}).drop(*scaled)
    out = non_crossing(out, names)
    out = out.drop(*names).withColumnsRenamed({f"{c}_sorted": c for c in names}).withColumn("interval_width", F.col(names[-1]) - F.col(names[0]))
    return out.withColumn("uncertainty_score", F.col("interval_width") / (F.col("exp_mfe") + 1e-6))
