"""Quantile regressions by sums: nothing near the fitted model has a lower loss."""

import numpy as np
import pandas as pd
import pytest

from tidewater.operators import quantiles


def loss(b, x, y, q, penalty):
    e = y - x @ b[:-1] - b[-1]
    return np.maximum(q * e, (q - 1) * e).mean() + penalty * np.abs(b[:-1]).sum()


@pytest.mark.parametrize("penalty", [0.0, 0.01, 0.2])
def test_no_model_nearby_is_better(spark, penalty):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 3))
    y = 0.3 + 0.5 * x[:, 0] + rng.exponential(0.5 + 0.2 * (x[:, 1] > 0), 1500)
    table = spark.createDataFrame(pd.DataFrame(np.c_[x, y], columns=["a", "b", "c", "y"])).repartition(5)
    models, mean = quantiles.fitted(table, ["a", "b", "c"], "y", penalty=penalty)
    for q, b in zip(quantiles.QUANTILES, models, strict=True):
        best = loss(b, x, y, q, penalty)
        near = [loss(b + step * rng.normal(size=4) * rng.integers(0, 2, 4), x, y, q, penalty) for step in (0.3, 0.1, 0.03, 0.01, 0.003) for _ in range(400)]
        assert best <= min(near) + 1e-5
        assert (y < x @ b[:-1] + b[-1]).mean() == pytest.approx(q, abs=0.01)
    if penalty == 0.2:
        assert models[2][1] == models[2][2] == 0.0  # features that say nothing get none
    centred = x - x.mean(axis=0)
    want = np.linalg.solve(centred.T @ centred + np.eye(3), centred.T @ (y - y.mean()))
    np.testing.assert_allclose(mean, [*want, y.mean() - x.mean(axis=0) @ want], rtol=1e-6)


def test_distribution_never_crosses_and_takes_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.normal()), float(abs(rng.normal()))) for i in range(400)] + [(1000, None, 1.0), (1001, 0.5, None), (1001, 0.5, None)]
    table = spark.createDataFrame(rows, "id long, f double, mfe double")
    got = quantiles.excursion_distribution(table, table, ["f"], "mfe").toPandas()
    five = got[[f"p{k}_mfe" for k in (10, 25, 50, 75, 90)]].to_numpy()
    assert len(got) == 403 and (np.diff(five, axis=1) >= 0).all() and (got.exp_mfe >= 0).all()
    np.testing.assert_allclose(got.interval_width, five[:, 4] - five[:, 0])
    nothing = quantiles.excursion_distribution(table.limit(0), table, ["f"], "mfe").toPandas()
    assert len(nothing) == 403 and (nothing.exp_mfe == 0).all()
