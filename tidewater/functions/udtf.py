"""Table function of a forecast's path, for SQL users."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="step int, projected double, band_high double, band_low double")
class ForecastPath:
    """A row a step from a price, median and 90 % moves and a direction; see ``operators.forecast.path``."""

    def eval(self, price: float, up: float, down: float, high: float, low: float, direction: str, steps: int) -> Iterator[tuple]:
        drift = up if direction == "BULLISH" else -down if direction == "BEARISH" else 0.0
        for k in range(1, steps + 1):
            share = k / steps
            yield k, price * (1 + drift * share), price * (1 + high * share**0.5), price * (1 - low * share**0.5)


def register(spark: SparkSession) -> None:
    spark.udtf.register("forecast_path", ForecastPath)
