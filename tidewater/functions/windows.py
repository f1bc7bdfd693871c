"""Window building blocks: rolling with a least count, forward frames, ranks, exponential means.

All take a ``Key`` (partition columns and order columns), so every series is its own
partition. Frames are explicit row frames; results are NULL, never NaN.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


@dataclass(frozen=True)
class Key:
    by: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts",)

    def base(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def last(self, k: int) -> WindowSpec:
        """This row and the k - 1 before it."""
        return self.base().rowsBetween(-(k - 1), 0)

    def before(self, k: int) -> WindowSpec:
        """The k rows before this one."""
        return self.base().rowsBetween(-k, -1)

    def after(self, k: int) -> WindowSpec:
        """The k rows after this one."""
        return self.base().rowsBetween(1, k)

    def so_far(self) -> WindowSpec:
        return self.base().rowsBetween(Window.unboundedPreceding, 0)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.by)


BARS = Key()


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rolling(agg, x: str | Column, frame: WindowSpec, least: int) -> Column:
    """``agg(x)`` over the frame where it has at least ``least`` values."""
    x = col(x)
    return F.when(F.count(x).over(frame) >= least, agg(x).over(frame))


def sma(x, k: int, key: Key = BARS, least: int | None = None) -> Column:
    return rolling(F.avg, x, key.last(k), k if least is None else least)


def rolling_std(x, k: int, key: Key = BARS, least: int | None = None, population: bool = False) -> Column:
    return rolling(F.stddev_pop if population else F.stddev_samp, x, key.last(k), k if least is None else least)


def zscore(x, k: int, key: Key = BARS, population: bool = False) -> Column:
    return F.try_divide(col(x) - sma(x, k, key), F.nullif(rolling_std(x, k, key, population=population), F.lit(0.0)))


def past_zscore(x, k: int, least: int, key: Key = BARS) -> Column:
    """Against the rows before this one only."""
    w = key.before(k)
    return F.try_divide(col(x) - rolling(F.avg, x, w, least), F.nullif(rolling(F.stddev_samp, x, w, least), F.lit(0.0)))


def lag(x, k: int = 1, key: Key = BARS) -> Column:
    return F.lag(col(x), k).over(key.base())


def lead(x, k: int = 1, key: Key = BARS) -> Column:
    return F.lead(col(x), k).over(key.base())


def log_return(x, k: int = 1, key: Key = BARS) -> Column:
    return F.ln(F.try_divide(col(x), lag(x, k, key)))


def pct_change(x, k: int = 1, key: Key = BARS) -> Column:
    return F.try_divide(col(x), lag(x, k, key)) - 1


def forward(agg, x, k: int, key: Key = BARS) -> Column:
    """``agg(x)`` over the next k rows, only if all of them are there."""
    return rolling(agg, x, key.after(k), k)


def forward_fill(x, key: Key = BARS) -> Column:
    return F.last(col(x), ignorenulls=True).over(key.so_far())


def backward_fill(x, key: Key = BARS) -> Column:
    return F.first(col(x), ignorenulls=True).over(key.base().rowsBetween(0, Window.unboundedFollowing))


def clip(x, low, high) -> Column:
    """NULL stays NULL (greatest and least alone would skip it)."""
    return F.when(col(x).isNotNull(), F.least(F.greatest(col(x), F.lit(low)), F.lit(high)))


def average_rank(x, by: tuple[str, ...] = ()) -> Column:
    """Rank from 1 with the mean rank for ties; NULL ranks NULL."""
    part = Window.partitionBy(*by, F.col(x).isNull()) if by else Window.partitionBy(F.col(x).isNull())
    peers = Window.partitionBy(*by, x)
    return F.when(F.col(x).isNotNull(), F.rank().over(part.orderBy(x)) + (F.count("*").over(peers) - 1) / 2)


def percent_share(x, by: tuple[str, ...] = ("symbol",)) -> Column:
    """Average rank as a share of the values present."""
    return average_rank(x, by) / F.count(x).over(Window.partitionBy(*by))


def drawdown(equity, key: Key = BARS) -> Column:
    """Share lost against the highest equity so far (0 at a new high)."""
    top = F.max(col(equity)).over(key.so_far())
    return F.try_divide(top - col(equity), top)


@dataclass(frozen=True)
class Ewm:
    """One exponential mean: of ``column`` to ``out``, NULL before ``least`` values.

    ``adjust`` weighs by the geometric series (bias-corrected); otherwise the recursion starts
    from the first value. ``deviation`` gives the bias-corrected standard deviation instead.
    """

    column: str
    alpha: float
    out: str
    least: int = 1
    adjust: bool = False
    deviation: bool = False


def span(k: float) -> float:
    return 2 / (k + 1)


def series_pass(df: DataFrame, fields: list[StructField], run, key: Key = BARS) -> DataFrame:
    """Add columns that only a pass over an ordered series gives; ``run(frame)`` gives their values.

    A group is one series of bars, which is bounded (ten years of hours are 90,000 rows).
    """
    kept = [f for f in df.schema.fields if f.name not in {x.name for x in fields}]

    def go(pdf):
        pdf = pdf.sort_values(list(key.order), kind="stable").reset_index(drop=True)
        for f, values in zip(fields, run(pdf), strict=True):
            pdf[f.name] = values
        return pdf[[f.name for f in (*kept, *fields)]]

    return df.groupBy(*key.by).applyInPandas(go, StructType([*kept, *fields]))


def ewms(df: DataFrame, specs: list[Ewm], key: Key = BARS) -> DataFrame:
    """Several exponential means in one pass over each series; leading NULLs are skipped."""

    def run(pdf):
        for x in specs:
            w = pdf[x.column].astype(float).ewm(alpha=x.alpha, adjust=x.adjust, min_periods=x.least)
            yield w.std() if x.deviation else w.mean()

    return series_pass(df, [StructField(x.out, DoubleType()) for x in specs], run, key)


def expanding_quantiles(df: DataFrame, column: str, shares: dict[str, float], least: int, key: Key = BARS) -> DataFrame:
    """Quantiles of all rows so far, one column each, NULL before ``least`` values; a skip list a series."""

    def run(pdf):
        for q in shares.values():
            yield pdf[column].astype(float).expanding(min_periods=least).quantile(q)

    return series_pass(df, [StructField(c, DoubleType()) for c in shares], run, key)
