"""Exponential means and deviations of series of any length, as a prefix scan over blocks of rows.

What a block does to the state that comes in is a short summary (weights, mean, spread, gaps), and
summaries combine. So three passes do: summaries of blocks, a scan over the summaries of a series
(a row for each 8192 rows), and the blocks again, each from its own incoming state.

Conventions: a missing value repeats the last result, and the weight of older values goes on
decaying; results are NULL before ``least`` values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.shared import written
from .blocks import numbered
from .windows import Ewm

SIZE = 8192
#: State: values so far, rows since the last value, recursive mean; sum of weights, of their squares, mean and weighted squared deviations.
STATE = ("count", "gap", "level", "d", "dd", "mean", "spread")
EMPTY = (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)


def _decayed(values: np.ndarray, a: float) -> np.ndarray:
    """Sum of a^(age) times the values so far, at each row."""
    n = np.arange(1, len(values) + 1)
    return pd.Series(values).ewm(alpha=1 - a, adjust=True).mean().to_numpy() * (1 - a**n) / (1 - a)


def _through(x: pd.Series, spec: Ewm, state: tuple[float, ...]) -> tuple[np.ndarray, tuple[float, ...]]:
    """Results at each row of a block that is entered with ``state``, and the state after it."""
    count, gap, level, d, dd, mean, spread = state
    a, n, there = 1 - spec.alpha, len(x), x.notna().to_numpy()
    seen = count + np.cumsum(there)
    last = int(np.flatnonzero(there)[-1]) if there.any() else -1
    since = gap + n if last < 0 else n - 1 - last
    if spec.adjust or spec.deviation:
        age = np.arange(1, n + 1)
        own_d, own_dd = _decayed(there.astype(float), a), _decayed(there.astype(float), a * a)
        w = x.ewm(alpha=spec.alpha, adjust=True)
        own_mean, own_spread = w.mean().fillna(0.0).to_numpy(), w.var(bias=True).fillna(0.0).to_numpy() * own_d
        old_d = d * a**age
        all_d, all_dd = old_d + own_d, dd * a ** (2 * age) + own_dd
        with np.errstate(invalid="ignore", divide="ignore"):
            all_mean = (old_d * mean + own_d * own_mean) / all_d
            all_spread = spread * a**age + own_spread + old_d * own_d / all_d * (mean - own_mean) ** 2
            result = np.sqrt(np.maximum(all_spread / all_d * all_d**2 / (all_d**2 - all_dd), 0)) if spec.deviation else all_mean
        result = np.where(seen >= (max(spec.least, 2) if spec.deviation else spec.least), result, np.nan)
        # between values both means stay, and so do these ratios
        after = (float(seen[-1]), float(since), level, *(float(v[-1]) if seen[-1] else 0.0 for v in (all_d, all_dd, all_mean, all_spread)))
        return result, after
    # a carried level is one value before the block, whose weight has decayed over the gap
    lead = [level, *[np.nan] * min(int(gap), 4000)] if count else []
    run = pd.concat([pd.Series(lead, dtype=float), x.astype(float)], ignore_index=True).ewm(alpha=spec.alpha, adjust=False).mean().to_numpy()[len(lead) :]
    result = np.where(seen >= spec.least, run, np.nan)
    return result, (float(seen[-1]), float(since), float(run[-1]) if seen[-1] else 0.0, d, dd, mean, spread)


def _summary(x: pd.Series, spec: Ewm) -> list[float]:
    """What the block does to any state: for weights its own state alone; for the recursion, its first value, where it stands, and the affine map of the rest."""
    there = np.flatnonzero(x.notna().to_numpy())
    if spec.adjust or spec.deviation:
        return [float(len(x)), *_through(x, spec, EMPTY)[1]]
    if not len(there):
        return [float(len(x)), 0.0, float(len(x)), 0.0, 0.0, 0.0, 0.0, 0.0]
    first = int(there[0])
    rest = x.iloc[first:].reset_index(drop=True)
    gaps = np.diff(there).astype(float)
    slope = float(np.prod((1 - spec.alpha) ** gaps / ((1 - spec.alpha) ** gaps + spec.alpha)))
    end = float(rest.astype(float).ewm(alpha=spec.alpha, adjust=False).mean().iloc[-1])
    start = float(rest.iloc[0])
    return [float(len(x)), float(len(there)), float(len(x) - 1 - there[-1]), float(first), start, slope, end - slope * start, 0.0]


def _onward(state: tuple[float, ...], s: list[float], spec: Ewm) -> tuple[float, ...]:
    """The state after a block, from the state before it and the block's summary."""
    count, gap, level, d, dd, mean, spread = state
    a = 1 - spec.alpha
    if spec.adjust or spec.deviation:
        n, own_count, own_gap, _, own_d, own_dd, own_mean, own_spread = s
        old = d * a**n
        both = old + own_d
        if not both:
            return count + own_count, gap + n, level, 0.0, 0.0, mean if own_count == 0 else own_mean, 0.0
        return count + own_count, own_gap if own_count else gap + n, level, both, dd * a ** (2 * n) + own_dd, (old * mean + own_d * own_mean) / both, spread * a**n + own_spread + old * own_d / both * (mean - own_mean) ** 2
    n, own_count, own_gap, first, start, slope, shift, _ = s
    if not own_count:
        return count, gap + n, level, d, dd, mean, spread
    if count:
        kept = a ** (gap + first + 1)
        start = (kept * level + spec.alpha * start) / (kept + spec.alpha)
    return count + own_count, own_gap, slope * start + shift, d, dd, mean, spread


def ewm_scan(df: DataFrame, specs: list[Ewm], by: list[str], tie: str, size: int = SIZE) -> DataFrame:
    """Add exponential means or deviations of series ``by`` in the order of ``ts`` and ``tie``, whatever their length."""
    dealt = written(numbered(df, by, tie).withColumn("_block", F.floor(F.col("_rn") / size).cast("long")))
    at = [*by, "_block"]
    keys = [dealt.schema[c] for c in by]
    columns = list(dict.fromkeys(s.column for s in specs))
    numbers = lambda names: [StructField(c, DoubleType()) for c in names]
    parts = [f"s{i}_{j}" for i in range(len(specs)) for j in range(8)]

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn")
        values = [v for s in specs for v in _summary(pdf[s.column].astype(float).reset_index(drop=True), s)]
        return pd.DataFrame([[*pdf[at].iloc[0], *values]], columns=[*at, *parts])

    block = dealt.schema["_block"]
    summaries = dealt.select(*at, "_rn", *columns).groupBy(*at).applyInPandas(summarise, StructType([*keys, block, *numbers(parts)]))
    states = [f"i{i}_{c}" for i in range(len(specs)) for c in STATE]

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, held, out = pdf.sort_values("_block"), [EMPTY] * len(specs), []
        for row in pdf[parts].to_numpy():
            out.append([v for h in held for v in h])
            held = [_onward(h, row[8 * i : 8 * i + 8].tolist(), s) for i, (h, s) in enumerate(zip(held, specs, strict=True))]
        return pd.concat([pdf[at].reset_index(drop=True), pd.DataFrame(out, columns=states)], axis=1)

    entered = written(summaries.groupBy(*by).applyInPandas(scan, StructType([*keys, block, *numbers(states)])))
    kept = [f for f in df.schema.fields if f.name not in {s.out for s in specs}]

    def finish(state: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn").reset_index(drop=True)
        results = {s.out: _through(pdf[s.column].astype(float), s, tuple(state[[f"i{i}_{c}" for c in STATE]].iloc[0]))[0] for i, s in enumerate(specs)}
        return pdf.assign(**results)[[*[f.name for f in kept], *[s.out for s in specs]]]

    out = entered.groupBy(*at).cogroup(dealt.groupBy(*at)).applyInPandas(finish, StructType([*kept, *numbers([s.out for s in specs])]))
    return out.select(*[f.name for f in kept], *[F.nanvl(s.out, F.lit(None).cast("double")).alias(s.out) for s in specs])
