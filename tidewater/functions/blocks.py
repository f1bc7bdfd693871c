"""Windows over raw ticks without one task a series: blocks of rows or of time, with a halo.

A series of ticks has few keys and no bound on its rows. Rows are dealt to blocks by time or by
their number in the series; rows that a neighbouring block's windows need are copied to it, and
the copies are dropped afterwards. What passes from block to block is a few numbers a block.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def in_buckets(df: DataFrame, width: int) -> DataFrame:
    """``df`` with ``_us`` and the number ``_b`` of its bucket of ``width`` microseconds."""
    return df.withColumn("_us", micros()).withColumn("_b", F.floor(F.col("_us") / width).cast("long"))


def numbered(df: DataFrame, by: Sequence[str], tie: str, width: int = 3_600_000_000) -> DataFrame:
    """``df`` with ``_us`` and ``_rn``, a row's number in its series from 0, by time and ``tie``.

    Rows are numbered within buckets of time; only the counts of buckets are summed in order.
    """
    dealt = in_buckets(df, width)
    within = Window.partitionBy(*by, "_b").orderBy("_us", tie)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    sizes = dealt.groupBy(*by, "_b").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return dealt.withColumn("_k", F.row_number().over(within)).join(sizes, [*by, "_b"]).withColumn("_rn", F.col("_before") + F.col("_k") - 1).drop("_b", "_k", "_before")


def row_blocks(df: DataFrame, size: int, halo: int) -> DataFrame:
    """Numbered rows in blocks ``_block`` of ``size``, each with the ``halo`` rows before it; ``_own`` marks its own."""
    own = F.floor(F.col("_rn") / size).cast("long")
    places = F.array_compact(F.array(own, F.when(F.col("_rn") % size >= size - halo, own + 1)))
    return df.withColumn("_block", F.explode(places)).withColumn("_own", F.col("_block") == own)


def time_blocks(df: DataFrame, width: int, before: int = 0, after: int = 0) -> DataFrame:
    """Rows in buckets ``_block`` of ``width`` microseconds, each with the rows up to ``before`` and ``after`` microseconds outside it.

    Neither may exceed ``width``.
    """
    place = F.col("_us") - F.col("_b") * width
    places = F.array_compact(F.array(F.col("_b"), F.when(place >= width - before, F.col("_b") + 1), F.when(place <= after, F.col("_b") - 1)))
    return in_buckets(df, width).withColumn("_block", F.explode(places)).withColumn("_own", F.col("_block") == F.col("_b")).drop("_b")


def _range_best(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, best) -> np.ndarray:
    """``best`` (a maximum or minimum) of x[lo:hi] for ranges that are not empty, from tables over 1, 2, 4, ... rows; others hold anything."""
    level, out = np.frexp(np.maximum(hi - lo, 1))[1] - 1, np.empty(len(x))
    for k in range(int(level.max(initial=0)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = best(x[np.minimum(lo[at], len(x) - 1)], x[np.maximum(hi[at] - (1 << k), 0)])
        x = best(x, np.r_[x[1 << k :], x[len(x) - (1 << k) :]]) if len(x) > 1 << k else x
    return out


def forward_extremes(df: DataFrame, by: str, x: str, seconds: Sequence[int]) -> DataFrame:
    """``event_id`` and, for each horizon, rows, highest and lowest ``x`` strictly after a row up to so many seconds (at most 1800).

    Work grows with rows times the logarithm of a block's rows, however dense the ticks are.
    """
    dealt = time_blocks(df, 6 * 3_600_000_000, after=1_800_000_000).select("event_id", by, F.col(x).cast("double").alias("_x"), "_us", "_own", "_block")
    schema = "event_id long, " + ", ".join(f"n_{h} long, max_{h} double, min_{h} double" for h in seconds)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_us")
        us, own = rows["_us"].to_numpy(), rows["_own"].to_numpy()
        there = rows["_x"].is_valid().to_numpy()
        value = rows["_x"].to_numpy()  # missing ones are NaN
        seen = np.r_[0, np.cumsum(there)]
        lo, out = np.searchsorted(us, us, side="right"), {"event_id": rows["event_id"].filter(rows["_own"])}
        for h in seconds:
            hi = np.searchsorted(us, us + h * 1_000_000, side="right")
            none = (seen[hi] == seen[lo])[own]
            high, low = _range_best(np.where(there, value, -np.inf), lo, hi, np.maximum), _range_best(value, lo, hi, np.fmin)  # NaN is the largest, as in Spark
            out |= {f"n_{h}": pa.array((hi - lo)[own]), f"max_{h}": pa.array(high[own], mask=none), f"min_{h}": pa.array(low[own], mask=none)}
        return pa.table(out)

    return dealt.groupBy(by, "_block").applyInArrow(run, schema)
