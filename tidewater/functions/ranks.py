"""Exact ranks and quantiles of columns with few groups: dealt by value, so that no group is one task.

Equal values are counted first, so a hot value is one row. Edges come from approximate quantiles of
each group's values (a bounded sketch); they only decide which rows meet, but the sketch hangs on the
order in which its parts are merged. So edges are computed once and written: a second computation
could deal a value to another bucket than the first. What passes between buckets is one count a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

BUCKETS = 64


def counted(df: DataFrame, by: Sequence[str], x: str, extra: dict | None = None, times: Column | None = None) -> DataFrame:
    """``by..., x, _n, _b, _before``: how often each value stands, its bucket, and how many smaller ones are in buckets before.

    ``extra`` adds aggregates of each value's rows, by name; ``times`` counts them, if a row stands for several.
    """
    there = df.where(F.col(x).isNotNull())
    each = written(there.groupBy(*by, x).agg((F.count("*") if times is None else times).alias("_n"), *[v.alias(k) for k, v in (extra or {}).items()]))
    shares = F.array(*[F.lit(k / BUCKETS) for k in range(1, BUCKETS)])
    edges = written(each.groupBy(*by).agg(F.percentile_approx(x, shares, 10_000).alias("_edges")))
    joined = each.join(edges, list(by)) if by else each.crossJoin(F.broadcast(edges))  # one row
    dealt = joined.withColumn("_b", F.size(F.filter("_edges", lambda e: e <= F.col(x)))).drop("_edges")
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows a group
    sizes = dealt.groupBy(*by, "_b").agg(F.sum("_n").alias("_size")).withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    return dealt.join(sizes, [*by, "_b"])


def below(by: Sequence[str], x: str, what: str = "_n"):
    """Sum of ``what`` over smaller values of the same bucket."""
    return F.coalesce(F.sum(what).over(Window.partitionBy(*by, "_b").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def average_ranks(df: DataFrame, by: Sequence[str], x: str, out: str, times: Column | None = None) -> DataFrame:
    """``df`` with the rank of ``x`` in its group from 1, equal values sharing the mean of theirs; rows without ``x`` go."""
    ranks = counted(df, by, x, times=times).select(*by, x, (F.col("_before") + below(by, x) + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, [*by, x])


def exact_quantiles(df: DataFrame, by: Sequence[str], x: str, shares: dict[str, float]) -> DataFrame:
    """``by...`` and a column for each share: quantiles with linear interpolation."""
    values = counted(df, by, x).withColumn("_from", F.col("_before") + below(by, x)).withColumn("_to", F.col("_from") + F.col("_n"))
    sizes = df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.count("*").alias("_total"))
    each = values.join(F.broadcast(sizes), list(by)) if by else values.crossJoin(F.broadcast(sizes))  # one row a group
    total = F.col("_total") - 1
    at = lambda r: F.max(F.when((F.col("_from") <= r) & (r < F.col("_to")), F.col(x).cast("double")))
    found = each.groupBy(*by).agg(*[y for c, q in shares.items() for y in (at(F.floor(total * q)).alias(f"_l_{c}"), at(F.ceil(total * q)).alias(f"_h_{c}"))], F.max(total).alias("_t"))
    part = lambda q: F.col("_t") * q - F.floor(F.col("_t") * q)
    return found.select(*by, *[(F.col(f"_l_{c}") + part(q) * (F.col(f"_h_{c}") - F.col(f"_l_{c}"))).alias(c) for c, q in shares.items()])
