"""Forecast and classification metrics as aggregates over columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .ranks import average_ranks, below, counted


def pinball(y: Column, forecast: Column, q: float) -> Column:
    d = y - forecast
    return F.avg(F.greatest(q * d, (q - 1) * d))


def brier(p: Column, y: Column) -> Column:
    return F.avg((y - p) * (y - p))


def winkler(y: Column, low: Column, high: Column, alpha: float = 0.2) -> Column:
    """Interval width plus 2/alpha times the distance outside; one row's score."""
    return high - low + F.when(y < low, 2 / alpha * (low - y)).when(y > high, 2 / alpha * (y - high)).otherwise(0.0)


def winkler_relative(y: Column, low: Column, high: Column, price: Column, alpha: float = 0.2) -> Column:
    """The same as a share of the price."""
    return F.try_divide(winkler(y, low, high, alpha), price)


def winkler_flat(y: Column, low: Column, high: Column, penalty: float = 2.0) -> Column:
    """Width, with a flat multiple of the miss instead of 2/alpha."""
    return high - low + penalty * F.greatest(low - y, y - high, F.lit(0.0))


def auc(df: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve by rank sums, exact with ties; NULL if a class is missing.

    Ranks come from counts per distinct score, dealt by score.
    """
    there = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    per = counted(there, by, score, {"_p": F.sum(F.col(label).cast("long"))})
    ranked = per.withColumn("_rank", F.col("_before") + below(by, score) + (F.col("_n") + 1) / 2)
    out = ranked.groupBy(*by).agg(F.sum(F.col("_rank") * F.col("_p")).alias("_s"), F.sum("_p").alias("positives"), F.sum(F.col("_n") - F.col("_p")).alias("negatives"))
    value = F.try_divide(F.col("_s") - F.col("positives") * (F.col("positives") + 1) / 2, F.nullif(F.col("positives") * F.col("negatives"), F.lit(0)))
    return out.withColumn("auc", value).drop("_s")


def auc_one_vs_rest(df: DataFrame, scores: dict[str, str], label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the areas of each class against the rest; ``scores`` names the score column of each class."""
    out = None
    for value, column in scores.items():
        one = auc(df.withColumn("_y", (F.col(label) == value).cast("int")), column, "_y", by).select(*by, F.col("auc").alias("_one"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*by).agg(F.avg("_one").alias("auc"))


def spearman(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rank correlation per group: average ranks, then Pearson; NaN where a side is constant.

    Equal pairs are counted first and ranked as one row; ranks have the mean (n + 1) / 2.
    """
    pairs = written(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count("*").alias("_m")))
    sizes = pairs.groupBy(*by).agg(F.sum("_m").alias("n"))
    each = average_ranks(average_ranks(pairs, by, x, "_x", F.sum("_m")), by, y, "_y", F.sum("_m"))
    each = each.join(F.broadcast(sizes), list(by)) if by else each.crossJoin(F.broadcast(sizes))  # one row a group
    dx, dy = F.col("_x") - (F.col("n") + 1) / 2, F.col("_y") - (F.col("n") + 1) / 2
    sums = each.groupBy(*by, "n").agg(F.sum(F.col("_m") * dx * dy).alias("_xy"), F.sqrt(F.sum(F.col("_m") * dx * dx)).alias("_sx"), F.sqrt(F.sum(F.col("_m") * dy * dy)).alias("_sy"))
    spread = F.col("_sx") * F.col("_sy")
    return sums.select(*by, F.when(spread > 0, F.col("_xy") / spread).otherwise(float("nan")).alias("ic"), "n")


def brier_classes(probabilities: list[Column], label: Column) -> Column:
    """Mean over rows of the squared errors of all classes; ``label`` is the class's number."""
    return F.avg(sum(((p - F.when(label == k, 1.0).otherwise(0.0)) * (p - F.when(label == k, 1.0).otherwise(0.0)) for k, p in enumerate(probabilities)), F.lit(0.0)))


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Equal-width bins, left-closed, the last one closed on both sides."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"), F.count("*").alias("n"))


def calibration_error(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over strictly right-open bins: p = 1 is in none, but counts in n."""
    b = F.when(F.col(p) < 1, F.floor(F.col(p) * bins)).cast("int")
    per = df.groupBy(b.alias("bin")).agg(F.avg(p).alias("m"), F.avg(F.col(y).cast("double")).alias("r"), F.count("*").alias("n"))
    total = F.sum("n")
    return per.agg((F.sum(F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("m") - F.col("r")))) / total).alias("ece"), total.alias("n"))


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """Accuracy, balanced accuracy, macro precision, recall and F1, and MCC, from the class counts."""
    cells = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(F.col(y).alias("y"), F.col(p).alias("p")).count()
    per_y = cells.groupBy(F.col("y").alias("k")).agg(F.sum("count").alias("t"), F.sum(F.when(F.col("y") == F.col("p"), F.col("count")).otherwise(0)).alias("c"))
    per_p = cells.groupBy(F.col("p").alias("k")).agg(F.sum("count").alias("s"))
    k = per_y.join(per_p, "k", "full").select("k", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("t", "c", "s")])
    k = k.withColumn("pr", F.coalesce(F.try_divide(F.col("c"), F.nullif(F.col("s"), F.lit(0))), F.lit(0.0))).withColumn("re", F.coalesce(F.try_divide(F.col("c"), F.nullif(F.col("t"), F.lit(0))), F.lit(0.0)))
    f1 = F.coalesce(F.try_divide(2 * F.col("pr") * F.col("re"), F.nullif(F.col("pr") + F.col("re"), F.lit(0.0))), F.lit(0.0))
    n, c = F.sum("t").cast("double"), F.sum("c").cast("double")
    cov = c * n - F.sum(F.col("t") * F.col("s")).cast("double")
    spread = F.sqrt((n * n - F.sum(F.col("t") * F.col("t"))) * (n * n - F.sum(F.col("s") * F.col("s"))))
    return k.agg((c / n).alias("accuracy"), F.avg(F.when(F.col("t") > 0, F.col("re"))).alias("balanced_accuracy"), F.avg("pr").alias("precision"), F.avg("re").alias("recall"), F.avg(f1).alias("f1"), F.try_divide(cov, F.nullif(spread, F.lit(0.0))).alias("mcc"))


def entropy(df: DataFrame, column: str) -> DataFrame:
    """Shannon entropy in bits and as a share of its maximum."""
    per = df.groupBy(column).count()
    p = F.col("count") / F.col("total")
    shares = per.crossJoin(F.broadcast(per.agg(F.sum("count").alias("total"))))  # one row
    h = -F.sum(p * F.log2(p))
    return shares.agg(h.alias("bits"), F.try_divide(h, F.nullif(F.log2(F.count("*").cast("double")), F.lit(0.0))).alias("normalised"))


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """In nats, from joint counts of two discrete columns."""
    joint = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("n"))
    nx, ny = F.sum("n").over(Window.partitionBy(x)), F.sum("n").over(Window.partitionBy(y))
    total = joint.agg(F.sum("n").alias("total"))
    each = joint.withColumn("nx", nx).withColumn("ny", ny).crossJoin(F.broadcast(total))  # one row
    return each.agg(F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))).alias("mi"))


def kolmogorov_smirnov(a: DataFrame, b: DataFrame, x: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Largest distance of two empirical distributions, by counts per distinct value, dealt by value."""
    both = a.select(*by, x, F.lit(1).alias("_a")).unionByName(b.select(*by, x, F.lit(0).alias("_a")))
    per = counted(both, by, x, {"_k": F.sum("_a")})
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    firsts = per.groupBy(*by, "_b").agg(F.sum("_k").alias("_s")).withColumn("_ka", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    sums = per.groupBy(*by).agg(F.sum("_k").alias("n_a"), F.sum(F.col("_n") - F.col("_k")).alias("n_b"))
    each = per.join(firsts, [*by, "_b"])
    each = each.join(F.broadcast(sums), list(by)) if by else each.crossJoin(F.broadcast(sums))  # one row a group
    up_to = F.col("_before") + below(by, x) + F.col("_n")
    ones = F.col("_ka") + below(by, x, "_k") + F.col("_k")
    gap = F.abs(F.try_divide(ones, F.nullif(F.col("n_a"), F.lit(0))) - F.try_divide(up_to - ones, F.nullif(F.col("n_b"), F.lit(0))))
    return each.withColumn("_d", gap).groupBy(*by).agg(F.max("_d").alias("ks"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))


#: Most common values of a column whose ranks are broadcast, if the column has too many for all.
COMMON = 1000


def kolmogorov_tail(x: Column, terms: int = 100) -> Column:
    """P(K > x) of the Kolmogorov distribution: 2 sum over k of (-1)^(k-1) exp(-2 k^2 x^2); 1 below 0.2, where it is 1 to ten digits."""
    each = F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * F.aggregate(each, F.lit(0.0), lambda a, b: a + b))))


def drift(base: DataFrame, current: DataFrame, x: str, by: tuple[str, ...] = (), least: int = 15) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test with its asymptotic p-value, and the relative shift of the mean, with a status each.

    A side of fewer than ``least`` rows, or none, tests as no drift.
    """
    k = kolmogorov_smirnov(base, current, x, by)
    both = base.select(*by, x, F.lit(True).alias("_a")).unionByName(current.select(*by, x, F.lit(False).alias("_a")))
    means = both.groupBy(*by).agg(F.avg(F.when(F.col("_a"), F.col(x))).alias("_b"), F.avg(F.when(~F.col("_a"), F.col(x))).alias("_c"))
    few, a, b = F.least("n_a", "n_b") < least, F.col("n_a").cast("double"), F.col("n_b").cast("double")
    out = k.join(means, list(by)) if by else k.crossJoin(F.broadcast(means))  # one row
    out = out.withColumn("p_value", F.when(few, 1.0).otherwise(kolmogorov_tail(F.sqrt(a * b / (a + b)) * F.col("ks")))).withColumn("ks", F.when(few, 0.0).otherwise(F.col("ks")))
    out = out.withColumn("mean_shift", F.abs(F.col("_c") - F.col("_b")) / F.greatest(F.col("_b"), F.lit(1e-4)))
    status = lambda bad, odd: F.when(bad, "ALERT").when(odd, "WATCH").otherwise("NORMAL")
    p, m = F.col("p_value"), F.col("mean_shift")
    return out.select(*by, F.col("n_a").alias("n_base"), F.col("n_b").alias("n_current"), "ks", "p_value", status(p < 0.01, p < 0.05).alias("status"), "mean_shift", status(m > 0.4, m > 0.2).alias("shift_status"))


#: Most distinct values of a column whose ranks are broadcast.
FEW = 1_000_000


def ranked(rows: DataFrame, columns: list[str], few: int = FEW) -> DataFrame:
    """Each column replaced by its average ranks over all rows, NULL staying NULL.

    ``rows`` are read once a column to count its values, and once more. A column of at most ``few``
    values gets its ranks by a broadcast of these. For any other the most common values are broadcast
    and the rows with the rest shuffled once by value, so that a common value stays spread.
    """
    held = rows.select(*[F.col(c).cast("double").alias(c) for c in columns])
    values = [held.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("_n")).select(F.lit(c).alias("c"), "v", "_n") for c in columns]
    each = counted(reduce(DataFrame.unionAll, values), ["c"], "v", times=F.sum("_n"))
    ranks = written(each.select("c", "v", "_n", (F.col("_before") + below(["c"], "v") + (F.col("_n") + 1) / 2).alias("rank")))
    sizes = {r["c"]: r["count"] for r in ranks.groupBy("c").count().collect()}  # a row a column
    many = [c for c in columns if sizes.get(c, 0) > few]
    of = lambda c, out: ranks.where(F.col("c") == c).select(F.col("v").alias(c), F.col("rank").alias(out), "_n")
    for c in (c for c in columns if c not in many):
        held = held.join(F.broadcast(of(c, "_r").drop("_n")), c, "left").drop(c).withColumnRenamed("_r", c)
    for c in many:
        common = of(c, "_h").orderBy(F.desc("_n"), c).limit(COMMON).drop("_n")
        held = held.join(F.broadcast(common), c, "left")
        apart = F.when(F.col("_h").isNull() & F.col(c).isNotNull(), 0).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(COMMON)))  # rows that need no rank go anywhere
        held = held.withColumn("_s", apart.cast("int")).join(of(c, "_r").drop("_n").withColumn("_s", F.lit(0)).hint("shuffle_hash"), [c, "_s"], "left")
        held = held.withColumn("_r", F.coalesce("_h", "_r")).drop(c, "_s", "_h").withColumnRenamed("_r", c)
    return held.select(*columns)


def _products(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's counts, means, squares and products about the mean of every pair, over rows that have both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(columns)
        origin, total, n = np.full(k, np.nan), np.zeros((3, k, k)), np.zeros((k, k))
        for b in batches:
            x = np.stack([b[c].to_numpy(zero_copy_only=False) for c in columns])
            there = np.stack([b[c].is_valid().to_numpy(zero_copy_only=False) if b[c].null_count else np.ones(len(b), bool) for c in columns])
            for i in np.flatnonzero(np.isnan(origin) & there.any(axis=1)):
                origin[i] = x[i, there[i]][0]  # any value near the others: sums about it lose few digits, and none if all are alike
            d = x - origin[:, None]
            if there.all():
                n += len(b)
                total += np.stack([np.broadcast_to(d.sum(axis=1)[:, None], (k, k)), np.broadcast_to((d * d).sum(axis=1)[:, None], (k, k)), d @ d.T])
                continue
            d, has = np.where(there, d, 0.0), there.astype(float)
            n += has @ has.T
            total += np.stack([d @ has.T, (d * d) @ has.T, d @ d.T])
        i, j = np.triu_indices(k, 1)
        i, j = i[n[i, j] > 0], j[n[i, j] > 0]
        m, (s, q, p) = n[i, j], total
        yield pa.RecordBatch.from_pydict({
            "a": i.astype("i4"), "b": j.astype("i4"), "n": m, "x": origin[i] + s[i, j] / m, "y": origin[j] + s[j, i] / m,
            "xx": q[i, j] - s[i, j] ** 2 / m, "yy": q[j, i] - s[j, i] ** 2 / m, "xy": p[i, j] - s[i, j] * s[j, i] / m,
        })

    return run


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``feature_a, feature_b, rho`` of every pair of columns over rows that have both: NULL without any, NaN if a column is constant there.

    A task multiplies matrices of a batch's rows, so that pairs cost little beside reading a row;
    what tasks have found (a row a pair) is put together about the common mean.
    """
    numbers = rows.select(*[F.col(c).cast("double").alias(c) for c in columns])
    parts = numbers.mapInArrow(_products(columns), "a int, b int, n double, x double, y double, xx double, yy double, xy double")
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])

    def both(s: Column, t: Column) -> Column:
        n, dx, dy = s["n"] + t["n"], t["x"] - s["x"], t["y"] - s["y"]
        f = s["n"] * t["n"] / n
        return F.struct(n.alias("n"), (s["x"] + dx * t["n"] / n).alias("x"), (s["y"] + dy * t["n"] / n).alias("y"), (s["xx"] + t["xx"] + dx * dx * f).alias("xx"), (s["yy"] + t["yy"] + dy * dy * f).alias("yy"), (s["xy"] + t["xy"] + dx * dy * f).alias("xy"))

    sums = parts.groupBy("a", "b").agg(F.aggregate(F.collect_list(F.struct("n", "x", "y", "xx", "yy", "xy")), start, both).alias("z"))
    spread = F.sqrt(F.col("z.xx")) * F.sqrt(F.col("z.yy"))
    found = sums.select("a", "b", F.when(spread == 0, float("nan")).otherwise(F.col("z.xy") / spread).alias("rho"))
    pairs = [F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.lit(columns[i]).alias("feature_a"), F.lit(columns[j]).alias("feature_b")) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    every = rows.sparkSession.range(1).select(F.explode(F.array(*pairs)).alias("_x")).select("_x.*")
    return every.join(found, ["a", "b"], "left").select("feature_a", "feature_b", "rho")
