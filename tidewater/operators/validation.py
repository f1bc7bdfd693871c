"""Purged and embargoed splits, sample uniqueness, resampling by blocks."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def uniqueness(labels: DataFrame, by: list[str], max_hours: int) -> DataFrame:
    """How many label intervals [t0, t1] of the same series overlap each, itself included.

    An equi-join on slots as long as the longest interval, instead of a range join over all rows:
    an interval lies in at most two slots, and a pair counts in the slot where the later begins.
    """
    width = max_hours * 3600
    slot = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width)
    a = labels.withColumn("_s", F.explode(F.sequence(slot("t0"), slot("t1"))))
    b = labels.select(*by, F.col("t0").alias("_b0"), F.col("t1").alias("_b1")).withColumn("_s", F.explode(F.sequence(slot("_b0"), slot("_b1"))))
    later = F.greatest(slot("t0"), slot("_b0"))
    met = a.join(b, [*by, "_s"]).where((F.col("_b0") <= F.col("t1")) & (F.col("_b1") >= F.col("t0")) & (F.col("_s") == later))
    return met.groupBy(*by, "t0", "t1").agg(F.count("*").alias("overlaps")).withColumn("uniqueness", 1 / F.col("overlaps"))


def _embargo(by: list[str], least: int):
    """Bars that an embargo lasts: ``least``, or the 95 % quantile of label lengths in hours, rounded up."""
    hours = (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 3.6e9
    return F.greatest(F.lit(least), F.ceil(F.coalesce(F.percentile(hours, F.lit(0.95)).over(Window.partitionBy(*by)), F.lit(0.0))).cast("int"))


def walk_forward(rows: DataFrame, by: list[str], folds: int, embargo: int, order: list[str]) -> DataFrame:
    """Expanding walk-forward: role of every row in every fold (train, test, purged, embargo).

    Chunk size is n // (folds + 1). A training row whose label ends at or after the test start is
    purged. Rows within the embargo after an earlier test block are left out of training; the
    embargo is raised to the 95 % quantile of label lengths.
    """
    n = F.count("*").over(Window.partitionBy(*by))
    k = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).withColumn("_c", F.floor(n / (folds + 1))).withColumn("_e", _embargo(by, embargo))
    fold = k.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    start, stop = F.col("fold") * F.col("_c"), F.when(F.col("fold") == folds, F.lit(2**62)).otherwise((F.col("fold") + 1) * F.col("_c"))
    first = F.min(F.when(F.col("_i") == start, F.col("t0"))).over(Window.partitionBy(*by, "fold"))
    fold = fold.withColumn("_start", first)
    # an earlier test block j ended at (j + 1) * c; the last of them ends where this one starts
    after = F.pmod(F.col("_i"), F.greatest(F.col("_c"), F.lit(1))) < F.col("_e")
    role = F.when((F.col("_i") >= start) & (F.col("_i") < stop), "test").when(F.col("_i") >= stop, "unused").when(F.col("t1") >= F.col("_start"), "purged")
    role = role.when((F.col("fold") >= 3) & (F.col("_i") >= 2 * F.col("_c")) & after, "embargo").otherwise("train")
    return fold.withColumn("role", role).drop("_i", "_c", "_e", "_start")


def combinatorial(rows: DataFrame, by: list[str], groups: int, tests: int, order: list[str], embargo: int = 24) -> DataFrame:
    """Every choice of ``tests`` of ``groups`` consecutive groups as test set.

    Group k begins at row floor(k n / groups). A row before a test group whose label ends at or
    after its start is purged; rows of the embargo after a test group are left out too.
    """
    whole = Window.partitionBy(*by)
    k = rows.withColumn("_i", F.row_number().over(whole.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(whole)).withColumn("_e", _embargo(by, embargo))
    begin = lambda g: F.floor(F.lit(g) * F.col("_n") / groups)
    k = k.withColumns({f"_t{g}": F.min(F.when(F.col("_i") == begin(g), F.col("t0"))).over(whole) for g in range(groups)})
    splits = [F.struct(F.lit(i).alias("split"), F.array(*map(F.lit, c)).alias("chosen")) for i, c in enumerate(itertools.combinations(range(groups), tests))]
    full = k.withColumn("_x", F.explode(F.array(*splits)))
    has = lambda g: F.array_contains(F.col("_x.chosen"), g)
    none = F.lit(False)
    test = purged = rested = none
    for g in range(groups):
        test = test | (has(g) & (F.col("_i") >= begin(g)) & (F.col("_i") < begin(g + 1)))
        purged = purged | (has(g) & (F.col("t0") < F.col(f"_t{g}")) & (F.col("t1") >= F.col(f"_t{g}")))
        rested = rested | (has(g) & (F.col("_i") >= begin(g + 1)) & (F.col("_i") < begin(g + 1) + F.col("_e")))
    role = F.when(test, "test").when(F.coalesce(purged, none), "purged").when(rested, "embargo").otherwise("train")
    return full.withColumn("split", F.col("_x.split")).withColumn("role", role).drop("_i", "_n", "_e", "_x", *[f"_t{g}" for g in range(groups)])


def three_way(rows: DataFrame, by: list[str], shares: tuple[float, float], embargo: int, order: list[str]) -> DataFrame:
    """Train, validation, test by position, with ``embargo`` rows left out before each border."""
    w = Window.partitionBy(*by)
    k = rows.withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    a, b = F.floor(F.col("_n") * shares[0]), F.floor(F.col("_n") * (shares[0] + shares[1]))
    role = F.when(F.col("_i") <= a - embargo, "train").when(F.col("_i") <= a, "embargo").when(F.col("_i") <= b - embargo, "validation").when(F.col("_i") <= b, "embargo").otherwise("test")
    return k.withColumn("role", role).drop("_i", "_n")


def drawn(draw, block, total):
    """A block number for this draw: hash-based, so any engine can repeat it."""
    return F.pmod((draw * 7919 + block * 104729 + draw * block * 31), total)


def _numbered_blocks(rows: DataFrame, order: list[str], block: int) -> DataFrame:
    return rows.withColumn("_i", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("b", F.floor(F.col("_i") / block))  # one series, reduced to a row an hour


def _draws(blocks: DataFrame, resamples: int) -> DataFrame:
    """``draw, slot, b``: as many whole blocks as there are, drawn for each resample."""
    total = blocks.agg(F.count("*").alias("total"))
    draws = blocks.sparkSession.range(resamples).withColumnRenamed("id", "draw").crossJoin(F.broadcast(total)).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)))  # one row
    return draws.withColumn("b", drawn(F.col("draw"), F.col("slot"), F.col("total")))


def block_bootstrap(rows: DataFrame, value: str, order: list[str], block: int, resamples: int, per_year: float = 8766) -> DataFrame:
    """``draw, mean, sharpe, profit_factor`` of each resample of whole blocks of consecutive rows.

    Rows are first reduced to sums per block, so a resample is a join of block numbers with a few
    numbers a block, never of rows.
    """
    x = F.col(value)
    blocks = _numbered_blocks(rows, order, block).groupBy("b").agg(F.sum(x).alias("s"), F.sum(x * x).alias("ss"), F.sum(F.greatest(x, F.lit(0.0))).alias("up"), F.sum(F.greatest(-x, F.lit(0.0))).alias("down"), F.count(x).alias("n"))
    sums = _draws(blocks, resamples).join(blocks, "b").groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("s", "ss", "up", "down", "n")])
    mean = F.col("s") / F.col("n")
    dev = F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)))
    return sums.select("draw", mean.alias("mean"), (mean / (dev + 1e-8) * per_year**0.5).alias("sharpe"), (F.col("up") / F.greatest(F.lit(1e-6), F.col("down"))).alias("profit_factor"))


def sign_flip(blocks: DataFrame, diff: str, resamples: int) -> DataFrame:
    """Permutation p-value of a mean difference: signs of whole blocks flipped by a hash.

    ``blocks`` has ``b`` and one ``diff`` a block.
    """
    draws = blocks.sparkSession.range(resamples).withColumnRenamed("id", "draw")
    flip = F.when(F.pmod(F.col("draw") * 7919 + F.col("b") * 104729 + F.col("draw") * F.col("b") * 31, F.lit(2)) == 0, 1).otherwise(-1)
    observed = blocks.agg(F.avg(diff).alias("observed"))
    means = blocks.crossJoin(F.broadcast(draws)).groupBy("draw").agg(F.avg(F.col(diff) * flip).alias("m"))
    hits = means.crossJoin(F.broadcast(observed))
    return hits.agg(F.max("observed").alias("observed"), ((F.sum((F.abs("m") >= F.abs("observed")).cast("int")) + 1) / (F.count("*") + 1)).alias("p_value"))


def effective_samples(rows: DataFrame, x: str, order: list[str], block: int) -> DataFrame:
    """``n, rho_1, by_autocorrelation, by_blocks, by_events, degrees_of_freedom`` of one reduced series.

    ``rho_1`` divides the lagged products by the whole sum of squares and is kept within 0.99; the
    size for events uses the correlation of the pairs instead and stays between 10 and n.
    """
    mean = rows.agg(F.avg(x).alias("_m"))
    d = rows.crossJoin(F.broadcast(mean)).withColumn("_d", F.col(x) - F.col("_m")).withColumn("_e", F.lag("_d").over(Window.orderBy(*order)))  # one row; one series of hours
    rho = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.try_divide(F.sum(F.col("_d") * F.col("_e")), F.sum(F.col("_d") * F.col("_d")))))
    a = d.agg(F.count("*").alias("n"), rho.alias("rho_1"), F.corr("_d", "_e").alias("_p"))
    n, r, p = F.col("n"), F.col("rho_1"), F.col("_p")
    whole = lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))
    size = F.greatest(F.lit(2), whole(n * (1 - r) / (1 + r)))
    events = F.greatest(F.lit(10), F.least(n, whole(n * ((1 - p) / (1 + p + 1e-6)))))
    return a.select("n", "rho_1", size.cast("long").alias("by_autocorrelation"), F.greatest(F.lit(2), F.floor(n / block)).cast("long").alias("by_blocks"), events.cast("long").alias("by_events"), (size - 1).cast("long").alias("degrees_of_freedom"))


def independent_blocks(rows: DataFrame, x: str, order: list[str], block: int) -> DataFrame:
    """``block, first_ts, last_ts, n, mean`` of whole blocks of consecutive rows that don't overlap."""
    b = _numbered_blocks(rows, order, block).groupBy(F.col("b").cast("long").alias("block"))
    return b.agg(F.min(order[0]).alias("first_ts"), F.max(order[0]).alias("last_ts"), F.count("*").alias("n"), F.avg(x).alias("mean")).where(F.col("n") == block)


def adjusted(tests: DataFrame, p: str = "p", name: str = "name") -> DataFrame:
    """Holm and Benjamini-Hochberg adjusted p-values of one family (a small table)."""
    m = F.count("*").over(Window.partitionBy())
    up = Window.orderBy(p, name)
    k = tests.withColumn("_i", F.row_number().over(up)).withColumn("_m", m)
    holm = F.least(F.lit(1.0), F.max(F.col(p) * (F.col("_m") - F.col("_i") + 1)).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    bh = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_i")).over(up.rowsBetween(0, Window.unboundedFollowing)))
    return k.withColumn("holm", holm).withColumn("bh", bh).drop("_i", "_m")
