"""Blocks of a few rows against whole series: cooldown by jump maps, exponential means by scan; balance of tasks."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from tidewater.functions import scans
from tidewater.functions.windows import Ewm
from tidewater.operators import jumps

START = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("size, wait", [(16, 40), (32, 4000), (64, 900)])
def test_cooldown_equals_one_pass(spark, size, wait):
    rnd = random.Random(size + wait)
    rows = []
    for key, n, step in (("a", 160, 30), ("b", 40, 600), (None, 20, 5), ("c", 1, 1)):
        t = 0
        for _ in range(n):
            t += rnd.choice((0, 0, 1, step, 3 * step))
            rows.append((len(rows), START + dt.timedelta(seconds=t), key, "clash"))
    rows += [(9000, None, "a", "x"), (9001, None, "z", "x")]
    want, last = set(), {}
    for i, ts, key, _ in sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[0])):
        if key not in last or (ts - last[key]).total_seconds() >= wait:
            want.add(i)
            last[key] = ts
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, kind string, _block string").repartition(3)
    got = jumps.cooldown(df, "kind", "event_id", wait, size)
    assert got.columns == df.columns and sorted(r.event_id for r in got.collect()) == sorted(want)
    assert jumps.cooldown(df.limit(0), "kind", "event_id", wait, size).count() == 0


SPECS = [Ewm("x", 0.1, "m"), Ewm("x", 0.3, "late", 5), Ewm("x", 0.05, "adj", 3, adjust=True), Ewm("x", 0.02, "dev", 4, deviation=True, adjust=True)]


@pytest.mark.parametrize("size, gaps", [(3, 0.0), (16, 0.3), (16, 0.95), (1, 0.4)])
def test_scan_equals_whole_series(spark, size, gaps):
    rnd = random.Random(size)
    rows = [(i, START + dt.timedelta(seconds=60 * i), k, None if rnd.random() < gaps else 1e4 + rnd.gauss(0, 1) + i / 50) for k in ("a", "b") for i in range(120 if k == "a" else 37)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, kind string, x double").repartition(3)
    got = scans.ewm_scan(df, SPECS, ["kind"], "event_id", size).toPandas()
    whole = pd.DataFrame(rows, columns=["event_id", "ts", "kind", "x"])
    assert len(got) == len(whole)
    for k, g in whole.groupby("kind"):
        mine = got[got.kind == k].sort_values("event_id")
        for s in SPECS:
            w = g.x.astype(float).ewm(alpha=s.alpha, adjust=s.adjust or s.deviation, min_periods=s.least)
            want = (w.std() if s.deviation else w.mean()).to_numpy()
            have = mine[s.out].astype(float).to_numpy()
            assert (np.isnan(have) == np.isnan(want)).all() and np.nanmax(np.abs(np.nan_to_num(have) - np.nan_to_num(want))) < 1e-6


def test_one_key_spreads_over_tasks(spark):
    df = spark.range(20_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.lit("a").alias("kind"))
    assert jumps.cooldown(df, "kind", "event_id", 100, 256).count() == -(-20_000 // 15)
    from tidewater.functions.blocks import numbered

    blocks = numbered(df, ["kind"], "event_id").withColumn("_block", F.floor(F.col("_rn") / 256)).repartition(16, "kind", "_block")
    loads = [n for n in blocks.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]
    assert len(loads) >= 12 and TaskContext.get() is None


def test_forward_extremes_of_dense_ticks(spark):
    from tidewater.functions import blocks

    rng = random.Random(3)
    rows = [(i, dt.datetime(2024, 1, 1, 5, 50) + dt.timedelta(seconds=rng.randrange(1500)), "a" if i % 3 else None, None if i % 7 == 0 else rng.choice([1.0, -2.0, 5.5, math.nan])) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, kind string, v double")
    out = blocks.forward_extremes(df, "kind", "v", (1, 60))
    for r in out.collect():
        _, t, kind, _ = rows[r.event_id]
        for h in (1, 60):
            after = [x[3] for x in rows if x[2] == kind and 0 < (x[1] - t).total_seconds() <= h]
            there = [math.inf if x != x else x for x in after if x is not None]
            back = lambda x: None if x is None else math.inf if x != x else x
            assert (r[f"n_{h}"], back(r[f"max_{h}"]), back(r[f"min_{h}"])) == (len(after), max(there, default=None), min(there, default=None))
    assert out.count() == 400 and blocks.forward_extremes(df.limit(0), "kind", "v", (1, 60)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # frames folded anew for each row cost rows times a frame's rows
