"""Ticks to bars, data audits, and as-of joins on knowledge time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.blocks import in_buckets
from ..functions.windows import BARS, Key


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def bars_from_ticks(ticks: DataFrame, every: str = "hour", symbol: str = "event_type", value: str = "value") -> DataFrame:
    """Open, high, low, close, volume and count per symbol and interval; empty intervals are absent.

    One partial aggregation before one shuffle on (symbol, interval); ``available_time`` is when
    the bar is known, its end.
    """
    first, last = F.struct("ts", "event_id"), F.struct("ts", "event_id")
    out = ticks.groupBy(F.col(symbol).alias("symbol"), F.date_trunc(every, "ts").cast("timestamp_ntz").alias("bar")).agg(
        F.min_by(value, first).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, last).alias("close"), F.sum(value).alias("volume"), F.count("*").alias("n")
    )
    return out.withColumnRenamed("bar", "ts").withColumn("available_time", F.expr(f"ts + interval 1 {every}"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(events(spark, sf_dir))


def asof_backward(left: DataFrame, right: DataFrame, values: list[str], by: list[str], on: str = "available_time", tolerance: str | None = None, slot: str = "day") -> DataFrame:
    """Left outer as-of join: each left row gets the newest right row at or before its time.

    Both sides are stacked within slots of time, right rows first on ties, and the last right
    value is carried forward: one shuffle on ``by`` and slot, so that neither a hot key nor a
    missing one makes a single task. What holds at the start of a slot is the newest right row of
    all slots before, found over one row a slot. With ``tolerance`` (an interval) older matches
    become NULL. Of right rows of equal time the largest counts.
    """
    packed = F.struct(F.col(on).alias("_at"), *values)
    names, at = left.columns, F.date_trunc(slot, F.col("_t"))
    a = left.select(F.struct(*names).alias("_left"), *by, F.col(on).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType).alias("_right")).withColumn("_slot", at)
    b = right.where(F.col(on).isNotNull()).select(F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), *by, F.col(on).alias("_t"), F.lit(0).alias("_side"), packed.alias("_right")).withColumn("_slot", at)
    slots = a.select(*by, "_slot", F.lit(None).cast(b.schema["_right"].dataType).alias("_right")).unionByName(b.select(*by, "_slot", "_right")).groupBy(*by, "_slot").agg(F.max("_right").alias("_right"))
    so_far = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # a row a slot
    carried = slots.withColumn("_right", F.last("_right", ignorenulls=True).over(so_far)).where("_right is not null")
    carried = carried.select(F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), *by, F.col("_slot").cast(a.schema["_t"].dataType).alias("_t"), F.lit(-1).alias("_side"), "_right", "_slot")
    w = Window.partitionBy(*by, "_slot").orderBy("_t", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    held = a.unionByName(b).unionByName(carried).withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    fresh = F.lit(True) if tolerance is None else F.expr(f"_t - _right._at <= interval {tolerance}")
    return held.select("_left.*", *[F.when(fresh, F.col(f"_right.{v}")).alias(v) for v in values])


def audit(df: DataFrame, step: str = "1 hour", key: Key = BARS) -> DataFrame:
    """Rows, range, expected rows, coverage, gaps over 1.5 steps, duplicates and availability faults per series."""
    gap = F.unix_seconds(F.col("ts").cast("timestamp")) - F.lag(F.unix_seconds(F.col("ts").cast("timestamp"))).over(key.base())
    s = F.expr(f"unix_seconds(timestamp'1970-01-01 00:00:00Z' + interval {step})")
    with_gap = df.withColumn("_gap", gap)
    out = with_gap.groupBy(*key.by).agg(
        F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.sum(F.when(F.col("_gap") > 1.5 * s, 1).otherwise(0)).alias("gaps"), (F.count("*") - F.count_distinct("ts")).alias("duplicates"),
        F.sum(F.when(F.col("available_time") < F.col("ts"), 1).otherwise(0)).alias("availability_faults"),
    )
    span = F.unix_seconds(F.col("last_ts").cast("timestamp")) - F.unix_seconds(F.col("first_ts").cast("timestamp"))
    out = out.withColumn("expected", F.floor(span / s).cast("long") + 1)
    return out.withColumn("coverage", F.col("rows") / F.col("expected"))


def keep_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order (deterministic, unlike dropDuplicates)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop columns that are NULL throughout (one aggregate), then rows with any NULL."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c] or not any(counts)]).dropna("any")


def islands(df: DataFrame, flag: Column, key: Key = BARS) -> DataFrame:
    """Runs of consecutive rows where ``flag`` holds: start, end and length of each."""
    w = key.base()
    marked = df.withColumn("_on", F.coalesce(flag, F.lit(False)))
    marked = marked.withColumn("_new", F.when(F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False)), 1).otherwise(0))
    marked = marked.withColumn("run", F.sum("_new").over(key.so_far())).where("_on")
    return marked.groupBy(*key.by, "run").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("bars"))


def clusters(ticks: DataFrame, seconds: float, by: str = "event_type", width: int = 86_400_000_000) -> DataFrame:
    """Sessions of ticks with gaps of at most ``seconds`` (gaps and islands).

    Ticks are compared within buckets of time; the last tick before a bucket and the number of
    clusters begun before it come from one row a bucket.
    """
    dealt = in_buckets(ticks, width)
    w = Window.partitionBy(by, "_b").orderBy("_us", "event_id")
    before = Window.partitionBy(by).orderBy("_b")  # a row a bucket
    ends = dealt.groupBy(by, "_b").agg(F.max("_us").alias("_end")).withColumn("_last", F.lag("_end").over(before)).drop("_end")
    gap = F.col("_us") - F.coalesce(F.lag("_us").over(w), F.col("_last"))
    marked = dealt.join(ends, [by, "_b"]).withColumn("_new", F.when(gap <= int(seconds * 1e6), 0).otherwise(1))
    begun = marked.groupBy(by, "_b").agg(F.sum("_new").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = marked.join(begun, [by, "_b"]).withColumn("cluster", F.col("_before") + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.groupBy(by, "cluster").agg(F.count("*").alias("events"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.sum("value").alias("total"))


def l2_events(ticks: DataFrame) -> DataFrame:
    """Order-book events with the columns of a level-2 feed, derived from each event alone.

    The driver's events have no quotes: prices come from the value, depths from the ids; purchases
    buy and clicks sell.
    """
    half = (F.col("event_id") % 7 + 1) * 0.005
    side = F.when(F.col("event_type") == "purchase", F.col("value")).when(F.col("event_type") == "click", -F.col("value")).otherwise(0.0)
    kind = F.when(F.col("event_type").isin("purchase", "click"), "trade").when(F.col("event_type") == "view", "depth_update").otherwise("imbalance_change")
    return ticks.select(
        "event_id", "ts", kind.alias("kind"), (F.col("value") - half).alias("bid"), (F.col("value") + half).alias("ask"), (F.col("user_id") % 13 + 1).cast("double").alias("depth_bid"),
        (F.col("event_id") % 11 + 1).cast("double").alias("depth_ask"), side.alias("signed_volume"), ((F.col("event_id") % 21 - 10) / 10.0).alias("imbalance"),
    )
