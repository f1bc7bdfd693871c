"""Forecast ledgers: keyed upserts, guarded inserts, resolution of outcomes, blocks and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], version: list[Column]) -> DataFrame:
    """INSERT OR REPLACE on an append-only table: the newest row of each key."""
    w = Window.partitionBy(*key).orderBy(*version)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def insert_new(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """INSERT OR IGNORE: rows whose key the table lacks, appended."""
    return table.unionByName(rows.join(table, key, "left_anti"), allowMissingColumns=True)


def update(table: DataFrame, changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keyed UPDATE: changed columns where a change exists, also to NULL; other rows stay."""
    new = changes.select(*key, F.struct(*columns).alias("_new"), F.lit(True).alias("_hit"))
    joined = table.join(new, key, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def delete(table: DataFrame, condition: Column) -> DataFrame:
    """Predicate DELETE with SQL's three values: a row goes only where the condition is true."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def first_of_their_keys(records: DataFrame, by: list[str], path: str) -> DataFrame:
    """``records`` with ``duplicate``: its id or its time stood in an earlier record of the ledger that is no duplicate.

    A duplicate adds no keys. In each round the records that are first of both keys are accepted,
    and what shares a key with them is a duplicate; the rest goes on. Rounds are written to
    ``path``, so a lost executor costs one of them. Needs ``id, ts, seq``; ``seq`` is unique.
    """
    spark, rest, k = records.sparkSession, records, 0
    while True:
        place = F.struct("ts", "seq")
        marked = rest.withColumn("_a", F.min(place).over(Window.partitionBy(*by, "id")) == place).withColumn("_b", F.min(place).over(Window.partitionBy(*by, "ts")) == place)
        marked = marked.withColumn("_ok", F.col("_a") & F.col("_b"))
        met = F.max("_ok").over(Window.partitionBy(*by, "id")) | F.max("_ok").over(Window.partitionBy(*by, "ts"))
        # beaten only by records that are themselves beaten: decided in a later round
        state = F.when(F.col("_ok"), 0).when(met, 1).otherwise(2)
        marked.withColumn("_state", state).drop("_a", "_b", "_ok").write.parquet(f"{path}/{k}")
        done = spark.read.parquet(f"{path}/{k}")
        rest, k = done.where("_state = 2").drop("_state"), k + 1
        if rest.isEmpty():
            break
    settled = [spark.read.parquet(f"{path}/{i}").where("_state < 2") for i in range(k)]
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out.withColumn("duplicate", F.col("_state") == 1).drop("_state")


def classified(records: DataFrame, by: list[str], path: str) -> DataFrame:
    """Audit of ledger records; the first class that fits wins.

    Needs ``id, ts, seq, schema_version, source, resolved, hours, before``.
    """
    kind = (
        F.when(F.col("duplicate"), "DUPLICATE").when(F.col("schema_version").isNull(), "INVALID_SCHEMA").when(F.col("source") == "SYNTHETIC", "SYNTHETIC")
        .when(~F.col("resolved"), "UNRESOLVED").when(F.col("hours") < 23.5, "INVALID_HORIZON").when(F.col("before"), "PRE").otherwise("VALID")
    )
    return first_of_their_keys(records, by, path).withColumn("kind", kind)


def horizon_validity(resolved: Column, source: Column, hours: Column) -> Column:
    """What a resolved record's horizon is worth."""
    return F.when(~resolved, "UNRESOLVED").when(source == "research_4h", "RESEARCH_4H").when(hours >= 23.5, "VALID_24H").otherwise("INVALID_MIXED_HORIZON")


def milestone(blocks: DataFrame, target: int = 5) -> DataFrame:
    """Gate on independent blocks by quality: enough valid ones, or waiting."""
    n = lambda q: F.sum((F.col("block_quality") == q).cast("long"))
    out = blocks.agg(*[F.coalesce(n(q), F.lit(0)).alias(f"{q.lower()}_blocks") for q in ("VALID", "MIXED", "DEGRADED", "INVALID")])
    passed = F.col("valid_blocks") >= target
    return out.withColumn("decision", F.when(passed, "REVIEW_COMPLETE").otherwise("WAITING_FOR_BLOCKS")).withColumn("locked", passed)


def stop_rule(reviews: DataFrame, by: list[str], order: str, failed: Column, persistence: int = 3) -> DataFrame:
    """Research is triggered where reviews of a group failed ``persistence`` times in a row; adds ``streak`` and ``status``."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = reviews.withColumn("_f", F.coalesce(failed, F.lit(False))).withColumn("_run", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum(F.col("_f").cast("long")).over(Window.partitionBy(*by, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("streak", streak).withColumn("status", F.when(F.col("streak") >= persistence, "RESEARCH_TRIGGERED").otherwise("NO_NEW_RESEARCH_REQUIRED")).drop("_f", "_run")


def degraded_rate(records: DataFrame, quality: Column, threshold: float = 0.01) -> DataFrame:
    """Counts of records by quality (missing counts VALID) and whether too many are degraded."""
    q = records.select(F.coalesce(quality, F.lit("VALID")).alias("q"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = q.agg(F.count("*").alias("total"), n(F.col("q") == "VALID").alias("valid"), n(F.col("q") == "DEGRADED").alias("degraded"), n(~F.col("q").isin("VALID", "DEGRADED")).alias("invalid"))
    rate = F.coalesce(F.try_divide(F.col("degraded"), F.nullif(F.col("total"), F.lit(0))), F.lit(0.0))
    return out.withColumn("degraded_rate_pct", F.round(rate * 100, 2)).withColumn("status", F.when(rate > threshold, "DATA_OPERATIONAL_WARNING").otherwise("HEALTHY"))


def resolve(forecasts: DataFrame, bars: DataFrame, hours: int, by: list[str]) -> DataFrame:
    """Forecast outcomes over (t, t + hours]: high, low, last close, excursions; unresolved rows stay.

    A range join made an equi-join: both sides get the number of an interval as long as the
    horizon, and a forecast meets the two intervals its window touches.
    """
    width = hours * 3600
    slot = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width)
    f = forecasts.withColumn("_slot", F.explode(F.array(slot("made_at"), slot("made_at") + 1)))
    b = bars.select(*by, F.col("ts").alias("_ts"), "high", "low", "close").withColumn("_slot", slot("_ts"))
    inside = (F.col("_ts") > F.col("made_at")) & (F.col("_ts") <= F.col("made_at") + F.expr(f"interval {hours} hours"))
    met = f.join(b, [*by, "_slot"]).where(inside)
    out = met.groupBy("forecast_id").agg(F.max("high").alias("window_high"), F.min("low").alias("window_low"), F.max_by("close", "_ts").alias("window_close"), F.count("*").alias("window_bars"))
    joined = forecasts.join(out, "forecast_id", "left")
    return joined.withColumn("mfe", F.try_divide(F.col("window_high"), F.col("price")) - 1).withColumn("mae", 1 - F.try_divide(F.col("window_low"), F.col("price"))).withColumn("resolved", F.col("window_bars").isNotNull())


def block_quality(rows: DataFrame, every: str = "24 hours") -> DataFrame:
    """Half-open blocks with a label: all VALID, all DEGRADED, any INVALID, else MIXED."""
    block = F.window(F.col("ts").cast("timestamp"), every)["start"].cast("timestamp_ntz").alias("block")
    label = F.when(F.some(F.col("quality") == "INVALID"), "INVALID").when(F.every(F.col("quality") == "VALID"), "VALID").when(F.every(F.col("quality") == "DEGRADED"), "DEGRADED").otherwise("MIXED")
    return rows.groupBy(block).agg(F.count("*").alias("rows"), label.alias("block_quality"))


def orphans(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    return left.join(right, key, "left_anti")
