"""Scans: missing-file tolerance, CSV with column back-fill, coalesced names, a paged source."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

OHLCV = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, available_time timestamp"
FUNDING = "symbol string, ts timestamp, funding_rate double, available_time timestamp"
OPEN_INTEREST = "symbol string, ts timestamp, open_interest double, available_time timestamp"
ONCHAIN = "symbol string, ts timestamp, mvrv_zscore double, nupl double, available_time timestamp"


def parquet_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet scan; an absent path is an empty table of the schema, other errors are raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def csv_back_filled(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV by its header; columns that older files lack are NULL, unknown ones are left out."""
    found = spark.read.option("header", True).csv(path)
    wanted = StructType.fromDDL(schema)
    return found.select(*[(F.col(f.name).cast(f.dataType) if f.name in found.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])


def coalesced(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Rename by alternatives: each target takes the first of its source names that is there and not NULL."""
    out = []
    for target, options in names.items():
        there = [F.col(o) for o in options if o in df.columns]
        if not there:
            raise ValueError(f"none of {options} is a column")
        out.append(F.coalesce(*there).alias(target))
    return df.select(*out)


def last_days(df: DataFrame, ts: str, days: int, until) -> DataFrame:
    """Rows of the last ``days`` before ``until``, as far as a source keeps history; nothing if there is no end."""
    return df.where(F.lit(False)) if until is None else df.where(F.col(ts) >= F.lit(until) - F.expr(f"interval {days} days"))


def jdbc_table(spark: SparkSession, url: str, table: str, column: str, parts: int = 8, properties: dict[str, str] | None = None) -> DataFrame:
    """A database table read in ``parts`` ranges of a numeric column; its bounds come from the database itself."""
    read = lambda what, **more: spark.read.format("jdbc").options(url=url, dbtable=what, **(properties or {}), **more).load()
    low, high = read(f"(SELECT min({column}) AS lo, max({column}) AS hi FROM {table}) b").first()
    if low is None:
        return read(table)
    return read(table, partitionColumn=column, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=parts)


DEPTH = "bids array<array<string>>, asks array<array<string>>"


def depth_snapshots(rows: DataFrame, text: str, series: str, order: str) -> DataFrame:
    """Depths, spread and imbalance of order-book answers (JSON); an answer without both sides keeps the last ones and is degraded."""
    from pyspark.sql import Window

    book = F.from_json(F.col(text), DEPTH)
    side = lambda c, i: F.transform(book[c], lambda x: x[i].cast("double"))
    total = lambda c: F.aggregate(side(c, 1), F.lit(0.0), lambda a, x: a + x)
    fine = (F.size(book["bids"]) > 0) & (F.size(book["asks"]) > 0)
    bid, ask = total("bids"), total("asks")
    found = F.when(fine, F.struct(bid.alias("bid_depth"), ask.alias("ask_depth"), (F.get(side("asks", 0), 0) - F.get(side("bids", 0), 0)).alias("spread"), ((bid - ask) / (bid + ask + 1e-8)).alias("imbalance")))
    held = F.last("_book", ignorenulls=True).over(Window.partitionBy(series).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_book", found).withColumn("degraded", F.col("_book").isNull()).withColumn("_book", held).select(*rows.columns, "_book.*", "degraded")


def valuation(rows: DataFrame, price: str, mvrv: str, nupl: str) -> DataFrame:
    """On-chain valuation of each row: what a source gave, or a proxy from the price, degraded and without influence."""
    ratio = F.col(price) / 42_000
    clip = lambda x, lo, hi: F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    live = F.col(mvrv).isNotNull() & F.col(nupl).isNotNull()
    proxy = F.coalesce(clip((ratio - 1) * 1.5 + 1.2, 0.6, 5.5), F.lit(1.85)), F.coalesce(clip((ratio - 1) * 0.35 + 0.30, -0.2, 0.85), F.lit(0.42))
    out = rows.withColumn("_m", F.when(live, F.col(mvrv)).otherwise(F.when(F.col(price).isNull(), 1.85).otherwise(proxy[0]))).withColumn("_u", F.when(live, F.col(nupl)).otherwise(F.when(F.col(price).isNull(), 0.42).otherwise(proxy[1])))
    return out.withColumn("source", F.when(live, "live").otherwise("calibrated_proxy")).withColumn("influence_weight", F.when(live, 1.0).otherwise(0.0)).withColumn(mvrv, F.col("_m")).withColumn(nupl, F.col("_u")).drop("_m", "_u")


def kline_snapshots(answers: DataFrame, text: str, by: str, order: str) -> DataFrame:
    """The last closed candle of each answer (a list of lists; of two or more the last is still open), or the newest valid one before, marked degraded.

    Adds ``open_ms, open, high, low, close, volume, degraded``; without any valid answer before, they are NULL.
    """
    from pyspark.sql import Window

    rows = F.from_json(text, "array<array<string>>")
    closed = F.when(F.size(rows) >= 2, F.get(rows, F.size(rows) - 2)).when(F.size(rows) == 1, F.get(rows, F.lit(0)))
    cells = [F.get(closed, F.lit(k)) for k in range(6)]
    candle = F.struct(cells[0].cast("long").alias("open_ms"), *[c.cast("double").alias(n) for c, n in zip(cells[1:], ("open", "high", "low", "close", "volume"), strict=True)])
    fine = F.when(closed.isNotNull() & (F.size(closed) >= 6), candle)
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = answers.withColumn("_c", fine).withColumn("_k", F.last("_c", ignorenulls=True).over(w))
    return out.select("*", "_k.*", F.col("_c").isNull().alias("degraded")).drop("_c", "_k")


def macro_snapshots(answers: DataFrame, funding: str, interest: str, fear: str) -> DataFrame:
    """Funding rate, open interest and fear-and-greed from three kinds of answer; 0.0001, 0 and 50 where one can't be read."""
    number = lambda text, path: F.get_json_object(text, path).try_cast("double")
    return answers.withColumns({"funding_rate": F.coalesce(number(F.col(funding), "$.lastFundingRate"), F.lit(0.0001)), "open_interest": F.coalesce(number(F.col(interest), "$.openInterest"), F.lit(0.0)), "fear_greed": F.coalesce(number(F.col(fear), "$.data[0].value"), F.lit(50.0))})


class PagedSource(DataSource):
    """``spark.read.format("paged")``: pages of an exchange-like API, a partition a time slice.

    Options: ``start``, ``stop`` (epoch seconds), ``step`` (seconds a bar), ``page`` (rows a page).
    ``fetch`` is the hook a client overrides; this one makes a deterministic walk, for tests and demos.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return OHLCV

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.start, self.stop = int(options.get("start", 0)), int(options.get("stop", 0))
        self.step, self.page = int(options.get("step", 3600)), int(options.get("page", 1000))

    def partitions(self) -> list[InputPartition]:
        width = self.step * self.page
        return [InputPartition((at, min(at + width, self.stop))) for at in range(self.start, self.stop, width)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        # a page also holds the first bar of the next, as an exchange answers closed ranges
        start, stop = partition.value
        yield from fetch(start, min(stop + self.step, self.stop), self.step)


def fetch(start: int, stop: int, step: int) -> Iterator[tuple]:
    """Bars that depend on their time alone, so pages can be fetched again in any order."""
    import datetime as dt
    import math

    for at in range(start, stop, step):
        price = lambda x: 65000 * math.exp(0.02 * math.sin(x / 86400) + 0.005 * math.sin(x / 3700.0))
        o, c = price(at), price(at + step)
        ts = dt.datetime.fromtimestamp(at, dt.UTC)
        yield ("BTC/USD", ts, o, max(o, c) * 1.001, min(o, c) * 0.999, c, 10.0 + at % 7, ts + dt.timedelta(seconds=step))


def running_sum(df: DataFrame, column: str, size: int = 8192) -> DataFrame:
    """``df`` (with a gapless ``id``) and the running sum ``_sum`` of a column, in blocks; one sum a block is carried on."""
    from pyspark.sql import Window

    dealt = df.withColumn("_b", F.floor(F.col("id") / size))
    before = dealt.groupBy("_b").agg(F.sum(column).alias("_s")).withColumn("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_s")  # a row a block
    own = F.sum(column).over(Window.partitionBy("_b").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_o", own).join(before, "_b").withColumn("_sum", F.col("_p") + F.col("_o")).drop("_b", "_o", "_p")


def _draw(kind, seed: int, mean: float = 0.0, dev: float = 1.0):
    """Draws that depend on ``id`` and seed alone, so a task that runs again repeats them."""
    u = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(2**52)) + 0.5) / 2.0**52
    return u(0) if kind == "uniform" else mean + dev * F.sqrt(-2 * F.ln(u(0))) * F.cos(2 * F.lit(3.141592653589793) * u(1000))


def synthetic_candles(spark: SparkSession, rows: int, seed: int = 42, start: float = 65000.0) -> DataFrame:
    """Geometric walk with 2 % jumps; equal in distribution to any such generator, not in its numbers."""
    step = spark.range(rows).withColumn("r", _draw("normal", seed, 0.0, 0.004) + F.when(_draw("uniform", seed + 1) < 0.02, _draw("normal", seed + 2, 0.0, 0.02)).otherwise(0.0))
    c = running_sum(step, "r").withColumn("close", F.exp("_sum") * start).withColumn("open", F.exp(F.col("_sum") - F.col("r")) * start)
    wick = F.abs(_draw("normal", seed + 3, 0.0, 0.002))
    return c.select(F.lit("SIM").alias("symbol"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), "open", (F.greatest("open", "close") * (1 + wick)).alias("high"), (F.least("open", "close") * (1 - wick)).alias("low"), "close", (_draw("uniform", seed + 4) * 100).alias("volume"))


def synthetic_ticks(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """Order-book events with exponential gaps (mean 200 ms, at least 10 ms)."""
    kinds = F.array(*map(F.lit, ("trade", "bid_update", "ask_update", "depth_update", "imbalance_change")))
    e = spark.range(rows).withColumn("gap", F.floor(10 - 200 * F.log(1 - _draw("uniform", seed))).cast("double")).withColumn("kind", F.element_at(kinds, (F.floor(_draw("uniform", seed + 1) * 5) + 1).cast("int")))
    return running_sum(e, "gap").withColumn("timestamp_ms", F.col("_sum").cast("long")).select("id", F.timestamp_millis("timestamp_ms").alias("ts"), "timestamp_ms", F.col("kind").alias("event_type"), _draw("normal", seed + 2, 65000.0, 5.0).alias("price"))


def synthetic_horizons(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """Five-minute bars whose volatility is 2.5 times as high for a while and half as high for another."""
    calm = F.when(F.col("id").between(500, 799), 2.5).when(F.col("id").between(1200, 1499), 0.5).otherwise(1.0)
    r = spark.range(rows).withColumn("r", _draw("normal", seed, 0.00005, 0.003) * calm)
    c = running_sum(r, "r").withColumn("close", 65000 * F.exp("_sum"))
    return c.select(F.lit("SIM").alias("symbol"), F.timestamp_seconds(F.col("id") * 300).alias("ts"), (F.col("close") * (1 - F.col("r"))).alias("open"), (F.col("close") * (1 + F.abs(_draw("normal", seed + 1, 0.001, 0.001)))).alias("high"), (F.col("close") * (1 - F.abs(_draw("normal", seed + 2, 0.001, 0.001)))).alias("low"), "close", (50 + 450 * _draw("uniform", seed + 3)).alias("volume"))


def synthetic_onchain(spark: SparkSession, days: int = 180, seed: int = 42) -> DataFrame:
    """Daily on-chain valuations: two clipped walks."""
    w = running_sum(spark.range(days).withColumn("a", _draw("normal", seed, 0.0, 0.08)), "a").withColumnRenamed("_sum", "m")
    w = running_sum(w.withColumn("b", _draw("normal", seed + 1, 0.0, 0.015)), "b")
    clip = lambda x, lo, hi: F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    return w.select(F.timestamp_seconds(F.col("id") * 86400).alias("ts"), clip(2.1 + F.col("m"), 0.5, 5.0).alias("mvrv_zscore"), clip(0.45 + F.col("_sum"), -0.2, 0.8).alias("nupl"))
