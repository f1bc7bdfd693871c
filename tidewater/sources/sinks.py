"""Sinks: partitioned Parquet, ranged export, merge by rewrite, manifests, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import latest

#: Tables that ``export`` may read.
EXPORTABLE = ("bars", "features", "orderflow", "macro", "sentiment")


def write_series(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by symbol and day, so that later reads prune both."""
    df.withColumn("day", F.to_date("ts")).repartition("symbol", "day").write.mode(mode).partitionBy("symbol", "day").parquet(path)


def export(spark: SparkSession, root: str, table: str, start: str, stop: str, path: str, kind: str = "parquet") -> None:
    """Closed time range of a whitelisted table, in order, as Parquet or CSV."""
    if table not in EXPORTABLE:
        raise ValueError(f"{table} is not exported")
    rows = spark.read.parquet(f"{root}/{table}").where(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(stop).cast("timestamp"))).orderBy("ts")
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def append_version(rows: DataFrame, path: str) -> None:
    """Append-only half of INSERT OR REPLACE; ``read_latest`` is the other."""
    rows.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def read_latest(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    return latest(spark.read.parquet(path), key, [F.desc("written_at")]).drop("written_at")


def guarded(rows: DataFrame, boundary: str, version: str) -> DataFrame:
    """Rows of the right version at or after the boundary; others are refused."""
    return rows.where((F.col("ts") >= F.lit(boundary).cast("timestamp")) & (F.col("version") == version))


def manifest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One hash of a table, whatever its order: the hash of the sums of the pieces of its rows' hashes, and its count.

    Sums combine before the shuffle, so no task holds more than a few numbers.
    """
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    pieces = [F.conv(F.substring("h", 1 + 13 * k, 13), 16, 10).cast("decimal(38,0)") for k in range(5)]
    sums = df.select(row.alias("h")).agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(x), F.lit(0).cast("decimal(38,0)")).cast("string").alias(f"s{k}") for k, x in enumerate(pieces)])
    return sums.select(F.sha2(F.concat_ws("|", *[f"s{k}" for k in range(5)], F.col("rows").cast("string")), 256).alias("digest"), "rows")


def markdown(df: DataFrame, most: int = 100) -> str:
    """A report table of the first rows (a report, so bounded)."""
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in rows])


def each_batch(path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: one file set a batch number, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        newest = latest(batch.withColumn("_n", F.monotonically_increasing_id()), key, [F.desc("_n")]).drop("_n")
        newest.withColumn("written_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def column_or(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default
