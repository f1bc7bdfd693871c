"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Only a local master (tests on one machine) may do without the setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
    return root.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder path under the shared folder."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def map_columns(df: DataFrame, columns: list[str], schema: str, function: Callable[..., dict[str, list]]) -> DataFrame:
    """Run ``function(*column lists) -> {output column: list}`` over Arrow batches.

    Only the named columns leave the JVM. The function gets plain Python lists and is
    called once a batch, so its caches can be warmed by the whole batch at once.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(*[c.to_pylist() for c in batch.columns])
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def portions(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[list[list]]:
    """The columns of Arrow batches as Python lists, so few rows at once: a batch of 10,000 long texts is never there twice."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield [c.slice(lo, rows).to_pylist() for c in batch.columns]
        del batch  # before the next one is read


def boxed(df: DataFrame, *columns: str) -> DataFrame:
    """The whole row as struct ``_row`` beside the named columns, so that added names can't clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[F.col(f"`{c}`") for c in columns])


def unboxed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("_row").getField(c).alias(c) for c in columns])
