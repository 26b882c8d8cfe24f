"""Partition counts by bytes, scratch tables and bounded samples."""

import math
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.session import scratch_path
from logweir.sources.versions import delete

TASK_BYTES = 32 << 20


def partitions(df: DataFrame, factor: float = 1.0) -> int:
    """Tasks for a shuffle of ``df``, from the bytes Spark knows of its files."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if size >= 1 << 60:  # what Spark reports of data it knows nothing about
        return least
    wanted = math.ceil(size * factor / TASK_BYTES)
    return max(least, min(wanted, 200_000))


_temporary: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession):
    """Tables that are written inside go when it ends; nothing may read them from then on."""
    paths: list[str] = []
    _temporary.append(paths)
    try:
        yield
    finally:
        _temporary.remove(paths)
        for path in paths:
            delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder, so that nothing is computed twice."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    if _temporary:
        _temporary[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def draw(*columns: str):
    """A number from 0 to 1 by a hash of the columns, fine enough for shares of any table."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def crc_of_id(column: str = "doc_id"):
    """crc32 of an id written as text, which deals documents into folds."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
