"""Session settings, the shared scratch folder and size-checked broadcasts."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Settings every job here assumes. Executor memory, cores and the number of shuffle
# partitions belong to the cluster and are left to it.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Streaming state on local disk instead of the executor heap, checkpointed as changes.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # A long-lived session answers many kinds of query; it should not compile them anew.
    "spark.sql.codegen.cache.maxEntries": "2000",
    # Spares the driver a stack capture, and calls into the JVM, for every column expression.
    "spark.sql.dataFrameQueryContext.enabled": "false",
}

# A side above this many bytes of raw values is joined by shuffle instead.
BROADCAST_BYTES = 64 * 1024 * 1024


def session_builder(app_name: str = "logweir"):
    builder = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that all executors share.

    The cluster names the folder in ``spark.checkpoint.dir``. Only a local session may go
    without it, as its driver and executors see the same disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="logweir-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _width(field: T.StructField) -> str:
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return f"16L + coalesce(octet_length(`{field.name}`), 0)"
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return f"16L + coalesce(octet_length(to_json(`{field.name}`)), 0)"
    return "16L"


def measured(df: DataFrame) -> int:
    """Bytes of the raw values of ``df``, by a job over it."""
    width = " + ".join(_width(field) for field in df.schema.fields)
    return df.agg(F.expr(f"coalesce(sum({width}), 0L)")).first()[0]


def broadcast_if_small(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast once a job over it has measured that it fits.

    A larger ``df`` comes back as it is; Spark then joins by shuffle, and adaptive
    execution splits the partitions of hot keys.
    """
    return F.broadcast(df) if measured(df) <= limit_bytes else df


# Bytes of input that one task of a shuffle should get.
TASK_BYTES = 128 << 20


def task_count(df: DataFrame) -> int | None:
    """Tasks that the bytes of ``df``'s files need, if more than the session's setting; else None."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:  # what Spark reports of data it knows nothing about
        return None
    wanted = -(-size // TASK_BYTES)
    return wanted if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
