"""Explicit schemas of the tables this library reads and writes; nothing is inferred."""

from pyspark.sql import types as T

# Name of the day partition column of the stored log and metric tables.
DAY = "day"
# Of tables that a stream writes batch by batch.
BATCH = "batch"

LOGS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("container_id", T.StringType()),
        T.StructField("container_name", T.StringType()),
        T.StructField("compose_project", T.StringType()),
        T.StructField("compose_file", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("container_id", T.StringType()),
        T.StructField("container_name", T.StringType()),
        T.StructField("cpu_percent", T.FloatType()),
        T.StructField("memory_percent", T.FloatType()),
        T.StructField("memory_usage", T.LongType()),
        T.StructField("network_rx", T.LongType()),
        T.StructField("network_tx", T.LongType()),
        T.StructField("block_read", T.LongType()),
        T.StructField("block_write", T.LongType()),
    ]
)

ALERT_EVENTS = T.StructType(
    [
        T.StructField("log_id", T.LongType()),
        T.StructField("alert_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("message", T.StringType()),
        T.StructField("container_id", T.StringType()),
        T.StructField("rules_version", T.LongType()),
    ]
)

# Lines as a log shipper lands them: the container and the text, time prefix included.
RAW_LINES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("container_id", T.StringType()),
        T.StructField("line", T.StringType()),
    ]
)

PORT = T.StructType(
    [
        T.StructField("private_port", T.IntegerType()),
        T.StructField("public_port", T.IntegerType()),
        T.StructField("port_type", T.StringType()),
    ]
)

CONTAINERS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("created", T.LongType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ports", T.ArrayType(PORT)),
    ]
)

# What log lines take from a snapshot.
ATTRIBUTES = T.StructType(
    [
        T.StructField("container_id", T.StringType()),
        T.StructField("_name", T.StringType()),
        T.StructField("_stack", T.StringType()),
    ]
)

# One container as its daemon lists it; every field but the id may be missing.
CONTAINER_LISTING = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("names", T.ArrayType(T.StringType())),
        T.StructField("image", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("created", T.LongType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ports", T.ArrayType(PORT)),
    ]
)

INTERFACE = T.StructType(
    [T.StructField("rx_bytes", T.LongType()), T.StructField("tx_bytes", T.LongType())]
)

# One resource sample: current and previous CPU counters, memory, bytes per interface.
STATS_SAMPLES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("container_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("cpu_total", T.LongType()),
        T.StructField("precpu_total", T.LongType()),
        T.StructField("system_cpu", T.LongType()),
        T.StructField("presystem_cpu", T.LongType()),
        T.StructField("online_cpus", T.LongType()),
        T.StructField("memory_usage", T.LongType()),
        T.StructField("memory_limit", T.LongType()),
        T.StructField("networks", T.MapType(T.StringType(), INTERFACE)),
        T.StructField("block_read", T.LongType()),
        T.StructField("block_write", T.LongType()),
    ]
)
