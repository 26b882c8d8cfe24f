"""Streaming jobs. Each returns its started query.

A job differs from its batch twin only in source, sink and trigger. Its checkpoint restarts
it after a loss of executors or driver, and no sink repeats rows then.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logweir import schemas
from logweir.functions.clock import day_key
from logweir.operators import alerts, logs, patterns
from logweir.operators.ingest import ingest_rows
from logweir.operators.metrics import metric_rows
from logweir.sources.exports import as_json

# Seconds between two rounds of log and metric collection.
LOG_TRIGGER = {"processingTime": "5 seconds"}
METRIC_TRIGGER = {"processingTime": "10 seconds"}

# Folders that batches of pattern counts take turns in.
PATTERN_TURNS = 10

# How long after its first copy a repeated line may arrive and still be recognised.
DEDUP_DELAY = "10 minutes"


def _by_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn(schemas.DAY, F.expr(day_key("timestamp")))


def _append_batches(
    stream: DataFrame, rows: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, trigger: dict
) -> StreamingQuery:
    """Write ``rows(batch)`` of every batch to a folder of its own, by day.

    A batch that is repeated after a loss replaces its folder. The readers of
    :mod:`logweir.sources.tables` see the folders of complete batches as one table, whose closed
    days :func:`logweir.sources.sealed.seal` merges.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = f"{path}/{schemas.BATCH}={batch_id}"
        _by_day(rows(batch)).write.mode("overwrite").partitionBy(schemas.DAY).parquet(folder)

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(write)
        .start()
    )


def ingest_logs(
    lines: DataFrame,
    containers: Callable[[SparkSession], DataFrame | logs.Attributes],
    path: str,
    checkpoint: str,
    trigger=LOG_TRIGGER,
) -> StreamingQuery:
    """Parse, classify and enrich landed lines and append them to the log table.

    ``containers`` reads the container snapshot. It is called, and its result measured, for
    every batch, so containers that were listed after the start are known. A snapshot that
    :func:`logweir.sources.tables.publish_containers` writes may be replaced at any time, and
    :func:`logweir.sources.tables.read_attributes` reads what was measured with it.
    """
    return _append_batches(
        lines,
        lambda batch: ingest_rows(batch, containers(batch.sparkSession)),
        path,
        checkpoint,
        trigger,
    )


def ingest_metrics(
    samples: DataFrame, path: str, checkpoint: str, trigger=METRIC_TRIGGER
) -> StreamingQuery:
    return _append_batches(samples, metric_rows, path, checkpoint, trigger)


def raise_alerts(
    log_stream: DataFrame, rules, path: str, checkpoint: str, trigger=LOG_TRIGGER
) -> StreamingQuery:
    """Append the event of every line that fires a rule; counters and the recent list are
    batch reads of the event table.

    ``rules`` is a list, or a function of the session that returns a version and its list, such as
    :func:`logweir.sources.rules.read_rules` on a folder. The function is called for every batch, so
    rules can be added and removed while the job runs; events carry the version.
    """

    def events(batch: DataFrame) -> DataFrame:
        version, active = rules(batch.sparkSession) if callable(rules) else (None, rules)
        found = alerts.alert_events(batch, active)
        return found.withColumn("rules_version", F.lit(version).cast("long"))

    return _append_batches(log_stream, events, path, checkpoint, trigger)


def count_patterns(
    log_stream: DataFrame, path: str, checkpoint: str, trigger=LOG_TRIGGER
) -> StreamingQuery:
    """Keep running pattern counts: one row of state, written whole after every batch.

    Batches take turns in a few folders. A batch that is repeated replaces what it wrote,
    and the one before it stays readable meanwhile.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch", F.lit(batch_id)).coalesce(1)
        rows.write.mode("overwrite").parquet(f"{path}/turn={batch_id % PATTERN_TURNS}")

    return (
        patterns.pattern_counts(log_stream)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(write)
        .start()
    )


def read_pattern_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts of the latest batch."""
    written = spark.read.parquet(path)
    latest = written.agg(F.max("batch").alias("batch"))
    return written.join(F.broadcast(latest), "batch", "left_semi").drop("batch", "turn")


def drop_repeated_lines(
    log_stream: DataFrame, path: str, checkpoint: str, trigger=LOG_TRIGGER, delay=DEDUP_DELAY
) -> StreamingQuery:
    """Append each (time, container, message) once.

    A copy is recognised within ``delay`` of the first one's arrival, then its state goes.
    The watermark is on arrival and not on the line's own time, so no line is ever too late
    and none is lost.
    """
    unique = (
        log_stream.withColumn("_arrived", F.current_timestamp())
        .withWatermark("_arrived", delay)
        .dropDuplicatesWithinWatermark(logs.DUPLICATE_KEY)
        .drop("_arrived")
    )
    return _append_batches(unique, lambda batch: batch, path, checkpoint, trigger)


def push_live(
    log_stream: DataFrame,
    path: str,
    checkpoint: str,
    containers: list[str] | None = None,
    stack: str | None = None,
    trigger=LOG_TRIGGER,
) -> StreamingQuery:
    """Write every row a live view selects as one JSON text."""
    return (
        as_json(logs.live_filter(log_stream, containers, stack))
        .writeStream.format("text")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start(path)
    )
