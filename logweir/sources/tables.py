"""Stored log and metric tables: Parquet by day, clustered by container and time."""

import datetime as dt
import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir import schemas
from logweir.functions.clock import day_key
from logweir.operators.attributes import Attributes, container_attributes
from logweir.session import BROADCAST_BYTES, measured, task_count
from logweir.sources import sealed, versions

# Fixed value: days that rows are kept.
RETENTION_DAYS = 7


def _stored(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(schemas.DAY, T.DateType())])


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a log table, whether written whole or by the batches of a stream."""
    return _read_days(spark, path, schemas.LOGS)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return _read_days(spark, path, schemas.METRICS)


def read_alert_events(spark: SparkSession, path: str) -> DataFrame:
    return _read_days(spark, path, schemas.ALERT_EVENTS)


def _read_days(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if sealed.has_batches(spark, path):
        return sealed.read(spark, path, schema)
    return spark.read.schema(_stored(schema)).parquet(path)


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """The container snapshot: its newest whole version, or the files of a plain folder."""
    _, text = versions.latest(spark, f"{path}/_versions")
    folder = f"{path}/{json.loads(text)['folder']}/containers" if text else path
    return spark.read.schema(schemas.CONTAINERS).parquet(folder)


def read_attributes(spark: SparkSession, path: str) -> Attributes:
    """The attributes of the newest whole version, measured when it was published."""
    _, text = versions.latest(spark, f"{path}/_versions")
    if text is None:
        raise FileNotFoundError(f"no published snapshot in {path}")
    version = json.loads(text)
    rows = spark.read.schema(schemas.ATTRIBUTES).parquet(f"{path}/{version['folder']}/attributes")
    return Attributes(rows, version["bytes"] <= BROADCAST_BYTES)


# Versions of a snapshot that stay readable for those that pinned them.
SNAPSHOTS_KEPT = 10


def publish_containers(containers: DataFrame, path: str, kept: int = SNAPSHOTS_KEPT) -> int:
    """Write a snapshot beside the older ones and point readers to it once it is whole.

    With it go the attributes that lines take, reduced and measured once. A reader pins the version
    that was newest when it began. All but the ``kept`` newest are deleted. Returns the number.
    """
    spark = containers.sparkSession
    folder = f"snapshot-{uuid.uuid4().hex}"
    written = f"{path}/{folder}/attributes"
    containers.write.parquet(f"{path}/{folder}/containers")
    whole = spark.read.schema(containers.schema).parquet(f"{path}/{folder}/containers")
    container_attributes(whole).write.parquet(written)
    size = measured(spark.read.schema(schemas.ATTRIBUTES).parquet(written))
    text = json.dumps({"folder": folder, "bytes": size})
    pointers = f"{path}/_versions"
    number = versions.latest(spark, pointers)[0] + 1
    while not versions.publish(spark, pointers, number, text):
        number = versions.latest(spark, pointers)[0] + 1
    for old in versions.numbers(spark, pointers)[:-kept]:
        versions.delete(spark, f"{path}/{json.loads(versions.read(spark, pointers, old))['folder']}")
        versions.forget(spark, pointers, old)
    return number


def read_container_listing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CONTAINER_LISTING).parquet(path)


def read_stats_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.STATS_SAMPLES).parquet(path)


def stream_rows(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Rows of Parquet files as they land in ``path``; the limit bounds one batch's input."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


# Names of compose files.
COMPOSE_NAMES = "docker-compose.{yml,yaml}"


def read_compose_files(spark: SparkSession, roots: list[str], names: str = COMPOSE_NAMES) -> DataFrame:
    """Every compose file below ``roots`` as (path, content), found and read by executors."""
    files = spark.read.text(
        roots,
        wholetext=True,
        recursiveFileLookup=True,
        pathGlobFilter=names,
    )
    # File paths come percent-encoded, except for the plus sign.
    encoded = "replace(regexp_replace(_metadata.file_path, '^file:/+', '/'), '+', '%2B')"
    return files.selectExpr(f"url_decode({encoded}) AS path", "value AS content")


def _clustered(df: DataFrame) -> DataFrame:
    """Day, container and time in range order.

    Ranges are cut from a sample of the data, and time is part of the key, so a container
    that writes a third of all lines is spread over many tasks and files. Files then hold
    few containers each, and their min/max statistics skip the others. Large inputs get as
    many ranges as their bytes need, whatever the session's number of shuffle partitions.
    """
    keys = [schemas.DAY, "container_id", "timestamp"]
    dated, count = df.withColumn(schemas.DAY, F.expr(day_key("timestamp"))), task_count(df)
    ranged = dated.repartitionByRange(count, *keys) if count else dated.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def _append(df: DataFrame, path: str) -> None:
    _clustered(df).write.mode("append").partitionBy(schemas.DAY).parquet(path)


def write_logs(logs: DataFrame, path: str) -> None:
    _append(logs.select(*schemas.LOGS.fieldNames()), path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    _append(metrics.select(*schemas.METRICS.fieldNames()), path)


def _bound(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _day(at: Column) -> Column:
    """The day key of a bound, as :func:`day_key` has it."""
    seconds = F.unix_seconds(at.cast("timestamp"))
    return F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))


def _create(spark: SparkSession, table: str, schema: T.StructType) -> None:
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _stored(schema).fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet PARTITIONED BY ({schemas.DAY})"
    )


def create_tables(spark: SparkSession, logs: str = "logs", metrics: str = "metrics") -> None:
    """Create the two catalog tables unless they exist."""
    _create(spark, logs, schemas.LOGS)
    _create(spark, metrics, schemas.METRICS)


def insert_logs(logs: DataFrame, table: str = "logs") -> None:
    _clustered(logs.select(*schemas.LOGS.fieldNames())).write.insertInto(table)


def insert_metrics(metrics: DataFrame, table: str = "metrics") -> None:
    _clustered(metrics.select(*schemas.METRICS.fieldNames())).write.insertInto(table)


def in_range(df: DataFrame, since=None, until=None) -> DataFrame:
    """Rows with ``since <= timestamp < until``; datetimes without zone are local time.

    Bounds on ``timestamp`` alone prune no partition, so a stored table is bounded by its
    day column, a UTC day, as well.
    """
    stored = schemas.DAY in df.columns
    if since is not None:
        df = df.filter(F.col("timestamp") >= _bound(since))
        if stored:
            df = df.filter(F.col(schemas.DAY) >= _day(_bound(since)))
    if until is not None:
        df = df.filter(F.col("timestamp") < _bound(until))
        if stored:
            df = df.filter(F.col(schemas.DAY) <= _day(_bound(until)))
    return df


def _days_of(df: DataFrame) -> list[str]:
    """The days of a stored table, newest first, from the paths of its files; nothing is read."""
    found = {m.group(1) for f in df.inputFiles() if (m := re.search(rf"/{schemas.DAY}=([^/]+)/", f))}
    return sorted(found, key=lambda d: (d[:1].isdigit(), d), reverse=True)


def _of_days(df: DataFrame, days: list[str]) -> DataFrame:
    """Rows of days that follow one another in :func:`_days_of`; the day of rows without time is null."""
    dated = [dt.date.fromisoformat(d) for d in days if d[:1].isdigit()]
    wanted = F.col(schemas.DAY).between(min(dated), max(dated)) if dated else F.lit(False)
    if len(dated) < len(days):
        wanted = wanted | F.col(schemas.DAY).isNull()
    return df.filter(wanted)


def newest_days(df: DataFrame, skip: int, take: int) -> tuple[DataFrame, int]:
    """The days of a stored table that hold its newest rows ``skip`` to ``skip + take``.

    Returns those days' rows and how many of them still have to be skipped. From the newest day
    back, rows are counted in 1, 2, 4, ... days until the page is full, so older days are not
    read; the driver gets one number per day that is.
    """
    days = _days_of(df)
    before, wanted, left, at, step = 0, [], skip, 0, 1
    while at < len(days) and before < skip + take:
        some = days[at : at + step]
        counted = _of_days(df, some).groupBy(schemas.DAY).count().collect()
        rows = {str(r[schemas.DAY]) if r[schemas.DAY] else None: r["count"] for r in counted}
        for day in some:
            n = rows.get(day if day[:1].isdigit() else None, 0)
            if before + n <= skip:
                left -= n
            elif before < skip + take:
                wanted.append(day)
            before += n
        at, step = at + step, step * 2
    if not wanted:
        return df.limit(0), 0
    return _of_days(df, wanted), left


def retained(df: DataFrame, as_of, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows that are not yet older than ``days`` at ``as_of`` (a datetime)."""
    return in_range(df, since=as_of - dt.timedelta(days=days))


def _oldest_kept(as_of: dt.datetime, days: int) -> dt.date:
    return (as_of.astimezone(dt.timezone.utc) - dt.timedelta(days=days)).date()


def drop_expired_days(
    spark: SparkSession, table: str, as_of: dt.datetime, days: int = RETENTION_DAYS
) -> list[dt.date]:
    """Drop the days of a catalog table that lie wholly before the retention bound.

    Only the catalog's list of days is read; no row is.
    """
    oldest_kept = _oldest_kept(as_of, days)
    listed = (row[0].split("=", 1)[1] for row in spark.sql(f"SHOW PARTITIONS {table}").collect())
    expired = sorted(d for d in map(dt.date.fromisoformat, listed) if d < oldest_kept)
    if expired:
        specs = ", ".join(f"PARTITION ({schemas.DAY} = DATE'{day}')" for day in expired)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {specs}")
    return expired


def drop_expired_folders(
    spark: SparkSession, path: str, as_of: dt.datetime, days: int = RETENTION_DAYS
) -> list[dt.date]:
    """Delete such days, sealed or not, from a log, metric or alert table that a stream writes.

    Only folders are listed. Batches that are being written hold newer days, or lines that
    would be deleted by the next call.
    """
    return sealed.drop_days(spark, path, _oldest_kept(as_of, days))


def rows_per_day(df: DataFrame) -> DataFrame:
    return df.groupBy(F.expr(day_key("timestamp")).alias(schemas.DAY)).agg(
        F.count("*").alias("count")
    )
