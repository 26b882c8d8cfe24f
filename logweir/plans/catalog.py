"""Registered queries: name, DataFrame, and checking SQL."""

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir import schemas
from logweir.functions import levels, patterns
from logweir.functions import text as texts
from logweir.functions.container import stack_of
from logweir.operators import alerts, containers, ingest, logs, metrics, stacks
from logweir.operators import patterns as pattern_ops
from logweir.plans import sql
from logweir.session import scratch_path
from logweir.sources import event_views as views
from logweir.sources import exports, sealed, tables
from logweir.sources import rules as stored_rules
from logweir.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: Query
    oracle: str | None


CATALOG: dict[str, Registered] = {}


def _plain_times(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the checking engine has them."""
    fields = df.schema.fields
    if not any(isinstance(f.dataType, T.TimestampType) for f in fields):
        return df
    return df.selectExpr(
        *[
            f"CAST(`{f.name}` AS timestamp_ntz) AS `{f.name}`"
            if isinstance(f.dataType, T.TimestampType)
            else f"`{f.name}`"
            for f in fields
        ]
    )


def query(name: str, oracle: str | None = None):
    """Register a query that maps (spark, sf_dir) to its result."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return _plain_times(build(spark, sf_dir))

        CATALOG[name] = Registered(run, oracle)
        return build

    return register


def log_query(name: str, oracle: str, base: str = sql.LOGS):
    """Register a query that maps the log view to its result."""

    def register(build: Callable[[DataFrame], DataFrame]):
        query(name, f"WITH {base} {oracle}")(
            lambda spark, sf_dir: build(views.logs(views.read_events(spark, sf_dir)))
        )
        return build

    return register


def event_query(name: str, oracle: str):
    """Register a query that maps the event table to its result."""

    def register(build: Callable[[DataFrame], DataFrame]):
        query(name, oracle)(lambda spark, sf_dir: build(views.read_events(spark, sf_dir)))
        return build

    return register


def _log_columns(df: DataFrame) -> DataFrame:
    return df.select(*schemas.LOGS.fieldNames())


def _utc(*parts: int) -> dt.datetime:
    return dt.datetime(*parts, tzinfo=dt.timezone.utc)


_ALL = f"SELECT {sql.LOG_COLUMNS} FROM logs"


# Scans, encoding and normalisation ------------------------------------------------------


@log_query("log_scan", _ALL)
def _(df):
    return _log_columns(df)


@event_query(
    "log_encode",
    f"""WITH {sql.LOGS}
    SELECT CASE WHEN id % 10 = 0 THEN 0 ELSE id END AS id, timestamp, container_id, container_name,
           compose_project, compose_file, message, level, source,
           CASE WHEN id % 6 = 0 THEN '' ELSE metadata END AS metadata
    FROM logs""",
)
def _(events):
    # Entries as producers hand them over: microsecond times, some without id or metadata.
    entries = views.logs(events, exact_time=True)
    return logs.encode_logs(
        entries.withColumns(
            {
                "id": F.when(F.col("id") % 10 != 0, F.col("id")),
                "metadata": F.when(F.col("id") % 6 != 0, F.col("metadata")),
            }
        )
    )


@log_query(
    "log_decode",
    """SELECT id, timestamp, container_id, container_name, compose_project, compose_file, message,
           CASE WHEN upper(level_raw) = 'DEBUG' THEN 'DEBUG'
                WHEN upper(level_raw) = 'INFO' THEN 'INFO'
                WHEN upper(level_raw) IN ('WARN', 'WARNING') THEN 'WARN'
                WHEN upper(level_raw) IN ('ERROR', 'ERR') THEN 'ERROR'
                WHEN upper(level_raw) IN ('FATAL', 'CRITICAL') THEN 'FATAL'
                ELSE 'UNKNOWN' END AS level,
           source, nullif(metadata, '') AS metadata
    FROM logs""",
)
def _(df):
    return logs.decode_logs(
        df.withColumn("level", F.col("level_raw")).withColumn("source", F.lower("source"))
    )


@log_query(
    "level_normalize",
    """SELECT id, level_raw,
           coalesce(map {'DEBUG': 'DEBUG', 'INFO': 'INFO', 'WARN': 'WARN', 'WARNING': 'WARN',
                         'ERROR': 'ERROR', 'ERR': 'ERROR', 'FATAL': 'FATAL',
                         'CRITICAL': 'FATAL'}[upper(level_raw)], 'UNKNOWN') AS level
    FROM logs""",
)
def _(df):
    return df.selectExpr("id", "level_raw", f"{levels.normalize_level('level_raw')} AS level")


@log_query(
    "source_normalize",
    "SELECT id, CASE WHEN level_raw = 'err' THEN 'STDERR' ELSE 'STDOUT' END AS source FROM logs",
)
def _(df):
    spelled = "concat('Std', level_raw)"
    return df.selectExpr("id", f"{levels.normalize_source(spelled)} AS source")


@log_query("ingest_level", "SELECT id, level FROM logs")
def _(df):
    return df.selectExpr("id", f"{levels.ingest_level('message')} AS level")


@log_query("ingest_source", "SELECT id, source FROM logs")
def _(df):
    return df.selectExpr("id", f"{levels.ingest_source('message')} AS source")


@log_query(
    "extract_level",
    """SELECT id,
           CASE WHEN is_error THEN 'ERROR' WHEN is_warning THEN 'WARN' WHEN is_debug THEN 'DEBUG'
                WHEN is_start THEN 'ERROR' ELSE 'INFO' END AS level,
           trim(message) AS clean_message
    FROM marks""",
    sql.MARKS,
)
def _(df):
    return df.selectExpr(
        "id",
        f"{levels.extract_level('message')} AS level",
        f"{texts.trim_unicode('message')} AS clean_message",
    )


@log_query(
    "pattern_tags",
    """SELECT id, concat_ws(',', CASE WHEN is_error THEN 'error' END,
           CASE WHEN is_warning THEN 'warning' END, CASE WHEN is_start THEN 'stack_trace' END,
           CASE WHEN is_http THEN 'http_error' END, CASE WHEN is_sql THEN 'sql_error' END,
           CASE WHEN is_json THEN 'json_error' END) AS tags
    FROM marks""",
    sql.MARKS,
)
def _(df):
    return df.selectExpr(
        "id", f"array_join({patterns.pattern_tags('message')}, ',') AS tags"
    )


@log_query(
    "pattern_types",
    """SELECT id, concat_ws(',', CASE WHEN is_start OR is_frame THEN 'StackTrace' END,
           CASE WHEN is_http THEN 'HttpError' END, CASE WHEN is_sql THEN 'SqlError' END,
           CASE WHEN is_json THEN 'JsonError' END) AS types
    FROM marks""",
    sql.MARKS,
)
def _(df):
    return df.selectExpr(
        "id", f"array_join({patterns.pattern_types('message')}, ',') AS types"
    )


# Filters --------------------------------------------------------------------------------


@log_query("logs_by_container", f"{_ALL} WHERE container_id = 'c7'")
def _(df):
    return _log_columns(logs.filter_logs(df, container_id="c7"))


@log_query("logs_by_level", f"{_ALL} WHERE level = 'ERROR'")
def _(df):
    return _log_columns(logs.filter_logs(df, level="error"))


@log_query("logs_any_level", _ALL)
def _(df):
    return _log_columns(logs.filter_logs(df, level="All"))


@log_query("logs_search", f"{_ALL} WHERE message LIKE '%100!% done!_ok%' ESCAPE '!'")
def _(df):
    return _log_columns(logs.filter_logs(df, search="100% done_ok"))


@log_query("logs_by_stack", f"{_ALL} WHERE compose_project = 'stack3'")
def _(df):
    return _log_columns(logs.filter_logs(df, stack="stack3"))


@log_query("logs_by_container_list", f"{_ALL} WHERE container_id IN ('c1', 'c3', 'c14')")
def _(df):
    return _log_columns(logs.filter_logs(df, containers="c1,c3,c14, c5"))


@log_query(
    "logs_in_range",
    f"""{_ALL} WHERE timestamp >= TIMESTAMP '2024-01-10 06:00:00'
         AND timestamp < TIMESTAMP '2024-01-12 18:30:00'""",
)
def _(df):
    return _log_columns(
        logs.filter_logs(
            df, since=_utc(2024, 1, 10, 6), until=_utc(2024, 1, 12, 18, 30)
        )
    )


@log_query(
    "logs_by_pattern",
    f"""{_ALL} WHERE regexp_matches(message, '[0-9]+s?$') AND message NOT LIKE '%HTTP%'
         AND level IN ('INFO', 'WARN') AND source = 'STDOUT'""",
)
def _(df):
    return _log_columns(
        logs.filter_logs(
            df, regex="[0-9]+s?$", exclude="HTTP", levels_in=["info", "warn"], source="stdout"
        )
    )


@log_query(
    "live_filter",
    f"{_ALL} WHERE container_id IN ('c3', 'c13', 'c4') AND compose_project = 'stack3'",
)
def _(df):
    return _log_columns(logs.live_filter(df, ["c3", "c13", "c4"], "stack3"))


@log_query(
    "viewer_search",
    f"""SELECT * FROM (
          SELECT {sql.LOG_COLUMNS} FROM logs ORDER BY timestamp DESC, id DESC LIMIT 5000) kept
        WHERE level = 'ERROR' AND (lower(message) LIKE '%sql%' OR lower(container_name) LIKE '%sql%')
        ORDER BY timestamp DESC, id DESC LIMIT 500""",
)
def _(df):
    return _log_columns(logs.viewer_search(df, "error", "SQL", kept=5_000, shown=500))


@log_query(
    "viewer_search_all",
    f"""SELECT {sql.LOG_COLUMNS} FROM logs
        WHERE level = 'ERROR' AND (lower(message) LIKE '%sql%' OR lower(container_name) LIKE '%sql%')""",
)
def _(df):
    return _log_columns(logs.viewer_search(df, "error", "SQL"))


# Pages and statistics -------------------------------------------------------------------


@log_query("log_page", f"{_ALL} ORDER BY timestamp DESC, id DESC LIMIT 100 OFFSET 30")
def _(df):
    return logs.decode_logs(logs.log_page(df, offset=30)).withColumn(
        "metadata", F.coalesce("metadata", F.lit(""))
    )


@log_query(
    "log_page_info",
    """SELECT count(*) AS total, count(*) > 130 AS has_more,
           CASE WHEN count(*) > 130 THEN 'offset:130' END AS next_cursor
    FROM logs WHERE level = 'WARN'""",
)
def _(df):
    return logs.page_info(df, 100, 30, level="warn")


@log_query(
    "log_page_by_stack",
    f"""{_ALL} WHERE compose_project = 'stack3'
        ORDER BY timestamp DESC, id DESC LIMIT 5 OFFSET 2""",
)
def _(df):
    return _log_columns(logs.log_page(df, 5, 2, stack="stack3"))


@log_query(
    "log_page_before",
    f"""{_ALL} WHERE level = 'ERROR' AND timestamp < TIMESTAMP '2024-01-15'
        ORDER BY timestamp DESC, id DESC LIMIT 200""",
)
def _(df):
    before = (_utc(2024, 1, 15), 0)
    return _log_columns(logs.log_page(df, 200, before=before, level="error"))


_POSTFILTER = f"""SELECT * FROM (
      {_ALL} ORDER BY timestamp DESC, id DESC LIMIT 500 OFFSET 2) page
    WHERE compose_project = 'stack3' AND container_id IN ('c3', 'c13', 'c23', 'c93')"""


@log_query("log_page_postfilter", _POSTFILTER)
def _(df):
    return _log_columns(
        logs.log_page_postfilter(df, 500, 2, stack="stack3", containers="c3,c13,c23,c93")
    )


@log_query(
    "log_page_postfilter_info",
    f"""SELECT count(*) AS total, count(*) >= 500 AS has_more,
           CASE WHEN count(*) >= 500 THEN 'offset:502' END AS next_cursor
    FROM ({_POSTFILTER})""",
)
def _(df):
    page = logs.log_page_postfilter(df, 500, 2, stack="stack3", containers="c3,c13,c23,c93")
    return logs.page_info_postfilter(page, 500, 2)


@log_query(
    "log_total",
    "SELECT count(*) AS total FROM logs WHERE level = 'ERROR' AND message LIKE '%ERROR%'",
)
def _(df):
    return logs.log_total(df, level="error", search="ERROR")


_STATS = """SELECT count(*) AS total,
           count(*) FILTER (level = 'ERROR') AS error_count,
           count(*) FILTER (level = 'WARN') AS warn_count,
           count(*) FILTER (level = 'INFO') AS info_count,
           count(*) FILTER (level = 'DEBUG') AS debug_count"""


@log_query("log_stats", f"{_STATS} FROM logs WHERE compose_project = 'stack3'")
def _(df):
    return logs.log_stats(df, stack="stack3")


@log_query(
    "log_stats_sampled",
    f"""{_STATS} FROM (SELECT * FROM logs ORDER BY timestamp DESC, id DESC LIMIT 10000)
    WHERE compose_project = 'stack3'""",
)
def _(df):
    return logs.log_stats(df, stack="stack3", sample_limit=logs.STATS_SAMPLE)


@log_query(
    "log_stats_by_container",
    """SELECT container_id, max_by(container_name, timestamp) AS container_name, count(*) AS count
    FROM logs GROUP BY container_id""",
)
def _(df):
    return logs.log_stats_by_container(df)


@log_query(
    "level_distribution",
    """SELECT compose_project, level, count(*) AS count
    FROM logs GROUP BY compose_project, level""",
)
def _(df):
    return logs.level_distribution(df)


@log_query(
    "stack_levels",
    """SELECT compose_project, count(*) AS total,
           count(*) FILTER (level = 'ERROR') AS error_count,
           count(*) FILTER (level = 'WARN') AS warn_count
    FROM logs GROUP BY compose_project""",
)
def _(df):
    return logs.stack_levels(df)


@log_query(
    "logs_per_day",
    "SELECT CAST(timestamp AS DATE) AS day, count(*) AS count FROM logs GROUP BY ALL",
)
def _(df):
    return tables.rows_per_day(df)


@log_query(
    "log_retention",
    f"""{_ALL} WHERE timestamp >= (SELECT max(timestamp) FROM logs) - INTERVAL 7 DAY""",
)
def _(df):
    as_of = df.agg(F.max("timestamp").alias("newest")).first()["newest"]
    return _log_columns(tables.retained(df, as_of))


@log_query(
    "container_tail",
    """SELECT id, timestamp, container_id, message FROM logs
    QUALIFY row_number() OVER (PARTITION BY container_id ORDER BY timestamp DESC, id DESC) <= 50""",
)
def _(df):
    return logs.tail(df.select("id", "timestamp", "container_id", "message"))


@log_query("log_dedup", _ALL)
def _(df):
    # Every row comes twice, the copy with a far larger id.
    history = _log_columns(df)
    live = history.withColumn("id", F.col("id") + F.lit(1 << 40))
    return logs.dedup(history, live)


@log_query(
    "format_count",
    """SELECT id, CASE
           WHEN n >= 1000000
             THEN printf('%.1f', n / 1000000.0::DOUBLE
                    + CASE WHEN n % 500000 = 250000 THEN 0.01 ELSE 0 END) || 'M'
           WHEN n >= 1000
             THEN printf('%.1f', n / 1000.0::DOUBLE
                    + CASE WHEN n % 500 = 250 THEN 0.01 ELSE 0 END) || 'K'
           ELSE CAST(n AS VARCHAR) END AS shown
    FROM (SELECT id, id * 250 AS n FROM logs)""",
)
def _(df):
    return df.selectExpr("id", "id * 250 AS n").selectExpr(
        "id", f"{texts.format_count('n')} AS shown"
    )


# Patterns -------------------------------------------------------------------------------

_PATTERN_COUNTS = """,
hits AS (
  SELECT unnest(['error', 'warning', 'stack_trace', 'http_error', 'sql_error', 'json_error']) AS pattern,
         unnest([is_error, is_warning, is_start, is_http, is_sql, is_json]) AS hit, timestamp
  FROM marks
)
SELECT pattern,
       CASE pattern WHEN 'stack_trace' THEN 'StackTrace' WHEN 'http_error' THEN 'HttpError'
            WHEN 'sql_error' THEN 'SqlError' WHEN 'json_error' THEN 'JsonError'
            ELSE 'Custom(' || pattern || ')' END AS pattern_type,
       count(*) AS count, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
       CAST(count(*) OVER () AS INTEGER) AS detected_count
FROM hits WHERE hit GROUP BY pattern"""


@log_query("pattern_counts", _PATTERN_COUNTS, sql.MARKS)
def _(df):
    return pattern_ops.pattern_counts(df)


@log_query(
    "auto_filters",
    """SELECT * FROM (
      SELECT 'Errors' AS name, 'level=ERROR' AS query,
             count(*) FILTER (is_error OR is_start) AS count, 'Level' AS filter_type FROM marks
      UNION ALL SELECT 'Warnings', 'level=WARN', count(*) FILTER (is_warning), 'Level' FROM marks
      UNION ALL SELECT 'Stack Traces', 'pattern=stack_trace',
                       count(*) FILTER (is_start OR is_frame), 'Pattern' FROM marks
      UNION ALL SELECT 'HTTP Errors', 'pattern=http_error',
                       count(*) FILTER (is_http), 'Pattern' FROM marks
      UNION ALL SELECT 'Database Errors', 'pattern=sql_error',
                       count(*) FILTER (is_sql), 'Pattern' FROM marks)
    WHERE count > 0""",
    sql.MARKS,
)
def _(df):
    return pattern_ops.auto_filters(df)


_TRACE_LINES = """,
heads AS (
  SELECT *, last_value(CASE WHEN NOT is_frame THEN CASE WHEN is_start THEN id ELSE -1 END END
                       IGNORE NULLS)
              OVER (PARTITION BY container_id ORDER BY timestamp, id) AS trace_id
  FROM marks
)"""


@log_query(
    "trace_lines",
    f"{_TRACE_LINES} SELECT id, container_id, message, trace_id FROM heads WHERE trace_id <> -1",
    sql.MARKS,
)
def _(df):
    return pattern_ops.trace_lines(df).select("id", "container_id", "message", "trace_id")


@log_query(
    "stack_traces",
    f"""{_TRACE_LINES}
    SELECT container_id, trace_id, count(*) AS lines, min(timestamp) AS first_time,
           max(timestamp) AS last_time
    FROM heads WHERE trace_id <> -1 GROUP BY ALL""",
    sql.MARKS,
)
def _(df):
    return pattern_ops.stack_traces(df)


# Alerts ---------------------------------------------------------------------------------


@log_query("alert_events", "SELECT * FROM alert_events", sql.ALERTS)
def _(df):
    return alerts.alert_events(df, alerts.DEFAULT_RULES)


@log_query(
    "alert_matches_all",
    """SELECT id AS log_id, alert_id, timestamp,
           'Pattern ''' || pattern || ''' detected in container ' || container_id AS message,
           container_id
    FROM logs, (VALUES ('error-detection', 'ERROR'), ('exception-detection', 'exception'))
               AS rules (alert_id, pattern)
    WHERE contains(logs.message, pattern)""",
)
def _(df):
    return alerts.alert_matches_all(df, alerts.DEFAULT_RULES)


@log_query(
    "alert_stats",
    """SELECT r.alert_id, r.name, r.alert_type, true AS enabled,
           count(e.log_id) AS triggered_count, max(e.timestamp) AS last_triggered
    FROM (VALUES ('error-detection', 'Error Detection', 'Pattern'),
                 ('exception-detection', 'Exception Detection', 'Pattern'),
                 ('container-restart', 'Container Restart', 'ContainerRestart'))
         AS r (alert_id, name, alert_type)
    LEFT JOIN alert_events e ON e.alert_id = r.alert_id
    GROUP BY ALL""",
    sql.ALERTS,
)
def _(df):
    events = alerts.alert_events(df, alerts.DEFAULT_RULES)
    return alerts.alert_stats(events, alerts.DEFAULT_RULES)


@log_query(
    "alert_recent",
    "SELECT * FROM alert_events ORDER BY timestamp DESC, log_id DESC LIMIT 20",
    sql.ALERTS,
)
def _(df):
    return alerts.recent_events(alerts.alert_events(df, alerts.DEFAULT_RULES), 20)


@log_query(
    "alert_restarts",
    """SELECT id AS log_id, 'container-restart' AS alert_id, timestamp,
           'Pattern ''restarting'' detected in container ' || container_id AS message, container_id
    FROM logs WHERE message LIKE '%restarting%'""",
)
def _(df):
    return alerts.restart_alerts(df, alerts.DEFAULT_RULES)


@log_query(
    "alert_events_scoped",
    """SELECT log_id, alert_id, timestamp,
           'Pattern ''' || pattern || ''' detected in container ' || container_id AS message,
           container_id
    FROM (SELECT id AS log_id, timestamp, container_id,
                 CASE WHEN container_id = 'c7' AND message LIKE '%FATAL%' THEN 'fatal-in-c7'
                      WHEN message LIKE '%ERROR%' THEN 'error-detection'
                      WHEN message LIKE '%exception%' THEN 'exception-detection' END AS alert_id,
                 CASE alert_id WHEN 'fatal-in-c7' THEN 'FATAL' WHEN 'error-detection' THEN 'ERROR'
                      ELSE 'exception' END AS pattern
          FROM logs)
    WHERE alert_id IS NOT NULL""",
)
def _(df):
    scoped = alerts.AlertRule(
        "fatal-in-c7", "Fatal in c7", alerts.PATTERN, "FATAL", container_id="c7"
    )
    return alerts.alert_events(df, [scoped, *alerts.DEFAULT_RULES], scoped=True)


@event_query(
    "alert_thresholds",
    f"""WITH {sql.SAMPLES}
    SELECT id AS metric_id, alert_id, timestamp, container_id, cpu_percent
    FROM metrics, (VALUES ('cpu-high', 50), ('cpu-very-high', 100)) AS rules (alert_id, threshold)
    WHERE cpu_percent > threshold""",
)
def _(events):
    rules = [
        alerts.AlertRule("cpu-high", "CPU above 50", alerts.THRESHOLD, threshold_value=50.0),
        alerts.AlertRule("cpu-very-high", "CPU above 100", alerts.THRESHOLD, threshold_value=100.0),
    ]
    return alerts.threshold_alerts(metrics.metric_rows(views.stats_samples(events)), rules)


# Containers and stacks ------------------------------------------------------------------


def _flat_containers(df: DataFrame) -> DataFrame:
    port = "concat(p.private_port, ':', coalesce(string(p.public_port), '-'), '/', p.port_type)"
    return df.selectExpr(
        "id",
        "name",
        "image",
        "status",
        "created",
        f"{stack_of('labels')} AS project",
        f"array_join(transform(ports, p -> {port}), ',') AS ports",
    )


def container_query(name: str, oracle: str):
    def register(build):
        event_query(name, f"WITH {sql.CONTAINERS} {oracle}")(
            lambda events: build(views.containers(events))
        )
        return build

    return register


@container_query("container_scan", "SELECT * FROM containers")
def _(df):
    return _flat_containers(df)


@event_query(
    "container_project",
    f"""WITH {sql.CONTAINERS}
    SELECT id,
           CASE WHEN CAST(id[2:] AS BIGINT) % 13 = 0 THEN '' ELSE name END AS name,
           CASE WHEN CAST(id[2:] AS BIGINT) % 7 = 0 THEN '' ELSE image END AS image,
           CASE WHEN CAST(id[2:] AS BIGINT) % 17 = 0 THEN '' ELSE status END AS status,
           CASE WHEN CAST(id[2:] AS BIGINT) % 19 = 0 THEN 0 ELSE created END AS created,
           project,
           CASE WHEN CAST(id[2:] AS BIGINT) % 4 = 0 THEN '' ELSE upper(ports) END AS ports
    FROM containers""",
)
def _(events):
    return _flat_containers(containers.project_listing(views.container_listing(events)))


@container_query("containers_by_stack", "SELECT * FROM containers WHERE project = 'stack3'")
def _(df):
    return _flat_containers(containers.filter_containers(df, stack="stack3"))


@container_query("containers_by_status", "SELECT * FROM containers WHERE lower(status) LIKE '%up%'")
def _(df):
    return _flat_containers(containers.filter_containers(df, status="Running"))


@container_query(
    "containers_stopped", "SELECT * FROM containers WHERE lower(status) NOT LIKE '%up%'"
)
def _(df):
    return _flat_containers(containers.filter_containers(df, status="stopped"))


@container_query(
    "containers_search",
    "SELECT * FROM containers WHERE lower(name) LIKE '%svc-1%' OR lower(image) LIKE '%svc-1%'",
)
def _(df):
    return _flat_containers(containers.filter_containers(df, search="SVC-1"))


@container_query(
    "stack_rollup",
    """SELECT project AS name, count(*) AS container_count,
           count(*) FILTER (status LIKE 'Up%') AS running_count,
           count(*) FILTER (status NOT LIKE 'Up%') AS stopped_count
    FROM containers WHERE project IS NOT NULL GROUP BY project""",
)
def _(df):
    return containers.stack_rollup(df)


@event_query(
    "logs_semi_stack",
    f"""WITH {sql.LOGS}, {sql.CONTAINERS} {_ALL}
    WHERE container_id IN (SELECT id FROM containers WHERE project = 'stack3')""",
)
def _(events):
    return _log_columns(logs.logs_of_stack(views.logs(events), views.containers(events), "stack3"))


@event_query(
    "running_logs",
    f"""WITH {sql.LOGS}, {sql.CONTAINERS} {_ALL}
    WHERE container_id IN (SELECT id FROM containers WHERE status LIKE '%Up%')""",
)
def _(events):
    return _log_columns(logs.running_logs(views.logs(events), views.containers(events)))


@event_query(
    "running_tail",
    f"""WITH {sql.LOGS}, {sql.CONTAINERS}
    SELECT id, timestamp, container_id, message FROM logs
    WHERE container_id IN (SELECT id FROM containers WHERE status LIKE '%Up%')
    QUALIFY row_number() OVER (PARTITION BY container_id ORDER BY timestamp DESC, id DESC) <= 50""",
)
def _(events):
    lines = views.logs(events).select("id", "timestamp", "container_id", "message")
    return logs.tail(logs.running_logs(lines, views.containers(events)))


# Lines of containers that no longer run find no attributes.
_ENRICHED = """SELECT l.id, l.timestamp, l.container_id,
       coalesce(c.name, l.container_id) AS container_name,
       coalesce(c.project, '') AS compose_project, l.compose_file, l.message, l.level, l.source,
       '' AS metadata
FROM logs l LEFT JOIN (SELECT * FROM containers WHERE status LIKE 'Up%') c ON c.id = l.container_id"""


def _known_containers(events: DataFrame) -> DataFrame:
    return containers.filter_containers(views.containers(events), status="running")


@event_query("log_enrich", f"WITH {sql.LOGS}, {sql.CONTAINERS} {_ENRICHED}")
def _(events):
    return ingest.ingest_rows(views.raw_lines(events), _known_containers(events))


@event_query(
    "enabled_stack_logs",
    f"WITH {sql.LOGS} {_ALL} WHERE compose_project IN ('stack1', 'stack4')",
)
def _(events):
    known = containers.stack_rollup(views.containers(events)).select(
        F.col("name").alias("project_name"), F.col("name").isin("stack1", "stack4").alias("enabled")
    )
    return _log_columns(stacks.enabled_logs(views.logs(events), known))


def _flat_stacks(df: DataFrame) -> DataFrame:
    return df.withColumn("containers", F.array_join("containers", ","))


_STACKS = """SELECT md5(path) AS id, split_part(path, '/', -1) AS name, path,
       split_part(path, '/', -1) AS project_name, {services} AS containers, false AS enabled
FROM projects"""


@event_query(
    "compose_stacks",
    f"WITH {sql.COMPOSE} " + _STACKS.format(services="array_to_string(kinds, ',')"),
)
def _(events):
    return _flat_stacks(stacks.compose_stacks(views.compose_files(events)))


@event_query(
    "compose_stacks_loose",
    f"WITH {sql.COMPOSE} "
    + _STACKS.format(
        services="""array_to_string(list_concat(flatten(list_transform(kinds,
            lambda k: [k, 'image: img-' || k || ':latest'])), ['data']), ',')"""
    ),
)
def _(events):
    return _flat_stacks(stacks.compose_stacks(views.compose_files(events), loose=True))


# Metrics --------------------------------------------------------------------------------


def sample_query(name: str, oracle: str):
    def register(build):
        event_query(name, f"WITH {sql.SAMPLES} {oracle}")(
            lambda events: build(views.stats_samples(events))
        )
        return build

    return register


@sample_query("metric_samples", "SELECT * FROM samples")
def _(df):
    return metrics.metric_samples(df)


@sample_query("metric_rows", f"SELECT {sql.METRIC_COLUMNS} FROM metrics")
def _(df):
    return metrics.metric_rows(df)


@sample_query(
    "metric_encode",
    f"""SELECT * REPLACE (CASE WHEN id % 10 = 0 THEN 0 ELSE id END AS id)
    FROM (SELECT {sql.METRIC_COLUMNS} FROM metrics)""",
)
def _(df):
    entries = metrics.metric_samples(df)
    return metrics.encode_metrics(
        entries.withColumn("id", F.when(F.col("id") % 10 != 0, F.col("id")))
    )


@sample_query("cpu_percent", "SELECT id, cpu_percent FROM samples")
def _(df):
    return metrics.metric_samples(df).select("id", "cpu_percent")


@sample_query("memory_percent", "SELECT id, memory_percent FROM samples")
def _(df):
    return metrics.metric_samples(df).select("id", "memory_percent")


@sample_query("network_totals", "SELECT id, network_rx, network_tx FROM samples")
def _(df):
    return metrics.metric_samples(df).select("id", "network_rx", "network_tx")


@sample_query(
    "metric_latest",
    f"""SELECT {sql.METRIC_COLUMNS} FROM metrics ORDER BY timestamp DESC, id DESC LIMIT 100""",
)
def _(df):
    return metrics.metric_latest(metrics.metric_rows(df))


@sample_query(
    "metric_latest_by_container",
    f"""SELECT {sql.METRIC_COLUMNS} FROM metrics WHERE container_id = 'c7'
    ORDER BY timestamp DESC, id DESC LIMIT 1000""",
)
def _(df):
    return metrics.metric_latest(metrics.metric_rows(df), "c7", 5_000)


_FIGURES = """count(*) AS samples, round(avg(cpu_percent), 4) AS cpu_avg,
       max(cpu_percent) AS cpu_max, min(cpu_percent) AS cpu_min,
       round(avg(memory_usage), 4) AS memory_avg, max(memory_usage) AS memory_max,
       min(memory_usage) AS memory_min"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in ["cpu_avg", "memory_avg"]})


@sample_query("metric_summary", f"SELECT container_id, {_FIGURES} FROM metrics GROUP BY ALL")
def _(df):
    return _rounded(metrics.metric_summary(metrics.metric_rows(df)))


@sample_query(
    "metric_history",
    f"""SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS slot_start, container_id, {_FIGURES}
    FROM metrics GROUP BY ALL""",
)
def _(df):
    return _rounded(metrics.metric_history(metrics.metric_rows(df)))


@event_query(
    "metric_by_stack",
    f"""WITH {sql.SAMPLES}, {sql.CONTAINERS}
    SELECT project AS stack, count(*) AS samples, round(avg(cpu_percent), 4) AS cpu_avg,
           max(cpu_percent) AS cpu_max, round(avg(memory_usage), 4) AS memory_avg,
           max(memory_usage) AS memory_max
    FROM metrics JOIN containers ON containers.id = container_id
    WHERE project IS NOT NULL GROUP BY project""",
)
def _(events):
    rows = metrics.metric_rows(views.stats_samples(events))
    return _rounded(metrics.metric_by_stack(rows, views.containers(events)))


@event_query(
    "cpu_percent_lag",
    f"""WITH {sql.SAMPLES},
    totals AS (
      SELECT id, timestamp, container_id, event_id * 1000 AS sys,
             CAST(sum(cents) OVER (PARTITION BY container_id ORDER BY id) AS BIGINT) AS cpu
      FROM raw
    ),
    pairs AS (
      SELECT *, lag(cpu) OVER w AS prev_cpu, lag(sys) OVER w AS prev_sys
      FROM totals WINDOW w AS (PARTITION BY container_id ORDER BY id)
    )
    SELECT id, timestamp, container_id,
           CAST(cpu - prev_cpu AS DOUBLE) / CAST(sys - prev_sys AS DOUBLE)
             * CAST({views.CPUS} AS DOUBLE) * CAST(100 AS DOUBLE) AS cpu_percent
    FROM pairs WHERE prev_cpu IS NOT NULL""",
)
def _(events):
    return metrics.cpu_percent_from_counters(views.counters(events))


# Stored tables and exports --------------------------------------------------------------


@query(
    "log_write_roundtrip",
    f"WITH {sql.LOGS} SELECT {sql.LOG_COLUMNS}, CAST(timestamp AS DATE) AS day FROM logs",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "logs")
    tables.write_logs(logs.encode_logs(views.logs(views.read_events(spark, sf_dir))), path)
    return tables.read_logs(spark, path)


@query(
    "metric_write_roundtrip",
    f"""WITH {sql.SAMPLES}
    SELECT {sql.METRIC_COLUMNS}, CAST(timestamp AS DATE) AS day FROM metrics""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    samples = views.stats_samples(views.read_events(spark, sf_dir))
    tables.write_metrics(metrics.metric_rows(samples), path)
    return tables.read_metrics(spark, path)


_EXPORTED = """WHERE lower(level) = 'error'
    AND (lower(message) LIKE '%error%' OR lower(container_name) LIKE '%error%')"""


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the viewer shows, over all rows."""
    return views.logs(views.read_events(spark, sf_dir)).filter(logs.viewer_match("error", "Error"))


@query("export_json", f"WITH {sql.DISPLAY} SELECT * FROM display {_EXPORTED}")
def _(spark, sf_dir):
    path = scratch_path(spark, "export-json")
    exports.export_json(_exported(spark, sf_dir), path)
    return exports.read_json_export(spark, path)


@query(
    "export_csv",
    f"""WITH {sql.DISPLAY}
    SELECT timestamp, container_name, container_id, level, message FROM display {_EXPORTED}""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "export-csv")
    exports.export_csv(_exported(spark, sf_dir), path)
    return exports.read_csv_export(spark, path)


_JSON_TEXT = f"""WITH {sql.DISPLAY}
    SELECT CAST(json_object('id', id, 'timestamp', timestamp, 'container_id', container_id,
           'container_name', container_name, 'compose_project', compose_project,
           'compose_file', compose_file, 'message', message, 'level', level, 'source', source,
           'metadata', metadata) AS VARCHAR) AS value
    FROM display"""


@event_query("live_json", _JSON_TEXT)
def _(events):
    return exports.as_json(views.logs(events))


# Landed lines ---------------------------------------------------------------------------

_JSON_ROWS = f"""json_rows AS (
        SELECT id, container_id, k,
               CASE WHEN k IN (1, 2, 4, 5, 6, 9) THEN 'json'
                    WHEN k IN (3, 7, 10) THEN 'broken' ELSE 'plain' END AS format,
               CASE WHEN k = 9 THEN TIMESTAMP '2024-01-01 00:00:00.25' ELSE timestamp END AS event_time,
               CASE k WHEN 2 THEN '"' || message || '" é'
                      WHEN 3 THEN '{{"level":"error","message":"' || message || '"'
                      WHEN 6 THEN '{{"text":"' || message || '"}}'
                      WHEN 7 THEN '{{"message":"' || message || '"}} and more'
                      WHEN 8 THEN '["' || message || '"]'
                      WHEN 10 THEN concat('{{''message'':''', message, '''}}')
                      ELSE message END AS message,
               CASE k WHEN 1 THEN 'ERROR' WHEN 2 THEN 'WARN' WHEN 3 THEN 'ERROR' WHEN 4 THEN 'FATAL'
                      WHEN 9 THEN 'DEBUG' ELSE level END AS level,
               CASE WHEN k = 5 THEN 'STDERR' WHEN k IN (2, 3, 6, 7, 8, 10) THEN 'STDOUT'
                    ELSE source END AS source
        FROM (SELECT *, id % {len(views.JSON_FORMS)} AS k FROM logs)
    )"""


@query(
    "json_lines",
    f"""WITH {sql.LOGS}, {_JSON_ROWS}
    SELECT id, container_id, format, event_time, message, level, source,
           format = 'broken' AS kept_bad, format = 'json' AS kept_fields
    FROM json_rows""",
)
def _(spark, sf_dir):
    parsed = ingest.parse_lines(views.json_raw_lines(views.read_events(spark, sf_dir)))
    return parsed.selectExpr(
        "id",
        "container_id",
        "format",
        "event_time",
        "message",
        "level",
        "source",
        "bad_record IS NOT NULL AND endswith(line, bad_record) AS kept_bad",
        "length(fields) > 0 AND endswith(line, fields) AS kept_fields",
    )


@query(
    "json_ingest",
    f"""WITH {sql.LOGS}, {_JSON_ROWS}
    SELECT compose_project, json_rows.level, count(*) AS count
    FROM json_rows JOIN logs USING (id) GROUP BY ALL""",
)
def _(spark, sf_dir):
    events = views.read_events(spark, sf_dir)
    rows = ingest.ingest_rows(views.json_raw_lines(events), views.containers(events))
    return logs.level_distribution(rows)


@query(
    "log_dedup_exact_time",
    f"""WITH {sql.LOGS}
    SELECT min(id) AS id, container_id, ts, message
    FROM logs JOIN events ON id = event_id WHERE id % 7 <> 0 GROUP BY container_id, ts, message
    UNION ALL
    SELECT id, container_id, NULL, message FROM logs, (VALUES (1), (2)) WHERE id % 7 = 0""",
)
def _(spark, sf_dir):
    """Lines that differ only in microseconds stay apart; those without a time are never merged."""
    lines = views.raw_lines_exact(views.read_events(spark, sf_dir))
    parsed = ingest.parse_lines(ingest.unique_lines(lines, lines))
    return parsed.selectExpr("id", "container_id", "event_time AS ts", "message")


# Streaming ------------------------------------------------------------------------------

_ONCE = {"availableNow": True}


@query("stream_ingest", f"WITH {sql.LOGS}, {sql.CONTAINERS} {_ENRICHED}")
def _(spark, sf_dir):
    path = scratch_path(spark, "stream-logs")
    jobs.ingest_logs(
        views.raw_lines(views.stream_events(spark, sf_dir)),
        lambda session: _known_containers(views.read_events(session, sf_dir)),
        path,
        scratch_path(spark, "checkpoint"),
        _ONCE,
    ).awaitTermination()
    return _log_columns(tables.read_logs(spark, path))


@query("stream_ingest_refresh", f"WITH {sql.LOGS}, {sql.CONTAINERS} {_ENRICHED}")
def _(spark, sf_dir):
    """Several batches, each of which reads a stored snapshot that lists containers repeatedly."""
    landed, snapshot, path = (scratch_path(spark, n) for n in ("landed", "snapshot", "stream-logs"))
    events = views.read_events(spark, sf_dir)
    views.raw_lines(events).repartition(3).write.parquet(landed)
    known = _known_containers(events)
    known.unionByName(known).write.parquet(snapshot)
    jobs.ingest_logs(
        tables.stream_rows(spark, landed, schemas.RAW_LINES, files_per_batch=1),
        lambda session: tables.read_containers(session, snapshot),
        path,
        scratch_path(spark, "checkpoint"),
        _ONCE,
    ).awaitTermination()
    return _log_columns(tables.read_logs(spark, path))


@query("stream_metrics", f"WITH {sql.SAMPLES} SELECT {sql.METRIC_COLUMNS} FROM metrics")
def _(spark, sf_dir):
    path = scratch_path(spark, "stream-metrics")
    jobs.ingest_metrics(
        views.stats_samples(views.stream_events(spark, sf_dir)),
        path,
        scratch_path(spark, "checkpoint"),
        _ONCE,
    ).awaitTermination()
    return tables.read_metrics(spark, path).drop(schemas.DAY)


@query("stream_pattern_counts", f"WITH {sql.MARKS} {_PATTERN_COUNTS}")
def _(spark, sf_dir):
    path = scratch_path(spark, "stream-patterns")
    jobs.count_patterns(
        views.logs(views.stream_events(spark, sf_dir)),
        path,
        scratch_path(spark, "checkpoint"),
        _ONCE,
    ).awaitTermination()
    return jobs.read_pattern_counts(spark, path)


@query("stream_alerts", f"WITH {sql.ALERTS} SELECT * FROM alert_events")
def _(spark, sf_dir):
    path = scratch_path(spark, "stream-alerts")
    jobs.raise_alerts(
        views.logs(views.stream_events(spark, sf_dir)),
        alerts.DEFAULT_RULES,
        path,
        scratch_path(spark, "checkpoint"),
        _ONCE,
    ).awaitTermination()
    return tables.read_alert_events(spark, path).drop(schemas.DAY, "rules_version")


@query("stream_dedup", f"WITH {sql.LOGS} SELECT timestamp, container_id, message FROM logs")
def _(spark, sf_dir):
    path = scratch_path(spark, "stream-unique")
    lines = _log_columns(views.logs(views.stream_events(spark, sf_dir)))
    jobs.drop_repeated_lines(
        lines.unionByName(lines), path, scratch_path(spark, "checkpoint"), _ONCE
    ).awaitTermination()
    return spark.read.parquet(path).select(*logs.DUPLICATE_KEY)


@query("stream_live_json", f"{_JSON_TEXT} WHERE compose_project = 'stack3'")
def _(spark, sf_dir):
    path = scratch_path(spark, "stream-live")
    jobs.push_live(
        views.logs(views.stream_events(spark, sf_dir)),
        path,
        scratch_path(spark, "checkpoint"),
        stack="stack3",
        trigger=_ONCE,
    ).awaitTermination()
    return spark.read.text(path)


# Stored tables --------------------------------------------------------------------------


def _stored_logs(spark, sf_dir):
    path = scratch_path(spark, "stored-logs")
    tables.write_logs(views.logs(views.read_events(spark, sf_dir)), path)
    return tables.read_logs(spark, path)


def _sealed_logs(spark, sf_dir):
    """A log table of three streamed batches whose days but the last are sealed; its path."""
    landed, path = scratch_path(spark, "landed"), scratch_path(spark, "sealed-logs")
    events = views.read_events(spark, sf_dir)
    views.raw_lines(events).repartition(3, "id").write.parquet(landed)
    jobs.ingest_logs(
        tables.stream_rows(spark, landed, schemas.RAW_LINES, files_per_batch=1),
        lambda session: _known_containers(views.read_events(session, sf_dir)),
        path,
        scratch_path(spark, "checkpoint"),
        _ONCE,
    ).awaitTermination()
    newest = tables.read_logs(spark, path).agg(F.max(schemas.DAY).alias("day")).first().day
    sealed.seal(spark, path, schemas.LOGS, newest)
    return path


@query("stored_compaction", f"WITH {sql.LOGS}, {sql.CONTAINERS} {_ENRICHED}")
def _(spark, sf_dir):
    path = _sealed_logs(spark, sf_dir)
    sealed.clean(spark, path)
    return _log_columns(tables.read_logs(spark, path))


@query("stored_log_stats", f"WITH {sql.LOGS} {_STATS} FROM logs")
def _(spark, sf_dir):
    return logs.stats_of_counts(sealed.counts(spark, _sealed_logs(spark, sf_dir)))


@query(
    "stored_stats_by_container",
    f"WITH {sql.LOGS} SELECT container_id, count(*) AS count FROM logs GROUP BY container_id",
)
def _(spark, sf_dir):
    counts = sealed.counts(spark, _sealed_logs(spark, sf_dir))
    return logs.stats_by_container_of_counts(counts).select("container_id", "count")


@query(
    "stored_logs_search",
    f"""WITH {sql.LOGS} SELECT id, timestamp, container_id, message FROM logs
    WHERE contains(message, 'terror averted')""",
)
def _(spark, sf_dir):
    text = "terror averted"
    found = sealed.read_with_text(spark, _sealed_logs(spark, sf_dir), text)
    return logs.filter_logs(found, search=text).select("id", "timestamp", "container_id", "message")


@query(
    "stored_log_page_by_day",
    f"""WITH {sql.LOGS} {_ALL} WHERE level = 'ERROR' AND timestamp < TIMESTAMP '2024-01-20'
    ORDER BY timestamp DESC, id DESC LIMIT 150 OFFSET 20""",
)
def _(spark, sf_dir):
    before = (_utc(2024, 1, 20), None)
    page = logs.log_page_by_day(_stored_logs(spark, sf_dir), 150, 20, before=before, level="error")
    return _log_columns(page)


@query(
    "stored_metric_latest_by_day",
    f"""WITH {sql.SAMPLES} SELECT {sql.METRIC_COLUMNS} FROM metrics
    ORDER BY timestamp DESC, id DESC LIMIT 100""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "stored-metrics")
    tables.write_metrics(metrics.metric_rows(views.stats_samples(views.read_events(spark, sf_dir))), path)
    return metrics.metric_latest_by_day(tables.read_metrics(spark, path)).drop(schemas.DAY)


@query("stored_stats_samples", f"WITH {sql.SAMPLES} SELECT {sql.METRIC_COLUMNS} FROM metrics")
def _(spark, sf_dir):
    path = scratch_path(spark, "stored-samples")
    views.stats_samples(views.read_events(spark, sf_dir)).write.parquet(path)
    return metrics.metric_rows(tables.read_stats_samples(spark, path))


@query(
    "stored_containers",
    f"WITH {sql.CONTAINERS} SELECT id, name, image, status, created FROM containers",
)
def _(spark, sf_dir):
    """The snapshot is published twice; a reader sees the newer version alone."""
    path = scratch_path(spark, "snapshots")
    known = views.containers(views.read_events(spark, sf_dir))
    for version in (known.where("created % 2 = 0"), known):
        tables.publish_containers(version, path)
    return tables.read_containers(spark, path).select("id", "name", "image", "status", "created")


@query(
    "stored_listing",
    f"WITH {sql.CONTAINERS} SELECT count(*) AS listed, sum(CAST(substr(id, 2) AS BIGINT)) AS users FROM containers",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "listing")
    views.container_listing(views.read_events(spark, sf_dir)).write.parquet(path)
    listed = containers.project_listing(tables.read_container_listing(spark, path))
    return listed.agg(F.count("*").alias("listed"), F.expr("sum(bigint(substring(id, 2))) AS users"))


@query("stream_ingest_published", f"WITH {sql.LOGS}, {sql.CONTAINERS} {_ENRICHED}")
def _(spark, sf_dir):
    """Several batches, each of which pins the newest published snapshot and what was measured with it."""
    landed, snapshot, path = (scratch_path(spark, n) for n in ("landed", "snapshot", "stream-logs"))
    events = views.read_events(spark, sf_dir)
    views.raw_lines(events).repartition(3).write.parquet(landed)
    for _ in range(2):
        tables.publish_containers(_known_containers(events), snapshot)
    jobs.ingest_logs(
        tables.stream_rows(spark, landed, schemas.RAW_LINES, files_per_batch=1),
        lambda session: tables.read_attributes(session, snapshot),
        path,
        scratch_path(spark, "checkpoint"),
        _ONCE,
    ).awaitTermination()
    return _log_columns(tables.read_logs(spark, path))


# Folders of projects that a task writes, and one lists; more groups than Spark lists on the driver.
GROUP_PROJECTS = 256
LEAST_GROUPS = 64
# Without native code, a local file system starts four processes for the rights of a file that has a
# checksum file beside it, else one. Other file systems do not read these options.
NO_CHECKSUMS = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}


def _write_projects(projects: DataFrame, path: str) -> None:
    """Text files of (value, project), one folder per project.

    The folders are dealt into groups, a folder per writing task, which a commit moves whole. The number
    of groups is given, as adaptive execution would leave one task for texts of so few bytes.
    """
    groups = max(LEAST_GROUPS, -(-projects.count() // GROUP_PROJECTS))
    dealt = projects.repartition(groups, "project").withColumn("group", F.spark_partition_id())
    files = dealt.write.options(**NO_CHECKSUMS).option("maxRecordsPerFile", 1)
    files.partitionBy("group", "project").text(path)


@query(
    "compose_files_scan",
    f"WITH {sql.COMPOSE} SELECT count(*) AS files, sum(len(kinds)) AS services FROM projects",
)
def _(spark, sf_dir):
    """Compose files as text files, one in each project's folder, found and read by executors."""
    path = scratch_path(spark, "compose")
    found = views.compose_files(views.read_events(spark, sf_dir))
    own = found.where("path RLIKE '/app-[0-9]+/docker-compose.yml$'")
    projects = own.selectExpr("content AS value", "regexp_extract(path, '(app-[0-9]+)/', 1) AS project")
    _write_projects(projects, path)
    files = tables.read_compose_files(spark, [path], names="part-*.txt")
    files = files.withColumn("path", F.regexp_replace("path", "part-[^/]*$", "docker-compose.yml"))
    # stacks are found by several passes, and each text file is opened once
    read = scratch_path(spark, "compose-read")
    files.write.parquet(read)
    found = stacks.compose_stacks(spark.read.schema(files.schema).parquet(read))
    return found.agg(F.count("*").alias("files"), F.expr("sum(bigint(size(containers))) AS services"))


def _tied(df: DataFrame) -> DataFrame:
    """Log rows without ids, with whole days as times and few containers, so that many are equal."""
    return df.withColumns(
        {
            "id": F.lit(None).cast("long"),
            "timestamp": F.date_trunc("day", "timestamp"),
            "container_id": F.expr("concat('c', id % 3)"),
            "container_name": F.lit(""),
            "compose_project": F.lit(""),
            "metadata": F.lit(""),
        }
    )


_TIED = f"""WITH {sql.LOGS}, tied AS (
        SELECT CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS timestamp, 'c' || id % 3 AS container_id, message, level, source
        FROM logs)"""


@query(
    "log_page_keyset_ties",
    f"""{_TIED} SELECT * FROM tied
    ORDER BY timestamp DESC, container_id DESC, message DESC, level DESC, source DESC LIMIT 280""",
)
def _(spark, sf_dir):
    """Four pages, each from the key of the one before, over rows most of which are equal."""
    rows = _tied(views.logs(views.read_events(spark, sf_dir)))
    key, pages = logs.FIRST_PAGE, []
    for _ in range(4):
        pages.append(logs.log_page(rows, 70, before=key))
        key = logs.next_key(pages[-1], key)
    union = pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])
    return union.select("timestamp", "container_id", "message", "level", "source")


@query(
    "log_page_key_info",
    f"{_TIED} SELECT count(*) AS total, count(*) > 70 AS has_more, count(*) > 70 AS has_key FROM tied",
)
def _(spark, sf_dir):
    info = logs.page_info_by_key(_tied(views.logs(views.read_events(spark, sf_dir))), 70)
    return info.selectExpr("total", "has_more", "coalesce(startswith(next_cursor, 'key:'), false) AS has_key")


@query(
    "stack_traces_no_ids",
    f"""WITH {sql.MARKS}, blocks AS (
        SELECT *, count(CASE WHEN NOT is_frame THEN 1 END) OVER (
            PARTITION BY container_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS block
        FROM marks
    ),
    traces AS (
        SELECT container_id, block, count(*) AS lines, min(timestamp) AS first_time, max(timestamp) AS last_time
        FROM blocks GROUP BY container_id, block HAVING bool_or(is_start AND NOT is_frame)
    )
    SELECT container_id, lines, first_time, last_time FROM traces
    UNION ALL
    SELECT container_id, 1, first_time, first_time FROM traces""",
)
def _(spark, sf_dir):
    """Every line that announces a trace comes twice, and no line has an id."""
    df = views.logs(views.read_events(spark, sf_dir))
    heads = df.where(patterns.matches("message", "stack_start"))
    rows = df.unionByName(heads).withColumn("id", F.lit(None).cast("long"))
    return pattern_ops.stack_traces(rows).drop("trace_id")


@query(
    "alert_events_many_rules",
    f"""WITH {sql.LOGS}, texts AS (SELECT DISTINCT message FROM logs),
    first AS (
        SELECT message, max(k) AS k FROM texts, range(10000) AS r(k)
        WHERE contains(message, CAST(k AS VARCHAR)) GROUP BY message
    )
    SELECT id AS log_id, 'rule-' || k AS alert_id, timestamp,
           'Pattern ''' || k || ''' detected in container ' || container_id AS message, container_id
    FROM logs JOIN first USING (message)""",
)
def _(spark, sf_dir):
    """10,000 rules, one for each number from 9,999 down; the largest number in a line fires."""
    rules = [alerts.AlertRule(f"rule-{k}", "", alerts.PATTERN, str(k)) for k in reversed(range(10_000))]
    return alerts.alert_events(views.logs(views.read_events(spark, sf_dir)), rules)


@query(
    "stream_alerts_changed_rules",
    f"""WITH {sql.LOGS}
    SELECT id AS log_id, 'started' AS alert_id, 1 AS rules_version FROM logs
    WHERE timestamp < TIMESTAMP '2024-01-11' AND contains(message, 'ERROR')
    UNION ALL
    SELECT id, CASE WHEN contains(message, 'ERROR') THEN 'started' ELSE 'added' END, 2 FROM logs
    WHERE timestamp >= TIMESTAMP '2024-01-11' AND (contains(message, 'ERROR') OR contains(message, 'port'))""",
)
def _(spark, sf_dir):
    """A rule that is added between two batches fires in the second, with the version that holds it."""
    landed, path, folder, checkpoint = (
        scratch_path(spark, n) for n in ("landed", "stream-alerts", "rules", "checkpoint")
    )
    rows = _log_columns(views.logs(views.read_events(spark, sf_dir)))
    border = F.lit(_utc(2024, 1, 11))
    added = {"started": "ERROR", "added": "port"}
    for part, name in ((F.col("timestamp") < border, "started"), (F.col("timestamp") >= border, "added")):
        rule = alerts.AlertRule(name, name, alerts.PATTERN, added[name])
        stored_rules.change_rules(spark, folder, lambda rules, rule=rule: alerts.add_rule(rules, rule))
        rows.where(part).coalesce(1).write.mode("append").parquet(landed)
        jobs.raise_alerts(
            tables.stream_rows(spark, landed, schemas.LOGS),
            lambda session: stored_rules.read_rules(session, folder),
            path,
            checkpoint,
            _ONCE,
        ).awaitTermination()
    return tables.read_alert_events(spark, path).select("log_id", "alert_id", "rules_version")
