"""SQL of the derived tables, for the queries that check this library's results."""

from logweir.sources.event_views import CPUS, MESSAGES, RAW_LEVELS


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


LOG_COLUMNS = (
    "id, timestamp, container_id, container_name, compose_project, compose_file, "
    "message, level, source, metadata"
)

LOGS = f"""
lines AS (
  SELECT event_id AS id,
         date_trunc('millisecond', ts) AS timestamp,
         'c' || user_id AS container_id,
         'svc-' || user_id AS container_name,
         CASE WHEN user_id % 11 = 0 THEN '' ELSE 'stack' || (user_id % 10) END AS compose_project,
         'docker-compose.yml' AS compose_file,
         {_list(MESSAGES)}[event_id % {len(MESSAGES)} + 1] AS message,
         CASE WHEN event_id % 4 = 0 THEN '' ELSE props END AS metadata,
         {_list(RAW_LEVELS)}[event_id % {len(RAW_LEVELS)} + 1] AS level_raw
  FROM events
),
logs AS (
  SELECT *,
         CASE WHEN regexp_matches(message, '(?i)error|fatal|critical') THEN 'ERROR'
              WHEN regexp_matches(message, '(?i)warn') THEN 'WARN'
              WHEN regexp_matches(message, '(?i)debug|trace') THEN 'DEBUG'
              ELSE 'INFO' END AS level,
         CASE WHEN message LIKE 'stderr%' THEN 'STDERR' ELSE 'STDOUT' END AS source
  FROM lines
)"""

# Every pattern as a truth value per log row.
MARKS = (
    LOGS
    + r""",
marks AS (
  SELECT *,
         regexp_matches(message, '(?i)\b(error|err|fatal|critical|exception)\b') AS is_error,
         regexp_matches(message, '(?i)\b(warn|warning)\b') AS is_warning,
         regexp_matches(message, '(?i)\b(debug|trace|verbose)\b') AS is_debug,
         regexp_matches(message, '^\s+at\s+[\w.]+\(.*\)$') AS is_frame,
         regexp_matches(message, '(?i)(exception|traceback|stack\s*trace)') AS is_start,
         regexp_matches(message, 'HTTP/[\d.]+\s+([45]\d{2})') AS is_http,
         regexp_matches(message, '(?i)(sql\s*error|database\s*error|deadlock|timeout)') AS is_sql,
         regexp_matches(message, '(?i)(json\.parse|invalid\s*json|unexpected\s*token)') AS is_json
  FROM logs
)"""
)

CONTAINERS = """
containers AS (
  SELECT 'c' || u AS id, 'svc-' || u AS name, 'img' || (u % 7) || ':latest' AS image,
         CASE WHEN u % 3 = 0 THEN 'Exited (0) 2 hours ago' ELSE 'Up 3 hours' END AS status,
         1700000000 + u AS created,
         CASE WHEN u % 11 <> 0 THEN 'stack' || (u % 10) END AS project,
         '80:' || (8000 + u % 1000) || '/tcp,443:-/udp' AS ports
  FROM (SELECT DISTINCT user_id AS u FROM events)
)"""

SAMPLES = f"""
raw AS (
  SELECT event_id AS id, date_trunc('millisecond', ts) AS timestamp,
         'c' || user_id AS container_id, 'svc-' || user_id AS container_name,
         CAST(round(value * 100) AS BIGINT) AS cents, user_id, event_id,
         CASE WHEN event_id % 13 = 0 THEN 0 ELSE event_id * 1000 + 50000 END AS sys,
         event_id * 1000 AS prev_sys,
         CASE WHEN event_id % 7 = 0 THEN 1 ELSE {CPUS} END AS cpus,
         CASE WHEN event_id % 17 = 0 THEN 0 ELSE event_id % 1000 * 1048576 END AS memory_usage,
         CASE WHEN event_id % 19 = 0 THEN 1 ELSE 2147483648 END AS memory_limit
  FROM events
),
samples AS (
  SELECT id, timestamp, container_id, container_name,
         CASE WHEN sys - prev_sys > 0
              THEN CAST(cents AS DOUBLE) / CAST(sys - prev_sys AS DOUBLE)
                   * CAST(cpus AS DOUBLE) * CAST(100 AS DOUBLE)
              ELSE CAST(0 AS DOUBLE) END AS cpu_percent,
         memory_usage, memory_limit,
         CAST(memory_usage AS DOUBLE) / CAST(memory_limit AS DOUBLE) * CAST(100 AS DOUBLE)
           AS memory_percent,
         CASE WHEN event_id % 23 = 0 THEN 0 ELSE event_id % 1000 * 10 + user_id END AS network_rx,
         CASE WHEN event_id % 23 = 0 THEN 0 ELSE cents + 7 END AS network_tx,
         event_id * 3 AS block_read, event_id * 5 AS block_write
  FROM raw
),
metrics AS (
  SELECT id, timestamp, container_id, container_name,
         CAST(cpu_percent AS REAL) AS cpu_percent, CAST(memory_percent AS REAL) AS memory_percent,
         memory_usage, network_rx, network_tx, block_read, block_write
  FROM samples
)"""

METRIC_COLUMNS = (
    "id, timestamp, container_id, container_name, cpu_percent, memory_percent, "
    "memory_usage, network_rx, network_tx, block_read, block_write"
)

# First match per line and every match per line, for the default rules.
ALERTS = (
    LOGS
    + """,
fired AS (
  SELECT id AS log_id,
         CASE WHEN message LIKE '%ERROR%' THEN 'error-detection'
              WHEN message LIKE '%exception%' THEN 'exception-detection' END AS alert_id,
         timestamp, container_id
  FROM logs
),
alert_events AS (
  SELECT log_id, alert_id, timestamp,
         'Pattern ''' || CASE alert_id WHEN 'error-detection' THEN 'ERROR' ELSE 'exception' END
           || ''' detected in container ' || container_id AS message,
         container_id
  FROM fired WHERE alert_id IS NOT NULL
)"""
)

# Log rows as clients see them.
DISPLAY = (
    LOGS
    + """,
display AS (
  SELECT id,
         strftime(timestamp, '%Y-%m-%dT%H:%M:%S')
           || CASE WHEN millisecond(timestamp) % 1000 = 0 THEN '' ELSE strftime(timestamp, '.%g') END
           || 'Z' AS timestamp,
         container_id, container_name, compose_project, compose_file, message,
         upper(level[1]) || lower(level[2:]) AS level,
         upper(source[1]) || lower(source[2:]) AS source,
         nullif(metadata, '') AS metadata
  FROM logs
)"""
)

COMPOSE = """
projects AS (
  SELECT user_id AS u,
         '/srv/' || CASE WHEN user_id % 11 <> 0 THEN 'stack' || (user_id % 10) ELSE 'misc' END
           || '/app-' || user_id AS path,
         list_sort(list(DISTINCT event_type)) AS kinds
  FROM events GROUP BY user_id
)"""
