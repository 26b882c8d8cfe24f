"""Log, container, sample and compose tables derived from a table of user events.

Each function maps an ``events`` DataFrame, batch or streaming, and keeps all of its rows:
one log line, one raw line and one resource sample per event, one container and one compose
file per user.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.functions import levels
from logweir.functions.clock import rfc3339, to_millis
from logweir.functions.container import COMPOSE_FILE, PROJECT_LABEL
from logweir.operators.sequence import running_sum

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

# The line that an event becomes, by event_id modulo their number.
MESSAGES = [
    "ERROR: upstream pool exhausted",
    "WARNING: disk quota nearly reached",
    "DEBUG: cache warmed in 41 ms",
    "Listener bound to port 9443",
    "Exception in thread worker-7",
    "HTTP/1.1 502 Error from upstream",
    "SQL Error: duplicate key on orders",
    "JSON.parse: unexpected token near column 7",
    "Traceback (most recent call last)",
    "    at org.sample.Worker.run(Worker.java:42)",
    "caught exception: request timeout after 30s",
    "FATAL ERROR: unhandled exception",
    "GET /health HTTP/1.1 200 OK",
    "container restarting",
    "stderr: verbose 100% done_ok",
    "retry succeeded, terror averted",
]

# Level spellings as feeds write them, by event_id modulo their number.
RAW_LEVELS = ["debug", "INFO", "Warning", "err", "CRITICAL", "fatal", "WARN", "???", "Error"]

CPUS = 4


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as a stream. A glob lets the path be one file or a folder of them."""
    return spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/{{events.parquet}}")


def _pick(values: list[str]) -> str:
    """The entry of ``values`` at event_id modulo their number."""
    listed = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), int(event_id % {len(values)} + 1))"


_CONTAINER_ID = "concat('c', user_id)"
_CONTAINER_NAME = "concat('svc-', user_id)"
# The user's stack, or null for the unlabelled.
_STACK = "CASE WHEN user_id % 11 != 0 THEN concat('stack', user_id % 10) END"
_CENTS = "bigint(round(value * 100))"


def logs(events: DataFrame, exact_time: bool = False) -> DataFrame:
    """Log rows with ingest level and source; ``level_raw`` holds unnormalised spellings.

    ``exact_time`` leaves the microseconds in.
    """
    time = "timestamp(ts)"
    lines = events.selectExpr(
        "event_id AS id",
        f"{time if exact_time else to_millis(time)} AS timestamp",
        f"{_CONTAINER_ID} AS container_id",
        f"{_CONTAINER_NAME} AS container_name",
        f"coalesce({_STACK}, '') AS compose_project",
        f"'{COMPOSE_FILE}' AS compose_file",
        f"{_pick(MESSAGES)} AS message",
        "CASE WHEN event_id % 4 = 0 THEN '' ELSE props END AS metadata",
        f"{_pick(RAW_LEVELS)} AS level_raw",
    )
    return lines.selectExpr(
        "id",
        "timestamp",
        "container_id",
        "container_name",
        "compose_project",
        "compose_file",
        "message",
        f"{levels.ingest_level('message')} AS level",
        f"{levels.ingest_source('message')} AS source",
        "metadata",
        "level_raw",
    )


def raw_lines(events: DataFrame) -> DataFrame:
    """Lines as a shipper lands them: time prefix, space, text."""
    return events.selectExpr(
        "event_id AS id",
        f"{_CONTAINER_ID} AS container_id",
        f"concat({rfc3339('timestamp(ts)')}, ' ', {_pick(MESSAGES)}) AS line",
    )


def raw_lines_exact(events: DataFrame) -> DataFrame:
    """Raw lines with all digits of their time; every seventh has none."""
    time = "concat(replace(string(ts), ' ', 'T'), 'Z ')"
    return events.selectExpr(
        "event_id AS id",
        f"{_CONTAINER_ID} AS container_id",
        f"concat(CASE WHEN event_id % 7 != 0 THEN {time} ELSE '' END, {_pick(MESSAGES)}) AS line",
    )


# How the line of an event is written as JSON, by event_id modulo their number; ~ is the message
# and @ the time.
JSON_FORMS = [
    "~",
    '{"level":"error","message":"~","time":"@"}',
    r'{"severity":"Warning","msg":"\"~\" é","user":{"id":7,"tags":["a",{"b":1}]}}',
    '{"level":"error","message":"~"',
    '{"message":"first","level":"info","message":"~","level":"fatal"}',
    r'{"log":"~\n","stream":"stderr","time":"@"}',
    '{"message":{"text":"~"},"level":30}',
    '{"message":"~"} and more',
    '["~"]',
    ' {"msg":"~","lvl":"TRACE","ts":1704067200.25} ',
    "{'message':'~'}",
]
# Those that stand alone; the others have the runtime's time prefix.
JSON_ALONE = [1, 5, 9]


def _literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def json_raw_lines(events: DataFrame) -> DataFrame:
    """Raw lines of which most are JSON objects, whole or broken."""
    kind = f"event_id % {len(JSON_FORMS)}"
    form = f"element_at(array({', '.join(map(_literal, JSON_FORMS))}), int({kind} + 1))"
    time = rfc3339("timestamp(ts)")
    text = f"replace(replace({form}, '~', {_pick(MESSAGES)}), '@', {time})"
    alone = f"{kind} IN ({', '.join(map(str, JSON_ALONE))})"
    return events.selectExpr(
        "event_id AS id",
        f"{_CONTAINER_ID} AS container_id",
        f"CASE WHEN {alone} THEN {text} ELSE concat({time}, ' ', {text}) END AS line",
    )


_STATUS = "CASE WHEN user_id % 3 = 0 THEN 'Exited (0) 2 hours ago' ELSE 'Up 3 hours' END"
_IMAGE = "concat('img', user_id % 7, ':latest')"
_LABELS = (
    f"CASE WHEN user_id % 11 != 0 THEN map('{PROJECT_LABEL}', {_STACK}) "
    "ELSE CAST(map() AS map<string, string>) END"
)
_PORTS = (
    "array(named_struct('private_port', 80, 'public_port', int(8000 + user_id % 1000), "
    "'port_type', 'tcp'), named_struct('private_port', 443, 'public_port', int(NULL), "
    "'port_type', 'udp'))"
)


def _users(events: DataFrame) -> DataFrame:
    return events.select("user_id").distinct()


def containers(events: DataFrame) -> DataFrame:
    """Container snapshot: one row per user."""
    return _users(events).selectExpr(
        f"{_CONTAINER_ID} AS id",
        f"{_CONTAINER_NAME} AS name",
        f"{_IMAGE} AS image",
        f"{_STATUS} AS status",
        "1700000000 + user_id AS created",
        f"{_LABELS} AS labels",
        f"{_PORTS} AS ports",
    )


def container_listing(events: DataFrame) -> DataFrame:
    """The snapshot as a daemon lists it: slashed names, and fields that may be missing."""
    slashed = f"concat('/', {_CONTAINER_NAME})"
    return _users(events).selectExpr(
        f"{_CONTAINER_ID} AS id",
        f"""CASE WHEN user_id % 13 = 0 THEN CAST(array() AS array<string>)
                 WHEN user_id % 5 = 0 THEN array(concat('/', {slashed}), '/alias')
                 ELSE array({slashed}) END AS names""",
        f"CASE WHEN user_id % 7 != 0 THEN {_IMAGE} END AS image",
        f"CASE WHEN user_id % 17 != 0 THEN {_STATUS} END AS status",
        "CASE WHEN user_id % 19 != 0 THEN 1700000000 + user_id END AS created",
        f"CASE WHEN user_id % 11 != 0 THEN {_LABELS} END AS labels",
        f"CASE WHEN user_id % 4 != 0 THEN {_PORTS} END AS ports",
    )


def stats_samples(events: DataFrame) -> DataFrame:
    """Resource samples with current and previous counters, some of them missing."""
    networks = (
        f"map('eth0', struct(event_id % 1000 * 10 AS rx_bytes, {_CENTS} AS tx_bytes), "
        "'eth1', struct(user_id AS rx_bytes, 7L AS tx_bytes))"
    )
    return events.selectExpr(
        "event_id AS id",
        f"{to_millis('timestamp(ts)')} AS timestamp",
        f"{_CONTAINER_ID} AS container_id",
        f"concat('/', {_CONTAINER_NAME}) AS name",
        f"event_id * 1000 + {_CENTS} AS cpu_total",
        "event_id * 1000 AS precpu_total",
        "CASE WHEN event_id % 13 != 0 THEN event_id * 1000 + 50000 END AS system_cpu",
        "event_id * 1000 AS presystem_cpu",
        f"CASE WHEN event_id % 7 != 0 THEN {CPUS}L END AS online_cpus",
        "CASE WHEN event_id % 17 != 0 THEN event_id % 1000 * 1048576 END AS memory_usage",
        "CASE WHEN event_id % 19 != 0 THEN 2147483648L END AS memory_limit",
        f"CASE WHEN event_id % 23 != 0 THEN {networks} END AS networks",
        "event_id * 3 AS block_read",
        "event_id * 5 AS block_write",
    )


def counters(events: DataFrame) -> DataFrame:
    """Raw cumulative CPU counters: per container, the sum of cents so far."""
    base = events.selectExpr(
        "event_id AS id",
        f"{to_millis('timestamp(ts)')} AS timestamp",
        f"{_CONTAINER_ID} AS container_id",
        f"{_CENTS} AS cents",
        "event_id * 1000 AS system_cpu",
        f"{CPUS}L AS online_cpus",
    )
    return running_sum(base, "container_id", "cents", "cpu_total").drop("cents")


def compose_files(events: DataFrame) -> DataFrame:
    """Compose files: one project folder per user, one service per kind of event it has.

    Every fifth user also has a second file name, every seventh a nested project, and every
    ninth a project below an excluded folder.
    """
    root = f"concat('/srv/', coalesce({_STACK}, 'misc'), '/app-', user_id)"
    services = r"concat('  ', k, ':\n    image: img-', k, ':latest')"
    return (
        events.select("user_id", "event_type")
        .distinct()
        .groupBy("user_id")
        .agg(F.expr("array_sort(collect_list(event_type)) AS kinds"))
        .selectExpr(
            f"""explode(array_compact(array(
                concat({root}, '/docker-compose.yml'),
                CASE WHEN user_id % 5 = 0 THEN concat({root}, '/docker-compose.yaml') END,
                CASE WHEN user_id % 7 = 0 THEN concat({root}, '/sub/docker-compose.yml') END,
                CASE WHEN user_id % 9 = 0
                     THEN concat({root}, '-web/node_modules/dep/docker-compose.yml') END
            ))) AS path""",
            r"concat('version: \"3\"\nservices:\n', "
            + f"array_join(transform(kinds, k -> {services}), '\\n'), "
            + r"'\nvolumes:\n  data:\n') AS content",
        )
    )
