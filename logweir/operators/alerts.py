"""Alert rules, the events they raise and their counters.

Rules are configuration held by the driver. A short list compiles into column expressions: each line is
tested where it lies, without a join. A long one becomes an index: every rule is filed under the run of
three characters of its text that fewest rules have, lines look up the runs they hold in a hash join, and
only the rules found there are tested. Both give the same events.
"""

import datetime as dt
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.session import broadcast_if_small

PATTERN = "Pattern"
THRESHOLD = "Threshold"
CONTAINER_RESTART = "ContainerRestart"

# The largest number of recent events kept.
RECENT = 100

# From so many rules on, looking up a line's runs costs less than testing every rule.
INDEXED_RULES = 64
RUN = 3  # characters; a shorter text is filed as a whole


@dataclass(frozen=True)
class AlertRule:
    """A rule. The order of a rule list decides which of several matching rules fires."""

    id: str
    name: str
    alert_type: str
    pattern: str | None = None
    threshold_value: float | None = None
    container_id: str | None = None
    enabled: bool = True
    triggered_count: int = 0
    last_triggered: dt.datetime | None = None
    created_at: dt.datetime | None = None


# The rules a new installation starts with.
DEFAULT_RULES = [
    AlertRule("error-detection", "Error Detection", PATTERN, "ERROR"),
    AlertRule("exception-detection", "Exception Detection", PATTERN, "exception"),
    AlertRule("container-restart", "Container Restart", CONTAINER_RESTART, "restarting"),
]


def add_rule(rules: list[AlertRule], rule: AlertRule) -> list[AlertRule]:
    """The rules with ``rule`` added, in place of one with the same id if there is one."""
    if any(r.id == rule.id for r in rules):
        return [rule if r.id == rule.id else r for r in rules]
    return [*rules, rule]


def remove_rule(rules: list[AlertRule], rule_id: str) -> list[AlertRule]:
    return [r for r in rules if r.id != rule_id]


def enabled_rules(rules: list[AlertRule]) -> list[AlertRule]:
    return [r for r in rules if r.enabled]


def _text_rules(rules: list[AlertRule], alert_type: str) -> list[AlertRule]:
    return [r for r in enabled_rules(rules) if r.alert_type == alert_type and r.pattern is not None]


def _as_struct(rule: AlertRule) -> Column:
    return F.struct(
        F.lit(rule.id).alias("alert_id"),
        F.lit(rule.pattern).alias("pattern"),
        F.lit(rule.container_id).alias("scope"),
    )


def _hit(message: Column, container: Column, pattern, scope, scoped: bool) -> Column:
    hit = message.contains(pattern)
    if not scoped:
        return hit
    return hit & F.coalesce(scope == container, F.lit(True))


def _all_matches(rules: list[AlertRule], scoped: bool) -> Column:
    return F.filter(
        F.array(*[_as_struct(r) for r in rules]),
        lambda r: _hit(F.col("message"), F.col("container_id"), r.pattern, r.scope, scoped),
    )


def _first_match(rules: list[AlertRule], scoped: bool) -> Column:
    tests = [
        F.when(
            _hit(
                F.col("message"),
                F.col("container_id"),
                F.lit(r.pattern),
                F.lit(r.container_id),
                scoped,
            ),
            _as_struct(r),
        )
        for r in rules
    ]
    return F.coalesce(*tests)


def _runs(text: str) -> list[str]:
    size = min(RUN, len(text))
    return sorted({text[n : n + size] for n in range(len(text) - size + 1)})


def _index(spark: SparkSession, rules: list[AlertRule]) -> DataFrame:
    """(run, ordinal, rule): every rule under its rarest run among the rules."""
    common = Counter(run for r in rules for run in _runs(r.pattern))
    rows = [
        (min(_runs(r.pattern), key=lambda run: (common[run], run)), n, (r.id, r.pattern, r.container_id))
        for n, r in enumerate(rules)
    ]
    kind = "struct<alert_id: string, pattern: string, scope: string>"
    return spark.createDataFrame(rows, f"run string, ordinal int, rule {kind}")


def _lookups(logs: DataFrame, rules: list[AlertRule], scoped: bool) -> DataFrame:
    """(line, ordinal, rule and the columns of events) for every line and rule whose text occurs in it.

    A line looks up each run it holds once, and a rule is filed once, so no pair comes twice. Runs
    that no rule is filed under go in the join, before anything is tested or moved.
    """
    message = F.col("message")
    lengths = sorted({min(RUN, len(r.pattern)) for r in rules})
    runs = []
    for size in lengths:
        if size == 0:
            runs.append("array('')")
            continue
        starts = f"CASE WHEN char_length(message) >= {size} THEN sequence(1, char_length(message) - {size - 1}) END"
        held = f"array_distinct(transform({starts}, n -> substring(message, n, {size})))"
        runs.append(f"coalesce({held}, CAST(array() AS array<string>))")
    lines = logs.select("id", "timestamp", "container_id", "message").where(message.isNotNull())
    lines = lines.withColumn("line", F.monotonically_increasing_id())
    looked = lines.withColumn("run", F.explode(F.expr(f"concat({', '.join(runs)})")))
    found = looked.join(broadcast_if_small(_index(logs.sparkSession, rules)), "run")
    hit = _hit(message, F.col("container_id"), F.col("rule.pattern"), F.col("rule.scope"), scoped)
    return found.where(hit).drop("run", "message")


def _events(matched: DataFrame) -> DataFrame:
    return matched.select(
        F.col("id").alias("log_id"),
        "rule.alert_id",
        "timestamp",
        F.format_string(
            "Pattern '%s' detected in container %s", F.col("rule.pattern"), F.col("container_id")
        ).alias("message"),
        "container_id",
    )


def _no_events(logs: DataFrame) -> DataFrame:
    return logs.limit(0).select(
        F.col("id").alias("log_id"),
        F.lit("").alias("alert_id"),
        "timestamp",
        F.lit("").alias("message"),
        "container_id",
    )


def alert_events(
    logs: DataFrame,
    rules: list[AlertRule],
    alert_type: str = PATTERN,
    scoped: bool = False,
) -> DataFrame:
    """At most one event per line: that of the first rule whose text occurs in it.

    ``scoped`` also asks that the line comes from the rule's container, where it names one.
    """
    active = _text_rules(rules, alert_type)
    if not active:
        return _no_events(logs)
    if len(active) > INDEXED_RULES:
        # Only the hits of a line meet again, to settle which rule comes first.
        first = F.min_by(F.struct("id", "timestamp", "container_id", "rule"), "ordinal").alias("first")
        found = _lookups(logs, active, scoped).groupBy("line").agg(first)
        return _events(found.select("first.*"))
    matched = logs.withColumn("rule", _first_match(active, scoped))
    return _events(matched.filter(F.col("rule").isNotNull()))


def alert_matches_all(
    logs: DataFrame, rules: list[AlertRule], alert_type: str = PATTERN
) -> DataFrame:
    """One event per line and rule whose text occurs in it."""
    active = _text_rules(rules, alert_type)
    if not active:
        return _no_events(logs)
    if len(active) > INDEXED_RULES:
        return _events(_lookups(logs, active, False))
    return _events(logs.withColumn("rule", F.explode(_all_matches(active, False))))


def restart_alerts(logs: DataFrame, rules: list[AlertRule]) -> DataFrame:
    """Events of container-restart rules, which pattern alerting leaves out."""
    return alert_events(logs, rules, CONTAINER_RESTART)


def threshold_alerts(metrics: DataFrame, rules: list[AlertRule]) -> DataFrame:
    """One row per sample and threshold rule whose CPU value it exceeds."""
    active = [
        r
        for r in enabled_rules(rules)
        if r.alert_type == THRESHOLD and r.threshold_value is not None
    ]
    limits = F.array(
        *[
            F.struct(
                F.lit(r.id).alias("alert_id"),
                F.lit(float(r.threshold_value)).alias("threshold"),
                F.lit(r.container_id).alias("scope"),
            )
            for r in active
        ]
    )
    exceeded = F.filter(
        limits,
        lambda r: (F.col("cpu_percent") > r.threshold)
        & F.coalesce(r.scope == F.col("container_id"), F.lit(True)),
    )
    if not active:
        return metrics.limit(0).select(
            F.col("id").alias("metric_id"), F.lit("").alias("alert_id"), "timestamp",
            "container_id", "cpu_percent",
        )
    return metrics.withColumn("rule", F.explode(exceeded)).select(
        F.col("id").alias("metric_id"), "rule.alert_id", "timestamp", "container_id", "cpu_percent"
    )


_RULES = T.StructType(
    [
        T.StructField("alert_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("alert_type", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("before", T.LongType()),
        T.StructField("last_before", T.TimestampType()),
    ]
)


def rules_table(spark: SparkSession, rules: list[AlertRule]) -> DataFrame:
    rows = [
        (r.id, r.name, r.alert_type, r.enabled, r.triggered_count, r.last_triggered) for r in rules
    ]
    return spark.createDataFrame(rows, _RULES)


def alert_stats(events: DataFrame, rules: list[AlertRule]) -> DataFrame:
    """Every rule with how often and when it last fired, counting on from its own figures.

    Events shrink to one row per rule before they meet the rules.
    """
    fired = events.groupBy("alert_id").agg(
        F.count("*").alias("fired"), F.max("timestamp").alias("last_fired")
    )
    last_before = F.col("last_before").cast(events.schema["timestamp"].dataType)
    return (
        rules_table(events.sparkSession, rules)
        .join(fired, "alert_id", "left")
        .select(
            "alert_id",
            "name",
            "alert_type",
            "enabled",
            (F.col("before") + F.coalesce("fired", F.lit(0))).alias("triggered_count"),
            F.greatest(last_before, F.col("last_fired")).alias("last_triggered"),
        )
    )


def recent_events(events: DataFrame, count: int = RECENT) -> DataFrame:
    """The newest ``count`` events."""
    newest = [F.desc("timestamp"), F.desc("log_id")]
    return events.orderBy(*newest).limit(count)
