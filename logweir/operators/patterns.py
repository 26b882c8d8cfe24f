"""Counts of error patterns and the filters they suggest."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.functions import patterns
from logweir.operators.sequence import carry_forward


def pattern_counts(logs: DataFrame) -> DataFrame:
    """Lines per pattern tag, in the order tags first occurred, with first and last time.

    All tags are counted in one pass to one row, which is then turned into rows; lines are
    neither multiplied nor shuffled.
    """
    hits = [f"{patterns.matches('message', p)} AS {tag}" for tag, p in patterns.TAGS.items()]
    totals, entries = [], []
    for ordinal, tag in enumerate(patterns.TAGS):
        totals += [
            f"count_if({tag}) AS {tag}_count",
            f"min(CASE WHEN {tag} THEN struct(timestamp, id) END) AS {tag}_first",
            f"max(CASE WHEN {tag} THEN timestamp END) AS {tag}_last",
        ]
        entries.append(
            f"named_struct('first', {tag}_first, 'ordinal', {ordinal}, 'pattern', '{tag}', "
            f"'count', {tag}_count, 'last', {tag}_last)"
        )
    return (
        logs.selectExpr("timestamp", "id", *hits)
        .agg(*map(F.expr, totals))
        .selectExpr(f"array_sort(filter(array({', '.join(entries)}), e -> e.count > 0)) AS seen")
        .selectExpr("size(seen) AS detected_count", "explode(seen) AS e")
        .selectExpr(
            "e.pattern",
            f"{patterns.tag_type('e.pattern')} AS pattern_type",
            "e.count",
            "e.first.timestamp AS first_seen",
            "e.last AS last_seen",
            "detected_count",
        )
    )


def auto_filters(logs: DataFrame) -> DataFrame:
    """Suggested filters with their counts, largest first, ties in build order."""
    conditions = patterns.filter_conditions("message")
    entries = [
        f"named_struct('rank', -{key}, 'ordinal', {n}, 'name', '{kind.name}', "
        f"'query', '{kind.query}', 'count', {key}, 'filter_type', '{kind.filter_type}')"
        for n, (key, kind) in enumerate(patterns.FILTER_KINDS.items())
    ]
    return (
        logs.agg(*[F.expr(f"count_if({test}) AS {key}") for key, test in conditions.items()])
        .selectExpr(
            f"explode(array_sort(filter(array({', '.join(entries)}), e -> e.count > 0))) AS e"
        )
        .selectExpr("e.name", "e.query", "e.count", "e.filter_type")
    )


def _traced(logs: DataFrame) -> DataFrame:
    """Lines of traces with ``_trace``: time, id and a number of their trace's first line."""
    frame, start = patterns.matches("message", "stack_frame"), patterns.matches("message", "stack_start")
    # Every line but a frame ends the trace before it. The number tells heads of one time and id apart.
    head = f"struct({start} AS opens, timestamp AS trace_time, id AS trace_id, _number)"
    numbered = logs.withColumn("_number", F.monotonically_increasing_id())
    heads = numbered.withColumn("_head", F.expr(f"CASE WHEN NOT {frame} THEN {head} END"))
    return carry_forward(heads, "container_id", "_head", "_trace").filter("_trace.opens")


def trace_lines(logs: DataFrame) -> DataFrame:
    """The lines of multi-line stack traces, each with time and id of its trace's first line.

    A trace is a line that announces one, and the frame lines that directly follow it in its
    container. Traces may be of any length, so their lines stay rows.
    """
    return _traced(logs).select(*logs.columns, "_trace.trace_time", "_trace.trace_id")


def stack_traces(logs: DataFrame) -> DataFrame:
    """One row per stack trace: where and when it ran, and over how many lines.

    Traces that start at the same time stay apart, whatever their ids.
    """
    return (
        _traced(logs)
        .select("container_id", "timestamp", "_trace.trace_id", "_trace._number")
        .groupBy("container_id", "trace_id", "_number")
        .agg(
            F.expr("count(*) AS lines"),
            F.expr("min(timestamp) AS first_time"),
            F.expr("max(timestamp) AS last_time"),
        )
        .drop("_number")
    )
