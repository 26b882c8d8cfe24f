"""From landed lines and samples to the rows of the stored tables."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir import schemas
from logweir.functions import json_lines, levels
from logweir.functions.clock import is_timed, line_text, line_time, to_millis
from logweir.operators.logs import enrich


def parse_lines(lines: DataFrame) -> DataFrame:
    """The parts of landed lines (id, container_id, line).

    ``format`` says whether a line is one JSON object (``json``), only starts like one
    (``broken``) or is anything else (``plain``). The first gives its message, level, source and time
    where it names them; ``fields`` keeps the object whole, so no other field is lost. A broken
    or plain line is its own message, and ``bad_record`` keeps a broken one. The time prefix of a
    line counts before the time it names; ``event_time`` is null if it has neither.
    """
    texts = lines.selectExpr("id", "container_id", "line", f"{is_timed('line')} AS timed").selectExpr(
        "id",
        "container_id",
        "line",
        f"{line_time('line', 'timed')} AS prefix_time",
        f"{line_text('line', 'timed')} AS text",
    )
    known = texts.selectExpr("*", f"{json_lines.fields('text')} AS found")
    known = known.selectExpr("*", f"{json_lines.line_format('text', 'found')} AS format")
    known = known.selectExpr("*", f"CASE WHEN format = '{json_lines.JSON}' THEN found END AS parsed")
    known = known.selectExpr("*", f"coalesce({json_lines.message('parsed')}, text) AS message")
    return known.selectExpr(
        "id",
        "container_id",
        "line",
        "format",
        f"coalesce(prefix_time, {json_lines.time('parsed')}) AS event_time",
        "message",
        f"coalesce({json_lines.level('parsed')}, {levels.ingest_level('message')}) AS level",
        f"coalesce({json_lines.source('parsed')}, {levels.ingest_source('message')}) AS source",
        f"CASE WHEN format = '{json_lines.JSON}' THEN text ELSE '' END AS fields",
        f"CASE WHEN format = '{json_lines.BROKEN}' THEN text END AS bad_record",
    )


def ingest_rows(lines: DataFrame, containers: DataFrame) -> DataFrame:
    """Log rows from (id, container_id, line); a line that is a JSON object is read as one.

    The line's own time is its event time; a line without one is stamped with the time of the batch
    that reads it. A line without an id gets one from its container and content, the same whenever
    it is read. The metadata of a JSON line is the object. Every step but the lookup of
    container attributes is a projection.
    """
    rows = parse_lines(lines).selectExpr(
        "coalesce(id, xxhash64(container_id, line)) AS id",
        f"{to_millis('coalesce(event_time, current_timestamp())')} AS timestamp",
        "container_id",
        "message",
        "level",
        "source",
        "fields AS metadata",
    )
    return enrich(rows, containers).select(*schemas.LOGS.fieldNames())


def unique_lines(history: DataFrame, live: DataFrame) -> DataFrame:
    """Landed lines of both, each (container, line) with a time of its own once, by its smallest id.

    The line is compared whole, with all digits of its time, before anything is cut to
    milliseconds; lines without a time cannot be told from new ones and all stay. Every input task drops
    its own copies before the shuffle.
    """
    both = history.unionByName(live)
    timed = F.expr(is_timed("line"))
    copies = Window.partitionBy("container_id", "line").orderBy("id")
    once = both.where(timed).withColumn("_copy", F.row_number().over(copies)).where("_copy = 1")
    return once.drop("_copy").unionByName(both.where(~timed))
