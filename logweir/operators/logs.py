"""Log rows: encoding, filters, pages, statistics, enrichment, tails and de-duplication."""

import base64
import datetime as dt
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir import schemas
from logweir.functions import levels
from logweir.functions.clock import to_millis
from logweir.functions.container import COMPOSE_FILE, is_collected, stack_of
from logweir.operators.attributes import Attributes, container_attributes
from logweir.session import broadcast_if_small
from logweir.sources.tables import in_range, newest_days

# Page limits, the rows that sampled statistics read, lines per tail.
DEFAULT_LIMIT = 100
MAX_REQUESTED_LIMIT = 10_000
STATS_SAMPLE = 10_000
TAIL_LINES = 50

# Levels a query may ask for.
QUERY_LEVELS = ["debug", "info", "warn", "error", "fatal"]

# Levels that statistics count one by one.
COUNTED_LEVELS = ["ERROR", "WARN", "INFO", "DEBUG"]

# Rows of one tail key are first cut within this many groups of input partitions.
TAIL_SPREAD = 64


# What decides among rows of equal time, in this order.
_TIES = ["id", "container_id", "message"]


def newest_first() -> list[Column]:
    """A total order, but for rows that are equal in all these columns."""
    return [F.desc("timestamp"), *[F.desc(name) for name in _TIES]]


# What decides among rows of equal time if rows that differ anywhere must not tie.
_ALL_TIES = [*_TIES, *[f for f in schemas.LOGS.fieldNames() if f not in ("timestamp", *_TIES)]]

_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


@dataclass(frozen=True)
class PageKey:
    """The last row of a page, all its columns, and how many rows equal to it were already shown.

    Rows that are equal in all columns cannot be told apart, but they can be counted; so pages by
    this key show every row of a table once, with or without ids.
    """

    micros: int  # since 1970
    ties: tuple
    seen: int

    def text(self) -> str:
        raw = json.dumps([self.micros, list(self.ties), self.seen])
        return "key:" + base64.urlsafe_b64encode(raw.encode()).decode()

    @classmethod
    def of_text(cls, text: str) -> "PageKey":
        micros, ties, seen = json.loads(base64.urlsafe_b64decode(text.removeprefix("key:")))
        return cls(micros, tuple(ties), seen)


def next_key(page: DataFrame, before: PageKey | None = None) -> PageKey | None:
    """The key to page on from ``page``, which was asked for with ``before``; None if it is empty."""
    ties = F.struct(F.unix_micros("timestamp").alias("micros"), *_ALL_TIES)
    last = page.groupBy(ties.alias("row")).count().agg(F.min(F.struct("row", "count")).alias("last")).first().last
    if last is None:
        return None
    micros, *values = last.row
    key = PageKey(micros, tuple(values), last["count"])
    if before and (key.micros, key.ties) == (before.micros, before.ties):
        return PageKey(key.micros, key.ties, key.seen + before.seen)
    return key


# Rows as stored and as read -------------------------------------------------------------


def encode_logs(logs: DataFrame) -> DataFrame:
    """Rows ready to store: whole milliseconds, id 0 and metadata '' where missing."""
    return logs.selectExpr(
        "coalesce(id, 0L) AS id",
        f"{to_millis('timestamp')} AS timestamp",
        "container_id",
        "container_name",
        "compose_project",
        "compose_file",
        "message",
        "level",
        "source",
        "coalesce(metadata, '') AS metadata",
    )


def decode_logs(rows: DataFrame) -> DataFrame:
    """Stored rows as entries: known level and source names, '' metadata as null."""
    return rows.selectExpr(
        "id",
        "timestamp",
        "container_id",
        "container_name",
        "compose_project",
        "compose_file",
        "message",
        f"{levels.normalize_level('level')} AS level",
        f"{levels.normalize_source('source')} AS source",
        "nullif(metadata, '') AS metadata",
    )


# Filters --------------------------------------------------------------------------------


def validate_query(limit=None, container_id=None, level=None) -> None:
    if limit is not None and limit > MAX_REQUESTED_LIMIT:
        raise ValueError(f"limit must not exceed {MAX_REQUESTED_LIMIT}")
    if container_id is not None and not all(c.isalnum() or c in "-_" for c in container_id):
        raise ValueError("container_id may hold letters, digits, '-' and '_' only")
    if level is not None and level.lower() not in QUERY_LEVELS:
        raise ValueError(f"level must be one of {', '.join(QUERY_LEVELS)}")


def filter_logs(
    logs: DataFrame,
    *,
    container_id: str | None = None,
    containers: str | None = None,
    stack: str | None = None,
    level: str | None = None,
    search: str | None = None,
    since=None,
    until=None,
    levels_in: list[str] | None = None,
    source: str | None = None,
    regex: str | None = None,
    exclude: str | None = None,
) -> DataFrame:
    """Rows that pass every given filter.

    ``level`` is compared in upper case and ``all`` means any; ``levels_in`` takes several.
    ``search`` is a literal, case-sensitive substring and ``exclude`` one that must not
    occur; ``regex`` is a Java pattern found anywhere in the message. ``containers`` is a
    comma-separated id list, taken verbatim.
    """
    if container_id is not None:
        logs = logs.filter(F.col("container_id") == container_id)
    if level is not None and level.lower() != "all":
        logs = logs.filter(F.col("level") == level.upper())
    if search is not None:
        logs = logs.filter(F.col("message").contains(search))
    if stack is not None:
        logs = logs.filter(F.col("compose_project") == stack)
    if containers is not None:
        logs = logs.filter(F.col("container_id").isin(containers.split(",")))
    if levels_in is not None:
        logs = logs.filter(F.col("level").isin([v.upper() for v in levels_in]))
    if source is not None:
        logs = logs.filter(F.col("source") == source.upper())
    if regex is not None:
        logs = logs.filter(F.col("message").rlike(regex))
    if exclude is not None:
        logs = logs.filter(~F.col("message").contains(exclude))
    return in_range(logs, since, until)


def logs_of_stack(logs: DataFrame, containers: DataFrame, stack: str) -> DataFrame:
    """Logs of the containers that carry the stack's label."""
    ids = containers.filter(F.expr(stack_of("labels")) == stack).selectExpr("id AS container_id")
    return logs.join(broadcast_if_small(ids), "container_id", "left_semi")


def running_logs(logs: DataFrame, containers: DataFrame) -> DataFrame:
    """Logs of the containers that collection would read now."""
    ids = containers.filter(is_collected("status")).selectExpr("id AS container_id")
    return logs.join(broadcast_if_small(ids), "container_id", "left_semi")


def live_filter(logs: DataFrame, containers: list[str] | None = None, stack: str | None = None):
    """The rows a live view shows; no selected container and no stack means all."""
    if containers:
        logs = logs.filter(F.col("container_id").isin(containers))
    if stack:
        logs = logs.filter(F.col("compose_project") == stack)
    return logs


# Pages ----------------------------------------------------------------------------------


def log_page(
    logs: DataFrame,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
    before: "tuple | PageKey | None" = None,
    **filters,
) -> DataFrame:
    """The newest rows that pass the filters, after skipping ``offset`` of them.

    Every filter is applied before the limit, and a limit is honoured or refused. Skipped rows
    still travel to the driver's merge, so deep paging should pass ``before``, the
    :func:`page_key` of the last row seen: that is a filter, and on a stored table it skips the
    later days. ``(timestamp, id)`` alone is enough where no two rows share both. A
    :class:`PageKey` shows every row once even where rows are equal in all columns.
    """
    _validate_page(limit, filters)
    page = filter_logs(_older(logs, before), **filters).orderBy(*_page_order(before))
    offset += _already_seen(before)
    if offset:
        page = page.offset(offset)
    return page.limit(limit)


def _validate_page(limit: int, filters: dict) -> None:
    """As :func:`validate_query`; the filters' ``all`` stands for no level here."""
    level = filters.get("level")
    asked = None if level is None or level.lower() == "all" else level
    validate_query(limit, filters.get("container_id"), asked)


def page_key(row) -> tuple:
    """What orders a row among all others, to page on from it."""
    return row["timestamp"], row["id"], row["container_id"], row["message"]


def _page_order(before) -> list[Column]:
    if isinstance(before, PageKey):
        return [F.desc("timestamp"), *[F.desc(name) for name in _ALL_TIES]]
    return newest_first()


def _already_seen(before) -> int:
    return before.seen if isinstance(before, PageKey) else 0


FIRST_PAGE = PageKey(1 << 62, (None,) * len(_ALL_TIES), 0)


def _older(logs: DataFrame, before: "tuple | PageKey | None") -> DataFrame:
    """Rows that follow ``before`` in the order of pages; a null value follows all others.

    Of a :class:`PageKey` also the rows that equal it.
    """
    if before is None or before == FIRST_PAGE:
        return logs
    if isinstance(before, PageKey):
        at, ties, names, older = _EPOCH + dt.timedelta(microseconds=before.micros), before.ties, _ALL_TIES, F.lit(True)
    else:
        (at, *ties), names, older = before, _TIES, F.lit(False)
    for name, value in reversed(list(zip(names, ties))):
        lower = F.col(name).isNull() if value is not None else F.lit(False)
        if value is not None:
            lower = lower | (F.col(name) < F.lit(value))
        older = lower | (F.col(name).eqNullSafe(F.lit(value)) & older)
    return in_range(logs, until=F.lit(at) + F.expr("INTERVAL 1 MILLISECOND")).filter(
        (F.col("timestamp") < F.lit(at)) | ((F.col("timestamp") == F.lit(at)) & older)
    )


def log_page_by_day(
    logs: DataFrame,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
    before: "tuple | PageKey | None" = None,
    **filters,
) -> DataFrame:
    """The rows of :func:`log_page`, for a table stored by day.

    Only the days that hold the page are sorted and read in full, and days that ``offset``
    skips as a whole are never read.
    """
    _validate_page(limit, filters)
    skip = offset + _already_seen(before)
    days, left = newest_days(filter_logs(_older(logs, before), **filters), skip, limit)
    page = days.orderBy(*_page_order(before))
    return (page.offset(left) if left else page).limit(limit)


def page_info_by_key(
    logs: DataFrame, limit: int = DEFAULT_LIMIT, before: PageKey | None = None, **filters
) -> DataFrame:
    """As :func:`page_info`, for the page after ``before``; the cursor is the text of a :class:`PageKey`.

    One job finds the page's last row and one counts; no page is deep.
    """
    before = before or FIRST_PAGE
    key = next_key(log_page(logs, limit, before=before, **filters), before)
    passing = filter_logs(logs, **filters)
    left = _older(passing, before).agg((F.count("*") - F.lit(before.seen)).alias("left")).first().left
    more = left > limit
    return passing.agg(F.count("*").alias("total")).select(
        "total",
        F.lit(more).alias("has_more"),
        F.lit(key.text() if more else None).cast("string").alias("next_cursor"),
    )


def page_info(
    logs: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0, **filters
) -> DataFrame:
    """One row about a page: rows that pass in all, whether more follow, and where."""
    end = F.lit(offset) + F.lit(limit)
    more = F.col("total") > end
    return (
        filter_logs(logs, **filters)
        .agg(F.count("*").alias("total"))
        .select(
            "total",
            more.alias("has_more"),
            F.when(more, F.concat(F.lit("offset:"), end.cast("string"))).alias("next_cursor"),
        )
    )


def log_page_postfilter(
    logs: DataFrame,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
    stack: str | None = None,
    containers: str | None = None,
    **filters,
) -> DataFrame:
    """A page that is cut first and filtered by stack and container list afterwards.

    It may hold fewer rows than exist; kept for clients that rely on that.
    """
    page = log_page(logs, limit, offset, **filters)
    return filter_logs(page, stack=stack, containers=containers)


def page_info_postfilter(page: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0):
    """One row about a page of :func:`log_page_postfilter`: ``total`` is what is left of it."""
    full = F.col("total") >= limit
    return page.agg(F.count("*").alias("total")).select(
        "total",
        full.alias("has_more"),
        F.when(full, F.lit(f"offset:{offset + limit}")).alias("next_cursor"),
    )


# Statistics -----------------------------------------------------------------------------


def log_total(logs: DataFrame, **filters) -> DataFrame:
    return filter_logs(logs, **filters).agg(F.count("*").alias("total"))


def _stats_input(logs, container_id, stack, sample_limit) -> DataFrame:
    logs = filter_logs(logs, container_id=container_id)
    if sample_limit is not None:
        logs = logs.orderBy(*newest_first()).limit(sample_limit)
    return filter_logs(logs, stack=stack)


def log_stats(
    logs: DataFrame,
    container_id: str | None = None,
    stack: str | None = None,
    sample_limit: int | None = None,
) -> DataFrame:
    """Rows in all and per counted level, in one pass.

    With ``sample_limit`` only the newest rows of the container filter are looked at.
    """
    rows = _stats_input(logs, container_id, stack, sample_limit)
    return rows.agg(
        F.expr("count(*) AS total"),
        *[F.expr(f"count_if(level = '{v}') AS {v.lower()}_count") for v in COUNTED_LEVELS],
    )


def log_stats_by_container(
    logs: DataFrame,
    container_id: str | None = None,
    stack: str | None = None,
    sample_limit: int | None = None,
) -> DataFrame:
    """Rows per container, with the name its newest row carries.

    Counting per (container, name) first keeps the pass over the rows on fixed-width hash
    aggregation; the newest name is then picked among one row per name.
    """
    rows = _stats_input(logs, container_id, stack, sample_limit)
    per_name = rows.groupBy("container_id", "container_name").agg(
        F.expr("count(*) AS rows"), F.expr("max(timestamp) AS newest")
    )
    return per_name.groupBy("container_id").agg(
        F.expr("max_by(container_name, struct(newest, container_name)) AS container_name"),
        F.expr("sum(rows) AS count"),
    )


def stats_of_counts(counts: DataFrame, container_id: str | None = None, stack: str | None = None) -> DataFrame:
    """:func:`log_stats` from counts per container, stack and level, as sealed days keep them."""
    rows = filter_logs(counts, container_id=container_id, stack=stack)
    per_level = [F.expr(f"coalesce(sum(rows) FILTER (WHERE level = '{v}'), 0L) AS {v.lower()}_count") for v in COUNTED_LEVELS]
    return rows.agg(F.expr("coalesce(sum(rows), 0L) AS total"), *per_level)


def stats_by_container_of_counts(counts: DataFrame) -> DataFrame:
    """:func:`log_stats_by_container` from such counts."""
    return counts.groupBy("container_id").agg(
        F.expr("max_by(container_name, struct(newest, container_name)) AS container_name"),
        F.expr("sum(rows) AS count"),
    )


def level_distribution(logs: DataFrame) -> DataFrame:
    return logs.groupBy("compose_project", "level").agg(F.count("*").alias("count"))


def stack_levels(logs: DataFrame) -> DataFrame:
    """Per stack, how many logs, errors and warnings it has."""
    return logs.groupBy("compose_project").agg(
        F.expr("count(*) AS total"),
        F.expr("count_if(level = 'ERROR') AS error_count"),
        F.expr("count_if(level = 'WARN') AS warn_count"),
    )


# Enrichment, tails, merging -------------------------------------------------------------


def enrich(lines: DataFrame, containers: DataFrame | Attributes) -> DataFrame:
    """Lines with their container's name and stack: the id and '' where unknown.

    A snapshot is reduced and measured here; attributes that were stored with it were so once.
    """
    if isinstance(containers, Attributes):
        attributes = F.broadcast(containers.rows) if containers.small else containers.rows
    else:
        attributes = broadcast_if_small(container_attributes(containers))
    return lines.join(attributes, "container_id", "left").selectExpr(
        *lines.columns,
        "coalesce(_name, container_id) AS container_name",
        "coalesce(_stack, '') AS compose_project",
        f"'{COMPOSE_FILE}' AS compose_file",
    )


def tail(logs: DataFrame, lines: int = TAIL_LINES) -> DataFrame:
    """The newest ``lines`` rows of every container.

    Each input task keeps at most that many rows per container before anything moves. The
    first window then cuts what groups of input tasks sent, so that the second one sees at
    most ``lines * TAIL_SPREAD`` rows even of a container found in every task.
    """
    def cut(df: DataFrame, *keys: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first()))
        return df.withColumn("_rank", rank).filter(F.col("_rank") <= lines).drop("_rank")

    spread = logs.withColumn("_spread", F.spark_partition_id() % TAIL_SPREAD)
    return cut(cut(spread, "container_id", "_spread").drop("_spread"), "container_id")


DUPLICATE_KEY = ["timestamp", "container_id", "message"]


def dedup(history: DataFrame, live: DataFrame) -> DataFrame:
    """History and live rows, each (time, container, message) once, by its smallest id.

    Every input task drops its own copies before the shuffle, so a line repeated without
    end arrives at most once per task.
    """
    copies = Window.partitionBy(*DUPLICATE_KEY).orderBy("id")
    return (
        history.unionByName(live)
        .withColumn("_copy", F.row_number().over(copies))
        .filter(F.col("_copy") == 1)
        .drop("_copy")
    )


# Viewer ---------------------------------------------------------------------------------

def viewer_match(level: str = "all", search: str = "") -> Column:
    """Level and search as the viewer reads them, both in any case; search also hits names."""
    matched = F.lit(True)
    if level != "all":
        matched = matched & (F.lower("level") == level.lower())
    if search:
        text = search.lower()
        matched = matched & (
            F.lower("message").contains(text) | F.lower("container_name").contains(text)
        )
    return matched


def viewer_search(
    logs: DataFrame,
    level: str = "all",
    search: str = "",
    kept: int | None = None,
    shown: int | None = None,
) -> DataFrame:
    """Rows that match, newest first; of the newest ``kept`` rows only and at most ``shown``, if given."""
    if kept is not None:
        logs = logs.orderBy(*newest_first()).limit(kept)
    found = logs.filter(viewer_match(level, search)).orderBy(*newest_first())
    return found if shown is None else found.limit(shown)
