"""Expression builders on literal rows."""

import datetime as dt
import re

import pytest

from logweir.functions import clock, compose, levels, patterns, resources, text
from logweir.sources import tables


def test_normalize_level(values):
    spelled = ["DEBUG", "debug", "INFO", "Warn", "WARNING", "error", "ERR", "FATAL", "critical",
               "UNKNOWN", "anything", ""]
    assert values(levels.normalize_level, spelled) == [
        "DEBUG", "DEBUG", "INFO", "WARN", "WARN", "ERROR", "ERROR", "FATAL", "FATAL",
        "UNKNOWN", "UNKNOWN", "UNKNOWN",
    ]


def test_normalize_source(values):
    assert values(levels.normalize_source, ["STDERR", "stdErr", "STDOUT", "other", ""]) == [
        "STDERR", "STDERR", "STDOUT", "STDOUT", "STDOUT",
    ]


# message: by substring, by word
LEVEL_CASES = {
    "ERROR: lease renewal refused": ("ERROR", "ERROR"),
    "WARNING: disk quota nearly reached": ("WARN", "WARN"),
    "DEBUG: cache warmed in 41 ms": ("DEBUG", "DEBUG"),
    "Scheduler ready, 12 queues": ("INFO", "INFO"),
    "Exception in thread worker-7": ("INFO", "ERROR"),
    "Traceback (most recent call last)": ("DEBUG", "ERROR"),
    "retry succeeded, terror averted": ("ERROR", "INFO"),
    "stderr: verbose output": ("INFO", "DEBUG"),
    "errors": ("ERROR", "INFO"),
    "err": ("INFO", "ERROR"),
    "prewarned": ("WARN", "INFO"),
    "fatal and warn": ("ERROR", "ERROR"),
    "stack   trace follows": ("DEBUG", "DEBUG"),
    "stacktrace": ("DEBUG", "ERROR"),
    "äerror": ("ERROR", "INFO"),  # a non-ASCII letter is part of the word
    " error\t": ("ERROR", "ERROR"),
    "": ("INFO", "INFO"),
}


def test_both_level_readings(values):
    messages = list(LEVEL_CASES)
    assert values(levels.ingest_level, messages) == [c[0] for c in LEVEL_CASES.values()]
    assert values(levels.extract_level, messages) == [c[1] for c in LEVEL_CASES.values()]


def test_ingest_source(values):
    assert values(levels.ingest_source, ["stderr: x", "STDERR: x", " stderr"]) == [
        "STDERR", "STDOUT", "STDOUT",
    ]


def test_trim_is_unicode(values):
    assert values(text.trim_unicode, ["\t a  b  ", "\n", "x", "a \n b"]) == [
        "a  b", "", "x", "a \n b",
    ]


def test_trim_of_long_inner_runs_is_fast(values):
    wide = "a" + " " * 200_000 + "b"
    assert values(text.trim_unicode, [wide + " "]) == [wide]


def test_tags_and_types(values):
    cases = {
        "ERROR: upstream pool exhausted": (["error"], []),
        "Exception in thread worker-7\n\tat org.sample.Worker.run(Worker.java:42)": (
            ["error", "stack_trace"], ["StackTrace"],
        ),
        "HTTP/1.1 503 backend draining": (["error", "http_error"], ["HttpError"]),
        "HTTP/2 404": (["http_error"], ["HttpError"]),
        "HTTP/1.1 302 Found": ([], []),
        "http/1.1 500": ([], []),
        "SQL Error: duplicate key on orders": (["error", "sql_error"], ["SqlError"]),
        "JSON.parse: unexpected token": (["json_error"], ["JsonError"]),
        "invalid  json": (["json_error"], ["JsonError"]),
        "    at org.sample.Worker.run(Worker.java:42)": ([], ["StackTrace"]),
        "    at org.sample.Worker.run(Worker.java:42)\n": ([], []),
        "at org.sample.Worker.run(Worker.java:42)": ([], []),
        "warn: timeout": (["warning", "sql_error"], ["SqlError"]),
        "ſql error": (["error", "sql_error"], ["SqlError"]),  # long s
        "stacK trace": (["stack_trace"], ["StackTrace"]),  # Kelvin sign
        "plain": ([], []),
    }
    assert values(patterns.pattern_tags, cases) == [c[0] for c in cases.values()]
    assert values(patterns.pattern_types, cases) == [c[1] for c in cases.values()]


@pytest.mark.parametrize("name", list(patterns.REGEXES))
def test_gate_never_hides_a_match(spark, name):
    """The cheap test in front of a regex lets every match through."""
    words = ["err", "ERROR", "fatal", "Critical", "exception", "warn", "warning", "debug", "TRACE",
             "verbose", "traceback", "stack", "HTTP/1.1 503", "sql", "database", "deadlock",
             "timeout", "json.parse", "invalid json", "unexpected", "token", "\tat a.b(c)",
             "ſtacKtrace", "dataſe"]
    joined = [a + sep + b for a in words for b in words for sep in ("", " ", "\n")]
    rows = spark.createDataFrame([(t,) for t in joined + words], "x string")
    hidden = rows.filter(f"x RLIKE r'{patterns.REGEXES[name]}'").filter(
        f"NOT {patterns.matches('x', name)}"
    )
    assert hidden.count() == 0


def test_tag_types(values):
    assert values(patterns.tag_type, ["stack_trace", "http_error", "error", "mine"]) == [
        "StackTrace", "HttpError", "Custom(error)", "Custom(mine)",
    ]


def test_format_count(spark):
    cases = {0: "0", 999: "999", 1000: "1.0K", 1150: "1.1K", 1250: "1.3K", 1750: "1.8K",
             3400: "3.4K", 999_949: "999.9K", 999_999: "1000.0K", 1_000_000: "1.0M",
             1_250_000: "1.3M", 1_234_567: "1.2M", 2_500_000_000: "2500.0M"}
    rows = spark.createDataFrame([(n,) for n in cases], "n long").selectExpr(
        "n", f"{text.format_count('n')} AS shown"
    )
    assert {r["n"]: r["shown"] for r in rows.collect()} == cases


def test_milliseconds_survive(spark):
    row = spark.sql(
        f"SELECT unix_millis({clock.to_millis('timestamp_micros(1767225600123456)')}) AS ms, "
        f"{clock.rfc3339('timestamp_millis(1767225600123)')} AS fraction, "
        f"{clock.rfc3339('timestamp_millis(1767225600000)')} AS whole"
    ).first()
    assert row["ms"] == 1767225600123
    assert row["fraction"] == "2026-01-01T00:00:00.123Z"
    assert row["whole"] == "2026-01-01T00:00:00Z"


def test_line_prefix(values):
    lines = [
        "2024-01-01T00:00:07.179575123Z ERROR: x",
        "2024-01-01T02:00:07+02:00 text with spaces",
        "2024-01-01T00:00:07Z ",
        "2024-01-01T00:00:07Z",
        "2024 was a year",
        "plain",
    ]
    times = values(clock.line_time, lines)
    assert times[0] == dt.datetime(2024, 1, 1, 0, 0, 7, 179575)
    assert times[1] == times[2] == dt.datetime(2024, 1, 1, 0, 0, 7)
    assert times[3:] == [None] * 3
    assert values(clock.line_text, lines) == [
        "ERROR: x", "text with spaces", "", "2024-01-01T00:00:07Z", "2024 was a year", "plain",
    ]


def test_cpu_percent(spark):
    cases = [
        ((300, 100, 2000, 1000, 4), 80.0),
        ((300, 100, 1000, 1000, 4), 0.0),
        ((300, 100, None, 1000, 4), 0.0),
        ((300, 100, 1000, None, None), 20.0),
        ((100, 300, 2000, 1000, 1), -20.0),
    ]
    rows = spark.createDataFrame(
        [c[0] for c in cases], "a long, b long, c long, d long, e long"
    ).selectExpr(resources.cpu_percent("a", "b", "c", "d", "e"))
    assert [r[0] for r in rows.collect()] == pytest.approx([c[1] for c in cases])


def test_memory_percent(spark):
    rows = spark.createDataFrame(
        [(1_000_000, 2_000_000), (None, 10), (5, None), (5, 0)], "u long, l long"
    ).selectExpr(resources.memory_percent("u", "l"))
    assert [r[0] for r in rows.collect()] == [50.0, 0.0, 500.0, None]


COMPOSE = """version: "3"
services:
  web:
    image: nginx
    ports:
      - "80:80"
  # a comment: here
  api:  # main
    build: .
  web:
    image: twice

networks:
  front:
"""


def test_services(values):
    assert values(compose.services, [COMPOSE, COMPOSE.replace("\n", "\r\n"), "", "services:"]) == [
        ["web", "api"], ["web", "api"], [], [],
    ]


def test_services_loose(values):
    wanted = []
    for line in COMPOSE.split("\n"):
        name = line.strip().rstrip(":")
        if re.match("  .*:", line) and name not in wanted:
            wanted.append(name)
    assert values(compose.services_loose, [COMPOSE]) == [wanted]
    assert wanted[:3] == ["web", "image: nginx", "ports"]


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "Asia/Tokyo"])
def test_days_and_stamps_are_utc_in_any_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        at = "timestamp_millis(1704160800007)"  # 2024-01-02T02:00:00.007Z
        rows = spark.sql(
            f"SELECT timestamp_millis(1704160800007) AS timestamp, {clock.day_key(at)} AS day, {clock.rfc3339(at)} AS text"
        )
        got = rows.first()
        assert (str(got.day), got.text) == ("2024-01-02", "2024-01-02T02:00:00.007Z")
        until = dt.datetime(2024, 1, 2, 3, tzinfo=dt.timezone.utc)
        assert tables.in_range(rows, since=until - dt.timedelta(hours=2), until=until).count() == 1
        assert tables.in_range(rows, since=until).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
