"""Landed lines: JSON objects, whole or broken, against Python's own reader, and exact-time copies."""

import datetime as dt
import json
import random

from logweir import schemas
from logweir.operators import ingest
from tests.test_operators import SNAPSHOT

UTC = dt.timezone.utc


def parse(spark, lines):
    rows = [(n, "c1", line) for n, line in enumerate(lines)]
    got = ingest.parse_lines(spark.createDataFrame(rows, schemas.RAW_LINES))
    return [r for r in sorted(got.collect(), key=lambda r: r["id"])]


def is_object(line):
    def strict(name):
        raise ValueError(name)

    try:
        return isinstance(json.loads(line, parse_constant=strict), dict)
    except ValueError:
        return False


def test_format_agrees_with_python(spark):
    good = ['{"msg":"a"}', '{}', ' {"a":1}\t', '{"message":"x","more":[1,{"b":[]}],"n":null}', '{"a":"}{"}', '{"\\u0061":1}']
    odd = ["", " ", "{", "}", "{}}", "{{}}", '{"a":1},{"b":2}', '{"a":1}{"b":2}', '{"a":1} tail', "{'a':1}", '{a:1}', '{"a":01}',
           '{"a":NaN}', '{"a":1,}', '[{"a":1}]', '"{}"', "null", '{"a":"b}', '{"a":"\\q"}', 'x {"a":1}', '{"a":1}],[{"b":2}', '{"a"}']
    rng = random.Random(3)
    torn = [(g := rng.choice(good[1:4] + ['{"level":"warn","msg":"torn apart"}']))[: rng.randrange(len(g))] for _ in range(40)]
    lines = good + odd + torn
    for line, row in zip(lines, parse(spark, lines), strict=True):
        if is_object(line):
            assert row["format"] == "json", line
            assert row["fields"] == line and row["bad_record"] is None
        else:
            assert row["format"] == ("broken" if line.strip(" \t\r\n").startswith("{") else "plain"), line
            assert row["message"] == line and row["fields"] == ""
            assert row["bad_record"] == (line if row["format"] == "broken" else None)


def test_fields_of_objects(spark):
    cases = {
        '{"message":"a","msg":"b"}': ("a", "INFO", "STDOUT", None),
        '{"msg":"boom","level":"fatal"}': ("boom", "FATAL", "STDOUT", None),
        '{"msg":"boom","level":"odd"}': ("boom", "INFO", "STDOUT", None),
        '{"msg":"an error","level":7}': ("an error", "ERROR", "STDOUT", None),
        '{"msg":"x","severity":"err","lvl":"debug"}': ("x", "ERROR", "STDOUT", None),
        '{"msg":{"deep":[1, 2]},"level":{"n":1}}': ('{"deep":[1,2]}', "INFO", "STDOUT", None),
        '{"msg":"first","msg":"last"}': ("last", "INFO", "STDOUT", None),
        '{"log":"line\\r\\n","stream":"stderr"}': ("line", "INFO", "STDERR", None),
        '{"msg":"stderr: x","stream":"stdout"}': ("stderr: x", "INFO", "STDOUT", None),
        '{"msg":"","time":"2024-03-01T10:00:00+02:00"}': ("", "INFO", "STDOUT", dt.datetime(2024, 3, 1, 8)),
        '{"msg":"x","time":"yesterday"}': ("x", "INFO", "STDOUT", None),
        '{"msg":"x","ts":1709287200}': ("x", "INFO", "STDOUT", dt.datetime(2024, 3, 1, 10)),
        '{"msg":"x","ts":1709287200.125}': ("x", "INFO", "STDOUT", dt.datetime(2024, 3, 1, 10, 0, 0, 125000)),
        '{"msg":"x","ts":1709287200125}': ("x", "INFO", "STDOUT", dt.datetime(2024, 3, 1, 10, 0, 0, 125000)),
        '{"msg":"x","ts":99999999999999999999}': ("x", "INFO", "STDOUT", None),
        '{"other":1}': ('{"other":1}', "INFO", "STDOUT", None),
        '{"msg":null,"level":null}': ('{"msg":null,"level":null}', "INFO", "STDOUT", None),
        '2024-01-01T00:00:00Z {"msg":"p","time":"2020-01-01T00:00:00Z"}': ("p", "INFO", "STDOUT", dt.datetime(2024, 1, 1)),
    }
    for (line, want), row in zip(cases.items(), parse(spark, list(cases)), strict=True):
        at = row["event_time"]
        assert (row["message"], row["level"], row["source"], at) == want, line
    assert parse(spark, [None])[0]["format"] == "plain"


def test_long_and_deep_objects(spark):
    deep = '{"a":' * 200 + "1" + "}" * 200
    long = json.dumps({"msg": "x" * 200_000, "more": ["y"] * 10_000})
    got = parse(spark, [deep, long])
    assert [r["format"] for r in got] == ["json", "json"] and len(got[1]["message"]) == 200_000


def test_ingest_reads_objects(spark):
    lines = [(1, "c1", '2024-01-01T00:00:00Z {"level":"warn","msg":"low disk","host":"h"}'), (None, "c1", '{"msg":"now"')]
    containers = spark.createDataFrame(SNAPSHOT, schemas.CONTAINERS)
    got = {r["message"]: r for r in ingest.ingest_rows(spark.createDataFrame(lines, schemas.RAW_LINES), containers).collect()}
    row = got["low disk"]
    assert (row["level"], row["metadata"]) == ("WARN", '{"level":"warn","msg":"low disk","host":"h"}')
    assert (got['{"msg":"now"']["level"], got['{"msg":"now"']["metadata"]) == ("INFO", "")


def test_copies_are_told_by_exact_time(spark):
    lines = [(1, "c", "2024-01-01T00:00:00.0001Z a"), (2, "c", "2024-01-01T00:00:00.0009Z a"), (3, "c", "no time")]
    df = spark.createDataFrame(lines, schemas.RAW_LINES)
    got = sorted(r["id"] for r in ingest.unique_lines(df, df).collect())
    assert got == [1, 2, 3, 3]
