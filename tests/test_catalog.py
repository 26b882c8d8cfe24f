"""Every registered query against its SQL, and the totals the derived data must give."""

import pytest

from logweir.plans.catalog import CATALOG
from tests.compare import TESTDATA, both, connect

SMALL = f"{TESTDATA}/sf0.001"
MEDIUM = f"{TESTDATA}/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_sql():
    assert [name for name, r in CATALOG.items() if r.oracle is None] == []


@pytest.mark.parametrize("name", list(CATALOG))
def test_query_equals_sql(spark, con, name):
    (columns, rows), (wanted_columns, wanted) = both(spark, con, CATALOG[name], SMALL)
    assert columns == wanted_columns
    assert rows == wanted


WRITES = ("stream_", "export_", "log_write", "metric_write")


@pytest.mark.parametrize("name", [n for n in CATALOG if not n.startswith(WRITES)])
def test_plan(spark, name):
    """No Python in tasks, no nested loops, and no window over rows of one partition."""
    plan = CATALOG[name].run(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("Python", "Pandas", "ArrowEval", "CartesianProduct", "NestedLoop"):
        assert unwanted not in plan
    steps = [line.strip(" :+-*()0123456789") for line in plan.splitlines()]
    for above, below in zip(steps, steps[1:]):
        assert not (above.startswith("Sort [") and below.startswith("Exchange SinglePartition"))


def counted(spark, name, column):
    df = CATALOG[name].run(spark, MEDIUM)
    return {r[column]: r["count"] for r in df.groupBy(column).count().collect()}


def test_level_totals(spark):
    assert counted(spark, "ingest_level", "level") == {
        "ERROR": 3125, "WARN": 625, "INFO": 5000, "DEBUG": 1250,
    }
    assert counted(spark, "extract_level", "level") == {
        "ERROR": 4375, "WARN": 625, "INFO": 3750, "DEBUG": 1250,
    }
    assert counted(spark, "level_normalize", "level") == {
        "DEBUG": 1112, "INFO": 1111, "WARN": 2222, "ERROR": 2222, "FATAL": 2222, "UNKNOWN": 1111,
    }


def test_pattern_totals_and_order(spark):
    rows = CATALOG["pattern_counts"].run(spark, MEDIUM).collect()
    assert [(r["pattern"], r["count"]) for r in rows] == [
        ("error", 3750), ("warning", 625), ("stack_trace", 2500),
        ("http_error", 625), ("sql_error", 1250), ("json_error", 625),
    ]
    rows = CATALOG["auto_filters"].run(spark, MEDIUM).collect()
    assert [(r["name"], r["count"]) for r in rows] == [
        ("Errors", 4375), ("Stack Traces", 3125), ("Database Errors", 1250),
        ("Warnings", 625), ("HTTP Errors", 625),
    ]


def test_row_totals(spark):
    def rows(name):
        return CATALOG[name].run(spark, MEDIUM).count()

    assert rows("logs_semi_stack") == 830
    assert rows("container_tail") == 7499
    assert rows("log_retention") == 2332
    assert rows("logs_per_day") == 30
    assert rows("log_dedup") == 10_000
    assert rows("cpu_percent_lag") == 9_850
    page = CATALOG["log_page_by_stack"].run(spark, MEDIUM).collect()
    assert [r["id"] for r in page] == [9968, 9944, 9922, 9918, 9876]
