"""Operators on small literal tables, against expectations worked out in plain Python."""

import datetime as dt
import random

import pytest

from logweir import schemas
from logweir.operators import alerts, containers, logs, metrics, patterns, stacks
from logweir.operators.ingest import ingest_rows
from logweir.operators.sequence import carry_forward, previous_row, running_sum
from logweir.session import broadcast_if_small, scratch_path

T0 = dt.datetime(2024, 1, 1)


def entry(n, message="m", container="c1", level="INFO", project="p", seconds=None, **more):
    row = dict(
        id=n,
        timestamp=T0 + dt.timedelta(seconds=n if seconds is None else seconds),
        container_id=container,
        container_name=f"name-{container}",
        compose_project=project,
        compose_file="docker-compose.yml",
        message=message,
        level=level,
        source="STDOUT",
        metadata="",
    )
    row.update(more)
    return tuple(row[name] for name in schemas.LOGS.fieldNames())


def table(spark, rows):
    return spark.createDataFrame(rows, schemas.LOGS)


def ids(df):
    return [r["id"] for r in df.collect()]


HOSTILE = ["100%", "a_b", "back\\slash", "plain", "%'; --", "it's \"quoted\"", "nul\x00byte", "a\nb"]


def test_search_is_literal(spark):
    rows = table(spark, [entry(n, f"<{m}>") for n, m in enumerate(HOSTILE + ["axb", "1000"])])
    for n, text in enumerate(HOSTILE):
        assert ids(logs.filter_logs(rows, search=text)) == [n]


def test_encode_decode(spark):
    rows = table(
        spark,
        [
            entry(None, HOSTILE[5], seconds=0, metadata=None, level="bogus", source="stderr"),
            entry(7, metadata="{}", level="err", source="x"),
        ],
    )
    stored = logs.encode_logs(rows)
    assert [(r["id"], r["metadata"]) for r in stored.collect()] == [(0, ""), (7, "{}")]
    back = logs.decode_logs(stored).collect()
    assert [(r["level"], r["source"], r["metadata"]) for r in back] == [
        ("UNKNOWN", "STDERR", None), ("ERROR", "STDOUT", "{}"),
    ]
    assert back[0]["message"] == HOSTILE[5]


def test_validation():
    logs.validate_query(100, "abc-123_x", "Error")
    for bad in [dict(limit=50_000), dict(container_id="c1 or true"), dict(level="loud")]:
        with pytest.raises(ValueError):
            logs.validate_query(**bad)


def test_pages_cover_everything_once(spark):
    rows = table(spark, [entry(n, seconds=n // 3) for n in range(25)])
    by_offset = [i for o in range(0, 30, 7) for i in ids(logs.log_page(rows, 7, o))]
    assert by_offset == list(range(24, -1, -1))
    seen, before = [], None
    while True:
        page = logs.log_page(rows, 7, before=before).collect()
        if not page:
            break
        seen += [r["id"] for r in page]
        before = (page[-1]["timestamp"], page[-1]["id"])
    assert seen == by_offset


def test_page_info(spark):
    rows = table(spark, [entry(n) for n in range(10)])
    assert tuple(logs.page_info(rows, 5, 0).first()) == (10, True, "offset:5")
    assert tuple(logs.page_info(rows, 5, 5).first()) == (10, False, None)
    assert tuple(logs.page_info(rows, 5, 50).first()) == (10, False, None)


def test_filters_come_before_the_limit_unless_asked(spark):
    rows = table(spark, [entry(n, project="a" if n < 5 else "b") for n in range(10)])
    assert ids(logs.log_page(rows, 3, stack="a")) == [4, 3, 2]
    late = logs.log_page_postfilter(rows, 6, stack="a")
    assert ids(late) == [4]
    assert tuple(logs.page_info_postfilter(late, 6).first()) == (1, False, None)


def test_container_list_is_taken_verbatim(spark):
    rows = table(spark, [entry(1, container="c1"), entry(2, container="c2")])
    assert ids(logs.filter_logs(rows, containers="c1, c2")) == [1]


def test_stats(spark):
    rows = table(
        spark,
        [entry(n, level=level) for n, level in enumerate(["ERROR", "FATAL", "WARN", "INFO", "ERROR"])]
        + [entry(9, container="c2", level="DEBUG", container_name="old"),
           entry(10, container="c2", level="UNKNOWN", container_name="new")],
    )
    assert tuple(logs.log_stats(rows).first()) == (7, 2, 1, 1, 1)
    assert tuple(logs.log_stats(rows, sample_limit=2).first()) == (2, 0, 0, 0, 1)
    per = {r[0]: (r[1], r[2]) for r in logs.log_stats_by_container(rows).collect()}
    assert per == {"c1": ("name-c1", 5), "c2": ("new", 2)}


def test_tail_with_a_hot_container(spark):
    random.seed(1)
    rows = [entry(n, container=random.choice(["hot", "hot", "hot", f"c{n % 7}"]),
                  seconds=random.randrange(400)) for n in range(3_000)]
    wanted = set()
    for c in {r[2] for r in rows}:
        mine = sorted((r for r in rows if r[2] == c), key=lambda r: (r[1], r[0]), reverse=True)
        wanted |= {r[0] for r in mine[:50]}
    got = ids(logs.tail(table(spark, rows).repartition(23)))
    assert len(got) == len(wanted) and set(got) == wanted


def test_dedup_keeps_the_first_copy(spark):
    once = [entry(n, f"m{n % 4}", seconds=n // 8) for n in range(40)]
    history, live = table(spark, once), table(spark, [(r[0] + 100, *r[1:]) for r in once])
    wanted = {}
    for r in once:
        wanted.setdefault((r[1], r[2], r[6]), r[0])
    assert sorted(ids(logs.dedup(history, live))) == sorted(wanted.values())


def test_live_filter_and_viewer(spark):
    rows = table(spark, [entry(1, "Hello"), entry(2, "x", container="HELlo", project="q"),
                         entry(3, "bye", level="ERROR")])
    assert ids(logs.live_filter(rows)) == [1, 2, 3]
    assert ids(logs.live_filter(rows, ["c1"], "p")) == [1, 3]
    assert ids(logs.viewer_search(rows, search="hELLO")) == [2, 1]
    assert ids(logs.viewer_search(rows, "Error")) == [3]


SNAPSHOT = [
    ("c1", "web", "nginx:1", "Up 3 hours", 1, {"com.docker.compose.project": "p"}, []),
    ("c2", "db", "PG:1", "Exited (0)", 1, {"com.docker.compose.project": "p"}, []),
    ("c3", "job", "nginx:2", "up and about", 1, {}, []),
    ("c4", "api", "go", "Up", 1, {"com.docker.compose.project": "q"}, [(80, 8080, "tcp")]),
]


def snapshot(spark):
    return spark.createDataFrame(SNAPSHOT, schemas.CONTAINERS)


def test_container_filters(spark):
    def found(**filters):
        return ids(containers.filter_containers(snapshot(spark), **filters))

    assert found(stack="p") == ["c1", "c2"]
    assert found(status="RUNNING") == ["c1", "c3", "c4"]
    assert found(status="stopped") == ["c2"]
    assert found(status="whatever") == ["c1", "c2", "c3", "c4"]
    assert found(search="NGINX") == ["c1", "c3"]
    assert found(search="pg", stack="p", status="stopped") == ["c2"]


def test_stack_rollup(spark):
    rows = {r[0]: tuple(r)[1:] for r in containers.stack_rollup(snapshot(spark)).collect()}
    assert rows == {"p": (2, 1, 1), "q": (1, 1, 0)}


def test_listing_defaults(spark):
    listing = spark.createDataFrame(
        [("c1", ["//web", "/x"], "i", "Up", 5, {"a": "b"}, [(80, None, "tcp"), (81, 1, None), (82, 1, "")]),
         ("c2", [], None, None, None, None, None),
         (None, None, None, None, None, None, None)],
        schemas.CONTAINER_LISTING,
    )
    first, second, third = containers.project_listing(listing).collect()
    assert first["name"] == "web"
    assert [tuple(p) for p in first["ports"]] == [(80, None, "TCP"), (81, 1, ""), (82, 1, "EMPTY")]
    assert tuple(second) == ("c2", "", "", "", 0, {}, [])
    assert tuple(third) == ("", "", "", "", 0, {}, [])


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_joins_do_not_depend_on_the_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(logs, "broadcast_if_small", lambda df: broadcast_if_small(df, limit))
    rows = table(spark, [entry(n, container=f"c{n % 6}") for n in range(60)])
    assert logs.logs_of_stack(rows, snapshot(spark), "p").count() == 20
    assert logs.running_logs(rows, snapshot(spark)).count() == 20  # c3 is not "Up"
    lines = spark.createDataFrame(
        [(n, f"c{n % 6}", f"2024-01-01T00:00:0{n % 10}Z text") for n in range(60)], schemas.RAW_LINES
    )
    got = ingest_rows(lines, snapshot(spark))
    names = {(r["container_id"], r["container_name"], r["compose_project"]) for r in got.collect()}
    assert got.count() == 60
    assert names == {("c0", "c0", ""), ("c1", "web", "p"), ("c2", "db", "p"), ("c3", "job", ""),
                     ("c4", "api", "q"), ("c5", "c5", "")}


def test_broadcast_is_measured(spark):
    small = spark.range(10).selectExpr("id", "'x' AS name", "map('a', 'b') AS m")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_small(small))
    assert not hinted(broadcast_if_small(small, 100))


def test_auto_filters(spark):
    def found(messages):
        rows = table(spark, [entry(n, m) for n, m in enumerate(messages)])
        return [(r["name"], r["count"]) for r in patterns.auto_filters(rows).collect()]

    assert found(["ERROR: a", "ERROR: b", "WARNING: c", "INFO"]) == [("Errors", 2), ("Warnings", 1)]
    assert found([]) == []
    assert found(["warn", "error"]) == [("Errors", 1), ("Warnings", 1)]


def test_pattern_counts_order(spark):
    rows = table(spark, [entry(1, "warn: timeout"), entry(2, "error"), entry(3, "timeout")])
    got = patterns.pattern_counts(rows).collect()
    assert [(r["pattern"], r["count"], r["detected_count"]) for r in got] == [
        ("warning", 1, 3), ("sql_error", 2, 3), ("error", 1, 3),
    ]
    assert got[1]["first_seen"] == T0 + dt.timedelta(seconds=1)
    assert got[1]["last_seen"] == T0 + dt.timedelta(seconds=3)
    assert patterns.pattern_counts(rows.limit(0)).collect() == []


def rule(n, pattern, **more):
    return alerts.AlertRule(f"r{n}", f"Rule {n}", more.pop("kind", alerts.PATTERN), pattern, **more)


def test_first_and_all_matches(spark):
    rows = table(spark, [entry(1, "both a and b"), entry(2, "b"), entry(3, "A"), entry(4, "restarting")])
    rules = [rule(1, "a"), rule(2, "b"), rule(3, "b", enabled=False),
             rule(4, "restarting", kind=alerts.CONTAINER_RESTART), rule(5, None)]
    events = alerts.alert_events(rows, rules)
    assert sorted((r["log_id"], r["alert_id"]) for r in events.collect()) == [
        (1, "r1"), (2, "r2"), (4, "r1"),
    ]
    assert events.filter("log_id = 2").first()["message"] == "Pattern 'b' detected in container c1"
    every = alerts.alert_matches_all(rows, rules).collect()
    assert sorted((r["log_id"], r["alert_id"]) for r in every) == [
        (1, "r1"), (1, "r2"), (2, "r2"), (4, "r1"),
    ]
    assert [r["log_id"] for r in alerts.restart_alerts(rows, rules).collect()] == [4]
    assert alerts.alert_events(rows, []).collect() == []


def test_many_rules_give_the_same_events(spark):
    rows = table(spark, [entry(n, f"x{n % 90}y it's") for n in range(200)])
    rules = [rule(n, f"x{n}y") for n in range(80)]
    many = alerts.alert_events(rows, rules)
    assert sorted((r["log_id"], r["alert_id"]) for r in many.collect()) == sorted(
        (n, f"r{n % 90}") for n in range(200) if n % 90 < 80
    )
    assert alerts.alert_events(rows, [rule(0, "it's")]).count() == 200


def test_scoped_rules(spark):
    rows = table(spark, [entry(1, "a", container="c1"), entry(2, "a", container="c2")])
    rules = [rule(1, "a", container_id="c2"), rule(2, "a")]
    for padding in (0, 100):
        padded = [rule(100 + n, f"never {n}") for n in range(padding)] + rules
        events = alerts.alert_events(rows, padded, scoped=True).collect()
        assert sorted((r["log_id"], r["alert_id"]) for r in events) == [(1, "r2"), (2, "r1")]


def test_alert_counters(spark):
    rows = table(spark, [entry(n, "a") for n in range(3)])
    old = dt.datetime(2030, 1, 1)
    rules = [rule(1, "a", triggered_count=10), rule(2, "z"), rule(3, "q", last_triggered=old)]
    events = alerts.alert_events(rows, rules)
    stats = {r["alert_id"]: (r["triggered_count"], r["last_triggered"])
             for r in alerts.alert_stats(events, rules).collect()}
    assert stats == {"r1": (13, T0 + dt.timedelta(seconds=2)), "r2": (0, None), "r3": (0, old)}


def test_recent_events(spark):
    events = alerts.alert_events(table(spark, [entry(n, "a") for n in range(150)]), [rule(1, "a")])
    assert [r["log_id"] for r in alerts.recent_events(events, 3).collect()] == [149, 148, 147]
    assert alerts.recent_events(events, 1_000).count() == 150


def test_rule_lists():
    rules = alerts.add_rule(alerts.DEFAULT_RULES, rule(1, "a"))
    assert [r.id for r in rules][-1] == "r1"
    replaced = alerts.add_rule(rules, rule(1, "b"))
    assert [r.pattern for r in replaced if r.id == "r1"] == ["b"]
    assert len(alerts.remove_rule(replaced, "r1")) == 3
    assert [r.name for r in alerts.DEFAULT_RULES] == [
        "Error Detection", "Exception Detection", "Container Restart",
    ]


def test_compose_stacks(spark):
    yml = "services:\n  web:\n    image: nginx\n"
    files = spark.createDataFrame(
        [("/srv/b/docker-compose.yml", yml), ("/srv/b/docker-compose.yaml", "services:\n  no:\n"),
         ("/srv/b/deep/er/docker-compose.yml", yml), ("/srv/a/docker-compose.yaml", yml),
         ("/srv/node_modules/x/docker-compose.yml", yml), ("/srv/node_modules_2/docker-compose.yml", yml),
         ("/srv/c/other.yml", yml), ("/srv/bb/docker-compose.yml", yml)],
        "path string, content string",
    )
    rows = stacks.compose_stacks(files).collect()
    assert [(r["path"], r["name"], r["containers"], r["enabled"]) for r in rows] == [
        ("/srv/a", "a", ["web"], False), ("/srv/b", "b", ["web"], False),
        ("/srv/bb", "bb", ["web"], False), ("/srv/node_modules_2", "node_modules_2", ["web"], False),
    ]
    loose = stacks.compose_stacks(files, loose=True).first()
    assert loose["containers"] == ["web", "image: nginx"]


def test_sequences_with_a_hot_key(spark):
    random.seed(2)
    rows = [(n, T0 + dt.timedelta(seconds=random.randrange(1_000)),
             random.choice(["hot", "hot", f"k{n % 9}"]), random.randrange(50)) for n in range(2_000)]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp, k string, v long").repartition(11)
    sums, previous, state, last = {}, {}, {}, {}
    for n, at, key, v in sorted(rows, key=lambda r: (r[1], r[0])):
        state[key] = state.get(key, 0) + v
        sums[n], previous[n] = state[key], last.get(key)
        last[key] = v
    got = running_sum(df, "k", "v", "total").collect()
    assert {r["id"]: r["total"] for r in got} == sums and len(got) == 2_000
    got = previous_row(df, "k", ["v"]).collect()
    assert {r["id"]: r["prev_v"] for r in got} == previous and len(got) == 2_000


def test_carry_forward_with_a_hot_key(spark):
    random.seed(3)
    rows = [(n, T0 + dt.timedelta(seconds=random.randrange(2_000)),
             random.choice(["hot", "hot", f"k{n % 9}"]),
             random.choice([None, None, None, None, n])) for n in range(2_000)]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp, k string, v long").repartition(11)
    latest, want = {}, {}
    for n, at, key, v in sorted(rows, key=lambda r: (r[1], r[0])):
        if v is not None:
            latest[key] = v
        want[n] = latest.get(key)
    got = carry_forward(df, "k", "v", "seen").collect()
    assert {r["id"]: r["seen"] for r in got} == want and len(got) == 2_000


def test_stack_traces(spark):
    frame = "\tat a.B.c(D.java:1)"
    rows = table(spark, [
        entry(0, frame), entry(1, "java.lang.Exception"), entry(2, frame), entry(3, frame, seconds=400),
        entry(4, "done", seconds=401), entry(5, frame, seconds=402), entry(6, "Traceback", seconds=403),
        entry(7, "Traceback", container="c2", seconds=2), entry(8, frame, container="c2", seconds=3),
    ])
    got = {r["trace_id"]: r["lines"] for r in patterns.stack_traces(rows).collect()}
    assert got == {1: 3, 6: 1, 7: 2}
    assert sorted((r["id"], r["trace_id"]) for r in patterns.trace_lines(rows).collect()) == [
        (1, 1), (2, 1), (3, 1), (6, 6), (7, 7), (8, 7),
    ]


@pytest.mark.parametrize("number", [0, -1, None])
def test_stack_traces_without_own_ids(spark, number):
    frame, texts = "\tat a.B.c(D.java:1)", []
    for length in (1, 3, 0):
        texts += ["Traceback", *[frame] * length]
    rows = table(spark, [entry(number, text, seconds=70 * n) for n, text in enumerate(texts)])
    got = sorted((r["first_time"], r["lines"]) for r in patterns.stack_traces(rows).collect())
    assert [lines for _, lines in got] == [2, 4, 1]
    assert patterns.trace_lines(rows).count() == len(texts)


def test_metric_lookup_limits(spark):
    rows = spark.range(1_500).selectExpr(
        "id", "timestamp_millis(id) AS timestamp", "concat('c', id % 2) AS container_id"
    )
    assert metrics.metric_latest(rows, limit=9_999).count() == 1_500
    assert [r["id"] for r in metrics.metric_latest(rows, "c0", 2).collect()] == [1498, 1496]


def test_scratch_path_follows_the_session(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_pages_by_key_see_every_row_of_tied_times(spark):
    """Fifty lines without an id, five to a time: pages of seven meet each of them once."""
    rows = table(spark, [entry(0, f"m{n}", f"c{n % 2}", seconds=n // 5) for n in range(50)])
    seen, before = [], None
    while page := logs.log_page(rows, 7, before=before).collect():
        seen += [r["message"] for r in page]
        before = logs.page_key(page[-1])
    assert sorted(seen) == sorted(f"m{n}" for n in range(50)) and len(seen) == 50


def test_a_limit_is_honoured_or_refused(spark):
    rows = table(spark, [entry(n) for n in range(1_200)])
    assert logs.log_page(rows, 1_100).count() == 1_100
    with pytest.raises(ValueError):
        logs.log_page(rows, 10_001)
    with pytest.raises(ValueError):
        logs.log_page(rows, 5, level="loud")


def test_search_finds_rows_of_any_age(spark):
    rows = table(spark, [entry(0, "needle", level="ERROR"), *[entry(n) for n in range(1, 40)]])
    assert ids(logs.viewer_search(rows, "error", "NEEDLE")) == [0]
    assert ids(logs.viewer_search(rows, "error", "NEEDLE", kept=30)) == []


def test_rows_without_ids_are_not_multiplied(spark):
    rows = spark.createDataFrame(
        [("k", T0 + dt.timedelta(seconds=n // 2), None, float(n)) for n in range(4)],
        "key string, timestamp timestamp, id long, v double",
    )
    assert previous_row(rows, "key", ["v"]).count() == 4
    assert carry_forward(rows, "key", "v", "last").count() == 4
    assert running_sum(rows, "key", "v", "total").count() == 4


def test_a_container_listed_twice_multiplies_no_line(spark):
    lines = spark.createDataFrame([(n, "c1") for n in range(7)], "id long, container_id string")
    listing = "id string, name string, labels map<string,string>, listed_at timestamp"
    twice = spark.createDataFrame([("c1", "new", {}, T0 + dt.timedelta(1)), ("c1", "old", {}, T0)], listing)
    got = logs.enrich(lines, twice).collect()
    assert len(got) == 7 and {r["container_name"] for r in got} == {"new"}
    assert logs.enrich(lines, twice.drop("listed_at")).count() == 7
