"""Stored tables, exports and streaming jobs, including restarts from a checkpoint."""

import datetime as dt

from pyspark.sql import functions as F

from logweir import schemas
from logweir.operators import alerts, logs, metrics, patterns
from logweir.plans import catalog
from logweir.sources import event_views as views
from logweir.sources import exports, tables
from logweir.streaming import jobs
from tests.compare import TESTDATA
from tests.test_operators import HOSTILE, SNAPSHOT, T0, entry, table

SMALL = f"{TESTDATA}/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_log_table_prunes_and_pushes_down(spark, tmp_path):
    path = str(tmp_path / "logs")
    tables.write_logs(views.logs(views.read_events(spark, SMALL)), path)
    rows = tables.read_logs(spark, path)
    assert rows.count() == 1_000
    found = tables.in_range(
        rows.filter((F.col("container_id") == "c7") & F.col("message").contains("ERROR")),
        dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 7),
    ).select("message")
    text = plan(found)
    assert "PartitionFilters: [isnotnull(day" in text and "2024-01-05" in text
    assert "EqualTo(container_id,c7)" in text and "StringContains(message,ERROR)" in text
    assert "compose_file" not in text.split("ReadSchema")[1]
    expected = views.logs(views.read_events(spark, SMALL)).filter(
        "container_id = 'c7' AND contains(message, 'ERROR') AND "
        "timestamp >= '2024-01-05' AND timestamp < '2024-01-07'"
    )
    assert found.count() == expected.count()


def test_pages_read_only_their_days(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = [entry(n, seconds=86_400 * (n // 10) + n % 3, level="ERROR" if n % 2 else "INFO")
            for n in range(60)]
    tables.write_logs(table(spark, rows), path)
    stored = tables.read_logs(spark, path)
    for limit, offset, level in [(5, 0, "all"), (7, 8, "all"), (10, 10, "all"), (25, 13, "error"),
                                 (5, 29, "error"), (5, 30, "error"), (100, 0, "all")]:
        want = logs.log_page(stored, limit, offset, level=level).collect()
        assert logs.log_page_by_day(stored, limit, offset, level=level).collect() == want
    page = logs.log_page_by_day(stored, 5, 21)
    assert "2024-01-04" in plan(page) and "2024-01-06" not in plan(page)


def test_hot_container_is_spread_over_files(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = spark.range(20_000).selectExpr(
        "id", "timestamp_seconds(1704067200 + id) AS timestamp",
        "CASE WHEN id % 3 != 0 THEN 'hot' ELSE concat('c', id) END AS container_id",
        *[f"'' AS {c}" for c in schemas.LOGS.fieldNames()[3:]],
    )
    off = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in off.items():
        spark.conf.set(key, value)
    try:
        tables.write_logs(rows, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    per_file = (
        tables.read_logs(spark, path).filter("container_id = 'hot'")
        .groupBy(F.input_file_name()).count().collect()
    )
    assert len(per_file) >= 4
    assert max(r["count"] for r in per_file) < 20_000 * 2 / 3 / 2


def test_retention_drops_whole_days(spark):
    spark.sql("DROP TABLE IF EXISTS kept_logs")
    spark.sql("DROP TABLE IF EXISTS kept_metrics")
    for _ in range(2):
        tables.create_tables(spark, "kept_logs", "kept_metrics")
    tables.insert_logs(table(spark, [entry(n, seconds=86_400 * n) for n in range(6)]), "kept_logs")
    tables.insert_logs(table(spark, [entry(n, seconds=86_400 * n) for n in range(6, 10)]), "kept_logs")
    assert spark.table("kept_logs").count() == 10
    as_of = T0 + dt.timedelta(days=9, hours=1)
    dropped = tables.drop_expired_days(spark, "kept_logs", as_of)
    assert dropped == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    left = spark.table("kept_logs")
    assert sorted(r["id"] for r in left.collect()) == list(range(2, 10))
    # The day of the bound itself stays, and the filter takes its expired rows out.
    assert sorted(r["id"] for r in tables.retained(left, as_of).collect()) == list(range(3, 10))
    assert tables.drop_expired_days(spark, "kept_logs", as_of) == []
    assert tables.drop_expired_days(spark, "kept_metrics", as_of) == []
    spark.sql("DROP TABLE kept_logs")
    spark.sql("DROP TABLE kept_metrics")


def test_metric_table(spark, tmp_path):
    path = str(tmp_path / "metrics")
    rows = metrics.metric_rows(views.stats_samples(views.read_events(spark, SMALL)))
    tables.write_metrics(rows, path)
    stored = tables.read_metrics(spark, path)
    assert stored.drop(schemas.DAY).exceptAll(rows).count() == 0 and stored.count() == 1_000
    for container, limit in [(None, 100), ("c7", 40), ("c7", 5_000), ("none", 5)]:
        want = metrics.metric_latest(stored, container, limit).collect()
        assert metrics.metric_latest_by_day(stored, container, limit).collect() == want


def test_hostile_text_survives_every_sink(spark, tmp_path):
    texts = [t for t in HOSTILE if "\x00" not in t] + ["", 'a,"b",c', "end\\", "\"", "tab\tx"]
    rows = table(spark, [entry(n, t, level="ERROR") for n, t in enumerate(texts)])
    exports.export_json(rows, str(tmp_path / "json"))
    back = exports.read_json_export(spark, str(tmp_path / "json"))
    assert {r["id"]: r["message"] for r in back.collect()} == dict(enumerate(texts))
    assert {(r["level"], r["source"], r["metadata"]) for r in back.collect()} == {
        ("Error", "Stdout", None)
    }
    exports.export_csv(rows, str(tmp_path / "csv"))
    back = exports.read_csv_export(spark, str(tmp_path / "csv"))
    assert sorted(r["message"] for r in back.collect()) == sorted(texts)
    tables.write_logs(rows, str(tmp_path / "parquet"))
    back = tables.read_logs(spark, str(tmp_path / "parquet"))
    assert {r["id"]: r["message"] for r in back.collect()} == dict(enumerate(texts))


def test_csv_text(spark, tmp_path):
    exports.export_csv(table(spark, [entry(1, 'say "hi"')]), str(tmp_path / "csv"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "csv")).collect()]
    assert set(lines) == {  # every part file starts with the header
        '"timestamp","container_name","container_id","level","message"',
        '"2024-01-01T00:00:01Z","name-c1","c1","Info","say ""hi"""',
    }


def test_compose_files_are_found(spark, tmp_path):
    for folder, name in [("a", "docker-compose.yml"), ("b/my c+1", "docker-compose.yaml"), ("d", "x.yml")]:
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / name).write_text("services:\n  web:\n")
    found = {r["path"]: r["content"] for r in tables.read_compose_files(spark, [str(tmp_path)]).collect()}
    assert found == {
        f"{tmp_path}/a/docker-compose.yml": "services:\n  web:\n",
        f"{tmp_path}/b/my c+1/docker-compose.yaml": "services:\n  web:\n",
    }


def test_compose_files_are_dealt_to_groups(spark, tmp_path):
    """Many tasks write, and adaptive execution does not make them one; each project has one file."""
    texts = spark.range(300).selectExpr("concat('services:', id) AS value", "concat('app-', id) AS project")
    catalog._write_projects(texts, str(tmp_path / "out"))
    groups = [p for p in (tmp_path / "out").iterdir() if p.is_dir()]
    assert 32 < len(groups) <= catalog.LEAST_GROUPS
    held = [p for g in groups for p in g.iterdir() if p.is_dir()]
    assert sorted(p.name for p in held) == sorted(f"project=app-{n}" for n in range(300))
    assert all(len(list(p.iterdir())) == 1 for p in held)  # no checksum file either
    found = tables.read_compose_files(spark, [str(tmp_path / "out")], names="part-*.txt").collect()
    assert sorted(r["content"] for r in found) == sorted(f"services:{n}\n" for n in range(300))


def test_each_compose_file_is_opened_once(spark, tmp_path):
    """Stacks take several passes; the scan's plan has none over text files."""
    rows = [(n, dt.datetime(2024, 1, 1), n % 40, "view", 1.0, None) for n in range(80)]
    spark.createDataFrame(rows, views.EVENTS).write.parquet(str(tmp_path / "events.parquet"))
    scan = catalog.CATALOG["compose_files_scan"].run(spark, str(tmp_path))
    assert "FileScan text" not in plan(scan)
    assert scan.collect() == [(40, 40)]


ONCE = {"availableNow": True}


def land(spark, path, rows):
    table(spark, rows).write.mode("append").parquet(path)


def stream(spark, path):
    return tables.stream_rows(spark, path, schemas.LOGS, files_per_batch=1)


def test_pattern_counts_go_on_after_a_restart(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    first = [entry(1, "warn"), entry(2, "error")]
    second = [entry(3, "error"), entry(4, "timeout")]
    for rows in (first, second):
        land(spark, source, rows)
        jobs.count_patterns(stream(spark, source), sink, check, ONCE).awaitTermination()
    got = jobs.read_pattern_counts(spark, sink).collect()
    want = patterns.pattern_counts(table(spark, first + second)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_alert_stream_equals_batch(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for k in range(3):
        numbers = range(k * 10, k * 10 + 10)
        land(spark, source, [entry(n, "ERROR exception" if n % 2 else "exception") for n in numbers])
        jobs.raise_alerts(
            stream(spark, source), alerts.DEFAULT_RULES, sink, check, ONCE
        ).awaitTermination()
    events = spark.read.parquet(sink)
    assert events.count() == 30
    stats = {r["alert_id"]: r["triggered_count"]
             for r in alerts.alert_stats(events, alerts.DEFAULT_RULES).collect()}
    assert stats == {"error-detection": 15, "exception-detection": 15, "container-restart": 0}


def test_repeated_lines_across_batches(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = [entry(n, seconds=n) for n in range(20)]
    for batch in (rows[:12], rows[6:]):
        land(spark, source, batch)
        jobs.drop_repeated_lines(stream(spark, source), sink, check, ONCE).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == list(range(20))


def test_late_lines_are_kept(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for batch in ([entry(1, seconds=900_000)], [entry(2, seconds=5), entry(3, seconds=5)]):
        land(spark, source, batch)
        jobs.drop_repeated_lines(stream(spark, source), sink, check, ONCE).awaitTermination()
    assert spark.read.parquet(sink).count() == 2


def test_ingest_stream_enriches(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    lines = [(1, "c1", "2024-01-01T00:00:00.5Z stderr: fatal"), (2, "zz", "no time, no container")]
    spark.createDataFrame(lines, schemas.RAW_LINES).write.parquet(source)
    jobs.ingest_logs(
        tables.stream_rows(spark, source, schemas.RAW_LINES),
        lambda session: session.createDataFrame(SNAPSHOT, schemas.CONTAINERS), sink, check, ONCE,
    ).awaitTermination()
    rows = {r["id"]: r for r in tables.read_logs(spark, sink).collect()}
    assert rows[1]["timestamp"] == dt.datetime(2024, 1, 1, 0, 0, 0, 500_000)
    assert (rows[1]["message"], rows[1]["level"], rows[1]["source"]) == ("stderr: fatal", "ERROR", "STDERR")
    assert (rows[1]["container_name"], rows[1]["compose_project"]) == ("web", "p")
    assert (rows[2]["container_name"], rows[2]["compose_project"]) == ("zz", "")
    assert rows[2]["message"] == "no time, no container"
    assert rows[2]["timestamp"] is not None  # a line without a time is stamped on arrival


def test_ingest_stream_reads_the_snapshot_anew(spark, tmp_path):
    """Containers listed later are known, the snapshot may be replaced, and old days can go."""
    source, listed, sink, check = (str(tmp_path / n) for n in ("in", "listed", "out", "check"))

    def land(rows):
        spark.createDataFrame(rows, schemas.RAW_LINES).coalesce(1).write.mode("append").parquet(source)

    def listing(rows):
        spark.createDataFrame(rows, schemas.CONTAINERS).write.mode("overwrite").parquet(listed)

    listing(SNAPSHOT[:1] * 2)
    land([(1, "c1", "2024-01-01T00:00:00Z a"), (2, "c2", "2024-01-01T00:00:01Z b")])
    query = jobs.ingest_logs(
        tables.stream_rows(spark, source, schemas.RAW_LINES),
        lambda session: tables.read_containers(session, listed),
        sink, check, {"processingTime": "0 seconds"},
    )
    try:
        query.processAllAvailable()
        listing(SNAPSHOT)
        land([(3, "c2", "2024-01-09T00:00:00Z c"), (4, "c2", "2024-01-01T09:00:00Z d")])
        query.processAllAvailable()
    finally:
        query.stop()
    names = {r["id"]: r["container_name"] for r in tables.read_logs(spark, sink).collect()}
    assert names == {1: "web", 2: "c2", 3: "db", 4: "db"}
    assert tables.read_logs(spark, sink).count() == 4

    at = dt.datetime(2024, 1, 9, tzinfo=dt.timezone.utc)
    assert tables.drop_expired_folders(spark, sink, at) == [dt.date(2024, 1, 1)]
    assert [r["id"] for r in tables.read_logs(spark, sink).collect()] == [3]
    assert tables.drop_expired_folders(spark, sink, at) == []
