"""Upkeep of streamed tables: sealing, statistics, search, retention, versions; and keys of pages."""

import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from logweir import schemas
from logweir.operators import alerts, logs, metrics, patterns, sequence
from logweir.sources import event_views as views
from logweir.sources import rules as stored_rules
from logweir.sources import sealed, tables, versions
from logweir.streaming import jobs
from tests.compare import TESTDATA
from tests.test_operators import SNAPSHOT, T0, entry, rule, table
from tests.test_storage_and_streams import ONCE, plan

SMALL = f"{TESTDATA}/sf0.001"
DAY = 86_400


def batch(spark, path, number, rows):
    """What a streaming batch writes."""
    out = table(spark, rows).withColumn(schemas.DAY, F.to_date("timestamp"))
    out.write.mode("overwrite").partitionBy(schemas.DAY).parquet(f"{path}/{schemas.BATCH}={number}")


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def days(*numbers):
    return [(T0 + dt.timedelta(days=n)).date() for n in numbers]


@pytest.fixture
def streamed(spark, tmp_path):
    """Three batches over three days; the id says day and batch."""
    path = str(tmp_path / "table")
    for b in range(3):
        batch(spark, path, b, [entry(100 * d + b, f"m{d} needle{d}", seconds=DAY * d + b) for d in range(3)])
    return path


def test_sealing_keeps_every_row_once(spark, streamed):
    everything = sorted(100 * d + b for d in range(3) for b in range(3))
    before = tables.read_logs(spark, streamed)  # a reader that began before
    assert ids(before) == everything
    # The newest batch may be repeated and the last day is open.
    assert sealed.seal(spark, streamed, schemas.LOGS, days(2)[0]) == days(0, 1)
    at = sealed.live(spark, streamed)
    assert {(b, d) for b, d, _ in at.open} == {(2, "2024-01-01"), (2, "2024-01-02"), *((b, "2024-01-03") for b in range(3))}
    assert ids(tables.read_logs(spark, streamed)) == ids(before) == everything
    assert tables.read_logs(spark, streamed).drop(schemas.DAY).exceptAll(before.drop(schemas.DAY)).count() == 0
    # Replaced folders stay until two manifests do not need them.
    assert sealed.clean(spark, streamed) == 4 and ids(tables.read_logs(spark, streamed)) == everything
    assert sealed.seal(spark, streamed, schemas.LOGS, days(2)[0]) == []


def test_late_rows_and_repeated_batches(spark, streamed):
    sealed.seal(spark, streamed, schemas.LOGS, days(2)[0])
    batch(spark, streamed, 2, [entry(2, seconds=2)])  # the newest batch, repeated with other rows
    batch(spark, streamed, 3, [entry(3, "late", seconds=3), entry(900, seconds=DAY * 9)])
    want = [0, 1, 2, 3, 100, 101, 200, 201, 900]
    assert ids(tables.read_logs(spark, streamed)) == want
    assert sealed.seal(spark, streamed, schemas.LOGS, days(2)[0]) == days(0)  # sealed again, with late rows
    assert ids(tables.read_logs(spark, streamed)) == want
    batch(spark, streamed, 4, [entry(901, seconds=DAY * 9)])
    assert sealed.seal(spark, streamed, schemas.LOGS, days(5)[0]) == days(0, 2)
    for _ in range(3):
        sealed.clean(spark, streamed)
        assert ids(tables.read_logs(spark, streamed)) == [*want, 901]
    folders = versions.listed(spark, f"{streamed}/batch=*/day=*")
    assert len(folders) < 6 and len(versions.numbers(spark, f"{streamed}/_manifest")) == sealed.KEPT


def test_a_batch_that_is_being_written_is_not_read(spark, streamed):
    versions.delete(spark, f"{streamed}/batch=1/_SUCCESS")
    assert ids(tables.read_logs(spark, streamed)) == [0, 2, 100, 102, 200, 202]


def test_one_of_two_sealings_gives_up(spark, streamed, monkeypatch):
    real, first = sealed._published, []

    def late(spark, path, version, new):
        if not first:  # another call comes first
            first.append(1)
            sealed.seal(spark, path, schemas.LOGS, days(2)[0])
        return real(spark, path, version, new)

    monkeypatch.setattr(sealed, "_published", late)
    assert sealed.seal(spark, streamed, schemas.LOGS, days(2)[0]) == []
    assert len(ids(tables.read_logs(spark, streamed))) == 9
    assert len(versions.listed(spark, f"{streamed}/_sealed/seal=*")) == 1


def test_readers_during_sealing(spark, tmp_path):
    """A reader that looks again and again sees every row once at any time."""
    path, seen, stop = str(tmp_path / "table"), [], threading.Event()
    for b in range(4):
        batch(spark, path, b, [entry(10 * b + n, seconds=DAY * (n % 4)) for n in range(8)])

    def look():
        while not stop.is_set():
            seen.append(ids(tables.read_logs(spark, path)))

    reader = threading.Thread(target=look)
    reader.start()
    try:
        for d in (1, 2, 3):
            sealed.seal(spark, path, schemas.LOGS, days(d)[0])
    finally:
        stop.set()
        reader.join()
    assert seen and all(s == ids(tables.read_logs(spark, path)) for s in seen)


def test_statistics_do_not_scan_sealed_days(spark, streamed):
    batch(spark, streamed, 3, [entry(900, "ERROR", level="ERROR", seconds=DAY * 2)])
    rows = tables.read_logs(spark, streamed)
    want = logs.log_stats(rows).collect(), sorted(logs.log_stats_by_container(rows).collect())
    sealed.seal(spark, streamed, schemas.LOGS, days(2)[0])
    counts = sealed.counts(spark, streamed)
    assert (logs.stats_of_counts(counts).collect(), sorted(logs.stats_by_container_of_counts(counts).collect())) == want
    assert not any("_sealed" in f for f in counts.inputFiles())
    got = logs.stats_of_counts(counts, container_id="none").first()
    assert (got.total, got.error_count) == (0, 0)
    # A day that is sealed again is counted once.
    batch(spark, streamed, 4, [entry(5, seconds=5)])
    batch(spark, streamed, 5, [entry(6, seconds=DAY * 2)])
    sealed.seal(spark, streamed, schemas.LOGS, days(2)[0])
    assert logs.stats_of_counts(sealed.counts(spark, streamed)).first().total == tables.read_logs(spark, streamed).count()


def test_search_skips_files(spark, tmp_path):
    path = str(tmp_path / "table")
    words = ["alpha", "Beta", "ΣΟΦΟΣ", "İstanbul", "x%_y", "日本語テキスト", "ab", "", "tail"]
    rows = [entry(n, f"{words[n]} {n}", seconds=DAY * n) for n in range(len(words))]
    batch(spark, path, 0, rows)
    batch(spark, path, 1, [entry(100, "open alpha", seconds=DAY * 30)])
    sealed.seal(spark, path, schemas.LOGS, days(20)[0])
    at = sealed.live(spark, path)
    assert len(at.days) == len(words)
    for needle in ["alpha", "lph", "Beta", "ΣΟΦΟΣ", "ΟΦΟΣ ", "ΣΟΦ", "İst", "stanbul", "%_y", "本語テ", "ab", "b", "", "tail 8", "absent"]:
        rows = tables.read_logs(spark, path)
        want = ids(logs.filter_logs(rows, search=needle))
        found = sealed.read_with_text(spark, path, needle)
        assert ids(logs.filter_logs(found, search=needle)) == want, needle
        viewed = ids(rows.where(F.lower("message").contains(needle.lower())))
        assert ids(found.where(F.lower("message").contains(needle.lower()))) == viewed, needle
    assert len(sealed.files_with(spark, path, "alpha", at)) == 1
    assert sealed.files_with(spark, path, "absent", at) == []
    assert sealed.files_with(spark, path, "ab", at) is None
    files = sealed.read_with_text(spark, path, "Beta").inputFiles()
    assert len(files) == 2 and len(tables.read_logs(spark, path).inputFiles()) == len(words) + 1


def test_retention_of_every_streamed_table(spark, tmp_path):
    at = (T0 + dt.timedelta(days=9)).replace(tzinfo=dt.timezone.utc)
    lines = table(spark, [entry(n, "ERROR", seconds=DAY * n) for n in range(10)])
    samples = views.stats_samples(views.read_events(spark, SMALL)).limit(10)
    samples = samples.withColumn("timestamp", F.expr("timestamp'2024-01-01' + make_dt_interval(int(id % 10))"))
    for name, rows, start, read in (
        ("alerts", lines, lambda s, *a: jobs.raise_alerts(s, alerts.DEFAULT_RULES, *a), tables.read_alert_events),
        ("metrics", samples, jobs.ingest_metrics, tables.read_metrics),
    ):
        landed, path, check = (str(tmp_path / f"{name}-{n}") for n in ("in", "out", "check"))
        for _ in range(2):
            rows.coalesce(1).write.mode("append").parquet(landed)
            source = tables.stream_rows(spark, landed, rows.schema)
            start(source, path, check, ONCE).awaitTermination()
        total = read(spark, path).count()
        if name == "metrics":
            sealed.seal(spark, path, schemas.METRICS, days(5)[0])
            assert read(spark, path).count() == total
        dropped = tables.drop_expired_folders(spark, path, at)
        assert dropped and max(dropped) < days(2)[0]
        left = read(spark, path)
        assert 0 < left.count() < total and left.agg(F.min(schemas.DAY)).first()[0] >= days(2)[0]
        assert tables.drop_expired_folders(spark, path, at) == []


def test_pages_gallop_back_over_days(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = [entry(n, "even" if n % 2 else "odd", seconds=DAY * (n // 5) + n % 5) for n in range(100)]
    tables.write_logs(table(spark, rows), path)
    stored = tables.read_logs(spark, path)
    read = []
    real = tables._of_days
    tables._of_days = lambda df, some: read.extend(some) or real(df, some)
    try:
        page = logs.log_page_by_day(stored, 12)
        assert ids(page) == list(range(88, 100)) and min(read) == "2024-01-18"  # 1, then 2 of 20 days
        before = (T0 + dt.timedelta(days=10), None)
        read.clear()
        assert ids(logs.log_page_by_day(stored, 3, before=before, search="odd")) == [44, 46, 48]
        # days that the key's own bound leaves out hold nothing and are counted without being read
        assert min(read) >= "2024-01-05"
    finally:
        tables._of_days = real
    assert logs.log_page_by_day(stored, 10, search="absent").collect() == []
    assert logs.log_page_by_day(stored, 10, 95).collect() == logs.log_page(stored, 10, 95).collect()


def test_snapshot_is_replaced_while_it_is_read(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    known = spark.createDataFrame(SNAPSHOT, schemas.CONTAINERS)
    assert tables.publish_containers(known.limit(1), path) == 1
    pinned = tables.read_containers(spark, path)
    for n in range(3):
        assert tables.publish_containers(known, path) == n + 2
    assert pinned.count() == 1 and tables.read_containers(spark, path).count() == len(SNAPSHOT)
    lines = spark.createDataFrame([("c1",), ("zz",)], "container_id string")
    stored = tables.read_attributes(spark, path)
    assert stored.small and logs.enrich(lines, stored).collect() == logs.enrich(lines, known).collect()
    shuffled = logs.enrich(lines, logs.Attributes(stored.rows, False))
    assert sorted(shuffled.collect()) == sorted(logs.enrich(lines, known).collect())
    tables.publish_containers(known, path, kept=2)
    assert len(versions.numbers(spark, f"{path}/_versions")) == 2
    assert len(versions.listed(spark, f"{path}/snapshot-*")) == 2


def test_only_one_writer_gets_a_version(spark, tmp_path):
    folder = str(tmp_path / "v")
    assert versions.latest(spark, folder) == (0, None)
    won, threads = [], []
    for n in range(6):
        threads.append(threading.Thread(target=lambda n=n: won.append(versions.publish(spark, folder, 1, f"é{n}"))))
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert won.count(True) >= 1 and versions.latest(spark, folder)[0] == 1
    assert not versions.publish(spark, folder, 1, "x") and versions.latest(spark, folder)[1].startswith("é")


def test_rules_survive_storage(spark, tmp_path):
    folder = str(tmp_path / "rules")
    assert stored_rules.read_rules(spark, folder) == (0, [])
    when = dt.datetime(2024, 1, 2, 3, tzinfo=dt.timezone.utc)
    stored_rules.change_rules(spark, folder, lambda rules: [*rules, *alerts.DEFAULT_RULES])
    stored_rules.change_rules(spark, folder, lambda rules: alerts.add_rule(rules, rule(1, "ü'\"", last_triggered=when)))
    version, got = stored_rules.read_rules(spark, folder)
    assert version == 2 and got == [*alerts.DEFAULT_RULES, rule(1, "ü'\"", last_triggered=when)]
    stored_rules.change_rules(spark, folder, lambda rules: alerts.remove_rule(rules, "r1"))
    assert stored_rules.read_rules(spark, folder)[1] == alerts.DEFAULT_RULES


def test_indexed_rules_equal_the_loop(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    rows = [entry(n, text(rng.randrange(12)), container=f"c{n % 3}") for n in range(120)] + [entry(500, None), entry(501, "")]
    lines = table(spark, rows).repartition(4)
    rules = [rule(n, text(rng.randrange(6)), container_id=rng.choice([None, "c1"])) for n in range(70)]
    rules += [rule(80, "abab"), rule(81, "abab"), rule(82, "zz", enabled=False)]
    results = {}
    for limit in (1_000, 1):
        monkeypatch.setattr(alerts, "INDEXED_RULES", limit)
        for some in (rules, [r for r in rules if r.pattern]):
            found = [alerts.alert_events(lines, some), alerts.alert_events(lines, some, scoped=True), alerts.alert_matches_all(lines, some)]
            results.setdefault(len(some), []).append([sorted(map(tuple, f.collect())) for f in found])
            if limit == 1:
                assert all("NestedLoop" not in plan(f) and "Cartesian" not in plan(f) for f in found)
    assert all(a == b for a, b in results.values())


@pytest.mark.parametrize("limit", [1, 3, 7, 40])
def test_pages_by_key_show_equal_rows_once(spark, limit):
    """Five and four equal lines without ids, in any page size."""
    rows = [entry(None, "a", seconds=5) for _ in range(5)] + [entry(None, "b", seconds=5) for _ in range(4)]
    rows += [entry(None, None, seconds=4)] * 2 + [entry(7, "a", seconds=5), entry(None, "a", seconds=5, level="ERROR")]
    lines = table(spark, rows).repartition(3)
    key, shown = logs.FIRST_PAGE, []
    while key:
        page = logs.log_page(lines, limit, before=key)
        shown += page.collect()
        info = logs.page_info_by_key(lines, limit, key).first()
        key = logs.next_key(page, key)
        assert info.total == len(rows) and info.has_more == (len(shown) < len(rows))
        assert (info.next_cursor is None) == (len(shown) >= len(rows))
        if info.next_cursor:
            assert logs.PageKey.of_text(info.next_cursor) == key
    assert sorted(map(str, shown)) == sorted(map(str, lines.collect()))


def test_pages_by_key_of_stored_days(spark, tmp_path):
    path = str(tmp_path / "logs")
    tables.write_logs(table(spark, [entry(None, "same", seconds=DAY * (n // 8)) for n in range(40)]), path)
    stored = tables.read_logs(spark, path)
    key, shown = logs.FIRST_PAGE, []
    while key:
        page = logs.log_page_by_day(stored, 7, before=key)
        shown += page.collect()
        key = logs.next_key(page, key)
    assert len(shown) == 40 and [r.timestamp for r in shown] == sorted((r.timestamp for r in shown), reverse=True)


@pytest.mark.parametrize("rows", [1 << 40, 10])
def test_sequences_of_a_frequent_key(spark, monkeypatch, rows):
    """Values do not depend on whether a key is cut; a cut key is spread even within one minute."""
    monkeypatch.setattr(sequence, "ROWS", rows)
    monkeypatch.setattr(sequence, "SLICES", 16)
    rng = random.Random(1)
    data = [(n, "hot" if n % 3 else f"k{n % 5}", 1_704_067_200_000 + rng.randrange(40_000), rng.randrange(9), rng.choice([None, f"v{n}"])) for n in range(600)]
    df = spark.createDataFrame(data, "id long, key string, ms long, value long, mark string")
    df = df.selectExpr("id", "key", "timestamp_millis(ms) AS timestamp", "value", "mark").repartition(5)
    got = {r.id: r for r in sequence.running_sum(df, "key", "value", "sum").collect()}
    before = {r.id: r for r in sequence.previous_row(df, "key", ["value", "mark"]).collect()}
    held = {r.id: r for r in sequence.carry_forward(df, "key", "mark", "held").collect()}
    assert len(got) == len(before) == len(held) == 600
    state = {}
    for n, key, _, value, mark in sorted(data, key=lambda r: (r[2], r[0])):
        total, last, mark_before = state.get(key, (0, (None, None), None))
        assert got[n].sum == total + value
        assert (before[n].prev_value, before[n].prev_mark) == last
        assert held[n].held == (mark if mark is not None else mark_before)
        state[key] = (total + value, (value, mark), mark if mark is not None else mark_before)
    if rows == 10:
        cut, parts = sequence._sliced(df, "key")
        per = [r["count"] for r in cut.where("key = 'hot'").groupBy("_slice").count().collect()]
        assert len(per) == 16 and max(per) < 60 and parts.select("key").distinct().count() >= 5
    else:
        text = plan(metrics.cpu_percent_from_counters(df.selectExpr("id", "timestamp", "key AS container_id", "value AS cpu_total", "value AS system_cpu", "4L AS online_cpus")))
        assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_traces_of_one_time_stay_apart(spark):
    rows = [entry(None, "Traceback (most recent call last)", seconds=1)] * 2
    rows += [entry(None, "    at a.b(c:1)", seconds=s) for s in (2, 3)]
    got = patterns.stack_traces(table(spark, rows).repartition(2)).collect()
    assert sorted(r.lines for r in got) == [1, 3]
