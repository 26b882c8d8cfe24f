"""Time the headline queries and print one JSON line.

Each query is rebuilt and run to its last row in several rounds over all of them; after the
warm-up rounds the median counts. Reads ``BENCH_SF_DIR`` and ``BENCH_CPUS``. Then ``BENCH_LINES`` lines
(10 million unless set), derived from the events with later times, are landed as files, ingested by the
stream, sealed, and queried as a stored table: the figures under ``stored``, in seconds.
"""

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from logweir import schemas
from logweir.operators import logs
from logweir.plans.catalog import CATALOG
from logweir.session import scratch_path, session_builder
from logweir.sources import event_views as views
from logweir.sources import sealed, tables
from logweir.streaming import jobs

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM_UP, TIMED = 2, 3

HEADLINE = [
    "stack_levels",
    "logs_search",
    "logs_by_container",
    "log_page",
    "log_page_by_stack",
    "log_page_info",
    "log_stats",
    "log_stats_by_container",
    "level_distribution",
    "extract_level",
    "pattern_tags",
    "pattern_counts",
    "auto_filters",
    "alert_events",
    "alert_stats",
    "stack_rollup",
    "logs_semi_stack",
    "log_enrich",
    "container_tail",
    "log_dedup",
    "compose_stacks",
    "metric_rows",
    "metric_latest",
    "metric_history",
    "cpu_percent_lag",
    "log_write_roundtrip",
    "export_json",
    "stream_ingest",
    "stream_pattern_counts",
]


def timed(run, spark) -> float:
    start = time.perf_counter()
    run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


LINES = int(os.environ.get("BENCH_LINES", "10000000"))
FILES = 64


def stored(spark) -> dict:
    """Ingest, upkeep and queries of a stored table of many lines."""
    landed, snapshot, path = (scratch_path(spark, n) for n in ("landed", "snapshot", "stored"))
    events = views.read_events(spark, SF_DIR)
    n = events.count()
    copies = spark.range(-(-LINES // n)).withColumnRenamed("id", "copy")
    # Each copy is an hour later; one line in fifty has a text of its own.
    many = events.crossJoin(F.broadcast(copies)).repartition(FILES)
    lines = views.raw_lines(
        many.withColumns(
            {
                "event_id": F.expr(f"event_id + copy * {n}"),
                "ts": F.expr("ts + make_dt_interval(0, int(copy))"),
            }
        )
    )
    unique = F.concat("line", F.lit(" request "), F.sha2(F.col("id").cast("string"), 224))
    lines = lines.withColumn("line", F.when(F.col("id") % 50 == 0, unique).otherwise(F.col("line")))
    lines.write.parquet(landed)
    tables.publish_containers(views.containers(events), snapshot)
    out = {}

    def clock(name, run):
        start = time.perf_counter()
        result = run()
        out[name] = round(time.perf_counter() - start, 3)
        return result

    def ingest():
        jobs.ingest_logs(
            tables.stream_rows(spark, landed, schemas.RAW_LINES, files_per_batch=FILES // 4),
            lambda session: tables.read_attributes(session, snapshot),
            path,
            scratch_path(spark, "checkpoint"),
            {"availableNow": True},
        ).awaitTermination()

    clock("ingest", ingest)
    rows = tables.read_logs(spark, path)
    out["lines"] = rows.count()
    out["ingest_lines_per_sec"] = round(out["lines"] / out["ingest"])
    newest = rows.agg(F.max(schemas.DAY)).first()[0]
    needle = rows.where("id % 50 = 0").select(F.substring_index("message", " ", -1)).first()[0]
    out["days_sealed"] = len(clock("seal", lambda: sealed.seal(spark, path, schemas.LOGS, newest)))
    read = lambda: tables.read_logs(spark, path)
    middle = rows.agg(F.expr("percentile_approx(timestamp, 0.5)")).first()[0]
    queries = {
        "page_newest": lambda: logs.log_page_by_day(read(), 100).collect(),
        "page_errors_before": lambda: logs.log_page_by_day(read(), 100, before=(middle, None), level="error").collect(),
        "page_of_container": lambda: logs.log_page_by_day(read(), 100, container_id="c7").collect(),
        "search_indexed": lambda: logs.filter_logs(sealed.read_with_text(spark, path, needle), search=needle).collect(),
        "search_full_scan": lambda: logs.filter_logs(read(), search=needle).collect(),
        "stats_from_counts": lambda: logs.stats_of_counts(sealed.counts(spark, path)).collect(),
        "stats_full_scan": lambda: logs.log_stats(read()).collect(),
    }
    for name, run in queries.items():
        run()
        clock(name, run)
    return out


def main() -> None:
    spark = (
        session_builder("bench")
        .master(f"local[{CPUS}]")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    lines = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    rounds = [
        {name: timed(CATALOG[name].run, spark) for name in HEADLINE} for _ in range(WARM_UP + TIMED)
    ]
    seconds = {
        name: round(statistics.median(r[name] for r in rounds[WARM_UP:]), 4) for name in HEADLINE
    }
    kept = stored(spark) if LINES else {}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "log_lines": lines,
                "ingest_lines_per_sec": kept.get("ingest_lines_per_sec", round(lines / seconds["stream_ingest"])),
                "stored": kept,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
