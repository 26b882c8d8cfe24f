"""Container metrics: rows from samples or raw counters, latest values, summaries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.functions import resources
from logweir.functions.clock import to_millis
from logweir.functions.container import stack_of, strip_slashes
from logweir.operators.sequence import previous_row
from logweir.sources.tables import newest_days

# Rows of a metric lookup.
DEFAULT_LIMIT = 100


def metric_samples(samples: DataFrame) -> DataFrame:
    """Samples with their CPU and memory share and their bytes over all interfaces."""
    cpu = resources.cpu_percent(
        "cpu_total", "precpu_total", "system_cpu", "presystem_cpu", "online_cpus"
    )
    return samples.selectExpr(
        "id",
        "timestamp",
        "container_id",
        f"{strip_slashes('name')} AS container_name",
        f"{cpu} AS cpu_percent",
        "coalesce(memory_usage, 0L) AS memory_usage",
        "coalesce(memory_limit, 1L) AS memory_limit",
        f"{resources.memory_percent('memory_usage', 'memory_limit')} AS memory_percent",
        f"{resources.network_total('networks', 'rx_bytes')} AS network_rx",
        f"{resources.network_total('networks', 'tx_bytes')} AS network_tx",
        "block_read",
        "block_write",
    )


def metric_rows(samples: DataFrame) -> DataFrame:
    """Rows of the metric table from samples; percentages narrow to single precision."""
    return encode_metrics(metric_samples(samples))


def encode_metrics(metrics: DataFrame) -> DataFrame:
    """Rows ready to store: whole milliseconds, id 0 where missing, stored types."""
    return metrics.selectExpr(
        "coalesce(id, 0L) AS id",
        f"{to_millis('timestamp')} AS timestamp",
        "container_id",
        "container_name",
        "float(cpu_percent) AS cpu_percent",
        "float(memory_percent) AS memory_percent",
        "memory_usage",
        "network_rx",
        "network_tx",
        "block_read",
        "block_write",
    )


def metric_latest(
    metrics: DataFrame, container_id: str | None = None, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """The newest metric rows, of one container if given."""
    if container_id is not None:
        metrics = metrics.filter(F.col("container_id") == container_id)
    return metrics.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def metric_latest_by_day(
    metrics: DataFrame, container_id: str | None = None, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """The rows of :func:`metric_latest`, reading only the days that hold them."""
    if container_id is not None:
        metrics = metrics.filter(F.col("container_id") == container_id)
    days, _ = newest_days(metrics, 0, limit)
    return metric_latest(days, limit=limit)


def cpu_percent_from_counters(counters: DataFrame) -> DataFrame:
    """CPU share from cumulative counters; a container's first sample has none."""
    paired = previous_row(counters, "container_id", ["cpu_total", "system_cpu"])
    cpu = resources.cpu_percent(
        "cpu_total", "prev_cpu_total", "system_cpu", "prev_system_cpu", "online_cpus"
    )
    return paired.filter("prev_cpu_total IS NOT NULL").selectExpr(
        "id", "timestamp", "container_id", f"{cpu} AS cpu_percent"
    )


# Figures per group of metric rows.
_FIGURES = [
    "count(*) AS samples",
    "avg(cpu_percent) AS cpu_avg",
    "max(cpu_percent) AS cpu_max",
    "min(cpu_percent) AS cpu_min",
    "avg(memory_usage) AS memory_avg",
    "max(memory_usage) AS memory_max",
    "min(memory_usage) AS memory_min",
]


def metric_summary(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("container_id").agg(*map(F.expr, _FIGURES))


def metric_by_stack(metrics: DataFrame, containers: DataFrame) -> DataFrame:
    """CPU and memory figures per labelled stack.

    Samples shrink to one row per container before they meet the containers.
    """
    per_container = metrics.groupBy("container_id").agg(
        F.expr("count(*) AS samples"),
        F.expr("sum(cpu_percent) AS cpu_sum"),
        F.expr("max(cpu_percent) AS cpu_max"),
        F.expr("sum(memory_usage) AS memory_sum"),
        F.expr("max(memory_usage) AS memory_max"),
    )
    stacks = containers.selectExpr("id AS container_id", f"{stack_of('labels')} AS stack")
    return (
        per_container.join(stacks.filter("stack IS NOT NULL"), "container_id")
        .groupBy("stack")
        .agg(
            F.expr("sum(samples) AS samples"),
            F.expr("sum(cpu_sum) / sum(samples) AS cpu_avg"),
            F.expr("max(cpu_max) AS cpu_max"),
            F.expr("sum(memory_sum) / sum(samples) AS memory_avg"),
            F.expr("max(memory_max) AS memory_max"),
        )
    )


def metric_history(metrics: DataFrame, width: str = "5 minutes") -> DataFrame:
    """The same figures per container and time slot."""
    return (
        metrics.groupBy(F.window("timestamp", width).alias("slot"), "container_id")
        .agg(*map(F.expr, _FIGURES))
        .select(F.col("slot.start").alias("slot_start"), "*")
        .drop("slot")
    )
