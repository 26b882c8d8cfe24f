"""Exports of filtered logs as JSON and CSV."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.functions.clock import rfc3339
from logweir.functions.levels import display_level

# Exported CSV columns, in order.
CSV_COLUMNS = ["timestamp", "container_name", "container_id", "level", "message"]

JSON_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *[
            T.StructField(name, T.StringType())
            for name in [
                "timestamp",
                "container_id",
                "container_name",
                "compose_project",
                "compose_file",
                "message",
                "level",
                "source",
                "metadata",
            ]
        ],
    ]
)
CSV_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in CSV_COLUMNS])


def display_rows(logs: DataFrame) -> DataFrame:
    """Log rows as clients see them: time as text, mixed-case names, empty metadata null."""
    return logs.selectExpr(
        "id",
        f"{rfc3339('timestamp')} AS timestamp",
        "container_id",
        "container_name",
        "compose_project",
        "compose_file",
        "message",
        f"{display_level('level')} AS level",
        "initcap(source) AS source",
        "nullif(metadata, '') AS metadata",
    )


def as_json(logs: DataFrame) -> DataFrame:
    """One JSON text per log row, nulls included."""
    rows = display_rows(logs)
    return rows.select(
        F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")
    )


def export_json(logs: DataFrame, path: str) -> None:
    """Write one JSON object per line; one large array could be neither split nor appended."""
    display_rows(logs).write.option("ignoreNullFields", False).json(path)


def read_json_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JSON_SCHEMA).json(path)


def export_csv(logs: DataFrame, path: str) -> None:
    """Write the five CSV columns, every value quoted and quotes doubled."""
    rows = display_rows(logs).selectExpr(*[f"coalesce({c}, '') AS {c}" for c in CSV_COLUMNS])
    (
        rows.write.option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )


def read_csv_export(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(CSV_SCHEMA)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", "\u0000")
        .csv(path)
    )
