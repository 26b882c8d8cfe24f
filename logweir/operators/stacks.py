"""Compose stacks from compose file text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions import compose
from logweir.session import broadcast_if_small

# Path patterns left out by default, and file names, the preferred one first.
DEFAULT_EXCLUDES = ["**/node_modules/**", "**/dist/**", "**/target/**"]
COMPOSE_NAMES = ["docker-compose.yml", "docker-compose.yaml"]


def _excluded(path: Column, patterns: list[str]) -> Column:
    """Whether the text of a pattern, without its stars, is a run of whole path segments."""
    hit = F.lit(False)
    for pattern in patterns:
        segment = pattern.replace("**", "").strip("/")
        if segment:
            hit = hit | F.concat(path, F.lit("/")).contains(f"/{segment}/")
    return hit


def compose_stacks(
    files: DataFrame, excludes: list[str] = DEFAULT_EXCLUDES, loose: bool = False
) -> DataFrame:
    """One stack per folder with a compose file, in path order.

    ``files`` holds (path, content). A stack inside another stack's folder is left out.
    ``loose`` takes every two-space line with a colon for a service.
    """
    found = (
        files.selectExpr(
            "regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder",
            "substring_index(path, '/', -1) AS file",
            "content",
        )
        .filter(F.col("file").isin(COMPOSE_NAMES))
        .filter(~_excluded(F.col("folder"), excludes))
        .groupBy("folder")
        .agg(F.min_by("content", F.col("file") != COMPOSE_NAMES[0]).alias("content"))
    )
    parts = "split(folder, '/')"
    above = (
        f"transform(sequence(1, size({parts}) - 1), n -> array_join(slice({parts}, 1, n), '/'))"
    )
    nested = (
        found.selectExpr("folder", f"explode({above}) AS above")
        .join(found.selectExpr("folder AS above"), "above", "left_semi")
        .select("folder")
    )
    services = compose.services_loose if loose else compose.services
    return (
        found.join(nested, "folder", "left_anti")
        .selectExpr(
            "md5(folder) AS id",
            "substring_index(folder, '/', -1) AS name",
            "folder AS path",
            "substring_index(folder, '/', -1) AS project_name",
            f"{services('content')} AS containers",
            "false AS enabled",
        )
        .orderBy("path")
    )


def enabled_logs(logs: DataFrame, stacks: DataFrame) -> DataFrame:
    """Logs of the stacks that are switched on."""
    names = stacks.filter("enabled").select(F.col("project_name").alias("compose_project"))
    return logs.join(broadcast_if_small(names.distinct()), "compose_project", "left_semi")
