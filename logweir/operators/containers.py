"""Container snapshots: projection, filters and roll-up by stack."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.functions.container import is_up, stack_of, strip_slashes


def project_listing(listing: DataFrame) -> DataFrame:
    """Snapshot rows from a daemon's listing, with '' and 0 for what it leaves out."""
    # Port types print in upper case, and an empty one as EMPTY.
    kind = "coalesce(CASE WHEN p.port_type = '' THEN 'EMPTY' ELSE upper(p.port_type) END, '')"
    port = (
        "named_struct('private_port', p.private_port, 'public_port', p.public_port, "
        f"'port_type', {kind})"
    )
    return listing.selectExpr(
        "coalesce(id, '') AS id",
        f"coalesce({strip_slashes('get(names, 0)')}, '') AS name",
        "coalesce(image, '') AS image",
        "coalesce(status, '') AS status",
        "coalesce(created, 0L) AS created",
        "coalesce(labels, CAST(map() AS map<string, string>)) AS labels",
        f"coalesce(transform(ports, p -> {port}), array()) AS ports",
    )


def filter_containers(
    containers: DataFrame,
    stack: str | None = None,
    status: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """Containers that pass every given filter.

    ``status`` is ``running`` or ``stopped`` in any case; other values filter nothing.
    ``search`` is a substring of name or image in any case.
    """
    if stack is not None:
        containers = containers.filter(F.expr(stack_of("labels")) == stack)
    wanted = (status or "").lower()
    if wanted == "running":
        containers = containers.filter(is_up("status"))
    elif wanted == "stopped":
        containers = containers.filter(f"NOT {is_up('status')}")
    if search is not None:
        text = search.lower()
        containers = containers.filter(
            F.lower("name").contains(text) | F.lower("image").contains(text)
        )
    return containers


def stack_rollup(containers: DataFrame) -> DataFrame:
    """Containers in all, running and stopped, per labelled stack."""
    return (
        containers.selectExpr(f"{stack_of('labels')} AS name", f"{is_up('status')} AS up")
        .filter("name IS NOT NULL")
        .groupBy("name")
        .agg(
            F.expr("count(*) AS container_count"),
            F.expr("count_if(up) AS running_count"),
            F.expr("count_if(NOT up) AS stopped_count"),
        )
    )
