"""What log lines take from a container snapshot."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.functions.container import stack_of


@dataclass(frozen=True)
class Attributes:
    """What lines take from a snapshot, one row a container: (container_id, _name, _stack).

    ``small`` says that the rows were measured and may be broadcast.
    """

    rows: DataFrame
    small: bool


def container_attributes(containers: DataFrame) -> DataFrame:
    """(container_id, _name, _stack) of every container of a snapshot.

    Of a container listed more than once the newest listing counts, by ``listed_at`` where the
    snapshot has it, so that no line is multiplied.
    """
    listed = "listed_at" if "listed_at" in containers.columns else "CAST(null AS timestamp)"
    return (
        containers.selectExpr(
            "id AS container_id",
            f"struct({listed} AS at, name AS _name, {stack_of('labels')} AS _stack) AS listing",
        )
        .groupBy("container_id")
        .agg(F.max("listing").alias("listing"))
        .selectExpr("container_id", "listing._name", "listing._stack")
    )
