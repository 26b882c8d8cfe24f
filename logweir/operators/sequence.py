"""Order-dependent values per key, with one exchange of the rows.

Rows are dealt by key and a window runs over each key. A key with more than ``ROWS`` rows is cut
into slices of time that hold about equally many rows, wherever in time its rows lie; the window
then runs in each slice, and one summary row per slice, taken from the input before the exchange,
carries the state across. Key and timestamp are never null; an id may be null or repeat. Rows of
one key and instant stay in one task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.session import broadcast_if_small

ROWS = 4_000_000  # of a key, from which it is cut
SLICES = 256  # of a key that is cut

_ORDER = ["timestamp", "id"]
_SLICE = "_slice"


def _sliced(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with the slice of every row, and its rows of the keys that are cut, if any are."""
    frequent = df.groupBy(key).count().where(F.col("count") > ROWS).select(key)
    if frequent.isEmpty():
        return df.withColumn(_SLICE, F.lit(0)), None
    frequent = broadcast_if_small(frequent)
    micros = F.unix_micros("timestamp")
    shares = F.array(*[F.lit(n / SLICES) for n in range(1, SLICES)])
    cuts = (
        df.join(frequent, key, "left_semi")
        .groupBy(key)
        .agg(F.array_distinct(F.percentile_approx(micros, shares, 10 * SLICES)).alias("_cuts"))
    )
    cut = df.join(broadcast_if_small(cuts), key, "left")
    place = F.size(F.filter("_cuts", lambda at: at < micros))
    cut = cut.withColumn(_SLICE, F.when(F.col("_cuts").isNull(), 0).otherwise(place))
    return cut.drop("_cuts"), cut.where("_cuts IS NOT NULL").drop("_cuts")


def _carried(parts: DataFrame, key: str, state: Column, over) -> DataFrame:
    """(key, slice, _state): ``over`` of the states of the key's earlier slices, for keys that are cut."""
    before = Window.partitionBy(key).orderBy(_SLICE)
    summary = parts.groupBy(key, _SLICE).agg(state.alias("_state"))
    return broadcast_if_small(summary.select(key, _SLICE, over("_state", before).alias("_state")))


def _up_to_here(key: str):
    inside = Window.partitionBy(key, _SLICE).orderBy(*_ORDER)
    return inside, inside.rowsBetween(Window.unboundedPreceding, 0)


def _earlier(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the key's rows up to this one, in order of (timestamp, id)."""
    cut, parts = _sliced(df, key)
    _, so_far = _up_to_here(key)
    summed = F.sum(value).over(so_far)
    if parts is None:
        return cut.withColumn(out, summed).select(*df.columns, out)
    carried = _carried(parts, key, F.sum(value), lambda s, w: F.sum(s).over(_earlier(w)))
    both = cut.withColumn("_inside", summed).join(carried, [key, _SLICE], "left")
    return both.select(*df.columns, (F.coalesce("_state", F.lit(0)) + F.col("_inside")).alias(out))


def previous_row(df: DataFrame, key: str, columns: list[str], prefix: str = "prev_") -> DataFrame:
    """``columns`` of the key's row before this one, in order of (timestamp, id), or null."""
    cut, parts = _sliced(df, key)
    inside, _ = _up_to_here(key)
    wanted = F.struct(*columns)
    before = F.lag(wanted).over(inside)
    if parts is None:
        found = cut.withColumn("_before", before)
    else:
        last = F.max_by(wanted, F.struct(*_ORDER))
        carried = _carried(parts, key, last, lambda s, w: F.lag(s).over(w))
        marked = cut.withColumn("_lag", before).withColumn("_first", F.row_number().over(inside) == 1)
        found = marked.join(carried, [key, _SLICE], "left").withColumn(
            "_before", F.when(F.col("_first"), F.col("_state")).otherwise(F.col("_lag"))
        )
    return found.select(*df.columns, *[F.col(f"_before.{c}").alias(f"{prefix}{c}") for c in columns])


def carry_forward(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """The key's latest non-null ``value`` up to this row, in order of (timestamp, id)."""
    cut, parts = _sliced(df, key)
    _, so_far = _up_to_here(key)
    latest = F.last(value, ignorenulls=True).over(so_far)
    if parts is None:
        return cut.withColumn(out, latest).select(*df.columns, out)
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*_ORDER)))
    carried = _carried(
        parts, key, last, lambda s, w: F.last(s, ignorenulls=True).over(_earlier(w))
    )
    both = cut.withColumn("_inside", latest).join(carried, [key, _SLICE], "left")
    return both.select(*df.columns, F.coalesce("_inside", "_state").alias(out))
