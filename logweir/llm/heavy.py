"""Left joins whose frequent keys are joined in place and whose other keys are shuffled."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.session import broadcast_if_small

SHARE = 1_000  # a key that weighs more than one part in this many is frequent


def join_heavy(left: DataFrame, right: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``left`` with the columns of ``right`` but ``weight``, null where no key matches.

    ``right`` has one row a key and says in ``weight`` how many rows of ``left`` to expect for it. At
    most ``SHARE`` keys are frequent, so their rows can be broadcast (once measured) and the rows
    of ``left`` that have them are never dealt by key. ``left`` is read twice.
    """
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    frequent = F.col(weight) > total / SHARE
    hot, cold = right.where(frequent).drop(weight), right.where(~frequent).drop(weight)
    hot_keys = broadcast_if_small(hot.select(*keys))
    there = left.join(broadcast_if_small(hot), keys)
    rest = left.join(hot_keys, keys, "left_anti").join(cold, keys, "left")
    return there.unionByName(rest)
