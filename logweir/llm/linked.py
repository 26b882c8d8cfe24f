"""Connected components of edges, by alternating star contractions."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.shares import written


CHUNK = 1 << 20  # edges that a task contracts at a time


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges but the smallest of its component, and that smallest node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        one, two = label[x], label[y]
        open_ = one != two
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(label, np.maximum(one, two)[open_], np.minimum(one, two)[open_])
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def contract(parts):
    """The edges of a task as stars around their smallest nodes, ``CHUNK`` edges at a time."""
    held, rows = [], 0

    def stars():
        a, b = contracted(*(np.concatenate([h[k] for h in held]) for k in range(2)))
        return pa.RecordBatch.from_pydict({"a": a, "b": b})

    for part in parts:
        held.append([part.column(k).to_numpy() for k in range(2)])
        rows += part.num_rows
        if rows >= CHUNK:
            yield stars()
            held, rows = [], 0
    if rows:
        yield stars()


def _settled(now: DataFrame) -> bool:
    """True if all edges (a, b) are stars: every a has one b, and no b is an a."""
    up = now.selectExpr("a AS node", "1 AS up", "0 AS down")
    ends = up.unionByName(now.selectExpr("b AS node", "0 AS up", "1 AS down"))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.where("up > 1 OR up = 1 AND down = 1").agg(F.count("*")).first()[0]


def components(edges: DataFrame, within: bool = False) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for every node in them.

    Tasks first contract the edges they hold, which leaves a node at most one edge a chunk, and then
    those of the nodes dealt to them. Each round joins neighbours to the smallest neighbour,
    first the larger ones and then the smaller ones, until all edges are stars; rounds grow with the
    logarithm of the longest path. Minima are combined before the shuffle. With ``within`` the tasks that
    made the edges have contracted them (by :func:`contract`): a task that runs two Python functions one
    after the other holds two Python workers.
    """
    ends = edges.where("a <> b").selectExpr("CAST(a AS long) AS a", "CAST(b AS long) AS b")
    own = (ends if within else ends.mapInArrow(contract, "a long, b long")).repartition("a")
    now = written(own.mapInArrow(contract, "a long, b long").distinct(), "edges")
    while not _settled(now):
        both = now.unionByName(now.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.where("b > a").join(least, "a").selectExpr("b AS a", "least AS b").where("a <> b")
        large = written(large.distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (
            large.join(low, "a").where("b <> least").selectExpr("b AS a", "least AS b")
            .unionByName(low.selectExpr("a", "least AS b"))
        )
        now = written(small.distinct(), "small-star")
    return now.selectExpr("a AS node", "b AS component").unionByName(
        now.selectExpr("b AS node", "b AS component").distinct()
    )
