"""Sequences of bounded length packed from documents by a configuration linear program.

A configuration is a multiset of piece lengths that fits into one sequence. The program asks for the
least number of configurations that cover the histogram of lengths, which has at most one
entry per length whatever the corpus. Multiplicative weights solve it: prices per length rise where
too little is covered, and a knapsack dynamic program over the capacity finds for every length the
best configuration at these prices. The fractional solution is rounded down to what the
histogram holds, and pieces left over are placed best-fit by their lengths. Executors then number the
pieces of each length and look their place up in the plan.
"""

import bisect
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm import batches, byte_bpe
from logweir.llm.shares import written

ROUNDS = 200
SLACK = 0.9999  # of the best configuration's worth; looser ones are left to best-fit


def _knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for every room up to ``capacity``, and the length placed first (0: none)."""
    value, first = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        choice = prices[1 : room + 1] + value[room - 1 :: -1][:room]
        best = int(choice.argmax())
        if choice[best] > value[room - 1]:
            value[room], first[room] = choice[best], best + 1
        else:
            value[room], first[room] = value[room - 1], 0
    return value, first


def _filled(first: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        if first[room]:
            out.append(int(first[room]))
            room -= first[room]
        else:
            room -= 1
    return out


def fractional(histogram: np.ndarray, rounds: int = ROUNDS):
    """Configurations with amounts that about cover the histogram, how tight each is, a lower bound.

    A configuration's tightness is its worth at the prices that gave the best bound, 1 for the best.
    ``histogram[n]`` is the number of pieces of length n; its last index is the capacity.
    """
    capacity = len(histogram) - 1
    here = np.flatnonzero(histogram)
    prices = np.zeros(capacity + 1)
    prices[here] = here / capacity
    amounts: Counter = Counter()
    bound, size = 0.0, float((histogram * np.arange(capacity + 1)).sum()) / capacity
    for turn in range(rounds):
        value, first = _knapsack(prices, capacity)
        now = float((prices * histogram).sum()) / value[capacity]
        if now > bound:
            bound, tight = now, prices / value[capacity]
        # The best configuration that holds each length, weighted by how near it is to the best.
        with_it = prices[here] + value[capacity - here]
        weight = histogram[here] * np.exp(40 * (with_it / value[capacity] - 1))
        weight *= max(bound, size) / weight.sum()
        covered = np.zeros(capacity + 1)
        for length, amount in zip(here.tolist(), weight):
            own = tuple(sorted([length, *_filled(first, capacity - length)], reverse=True))
            amounts[own] += amount / rounds
            for n in own:
                covered[n] += amount
        short = 1 - covered[here] / histogram[here]
        prices[here] *= np.exp(np.clip(short, -1, 1) * 0.3 / math.sqrt(turn + 1))
    return {own: (n, float(tight[list(own)].sum())) for own, n in amounts.items()}, bound


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how often each is used; together they hold exactly the histogram."""
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out: Counter = Counter()
    if left[capacity]:
        out[(capacity,)] += int(left[capacity])
        left[capacity] = 0
    if left.any():
        amounts, _ = fractional(left)
        full = sorted(amounts.items(), key=lambda x: (-round(x[1][1], 4), -x[1][0], x[0]))
        for least, up in ((SLACK, 0), (1 - (1 - SLACK) / 4, 1)):  # whole parts, then one more
            for own, (amount, tightness) in full:
                if tightness < least:
                    break
                need = Counter(own)
                used = min(int(amount) + up, *(int(left[n]) // k for n, k in need.items()))
                if used:
                    out[own] += used
                    for n, k in need.items():
                        left[n] -= k * used
    for own, used in _best_fit(left, capacity).items():
        out[own] += used
    return sorted(out.items())


def _best_fit(left: np.ndarray, capacity: int) -> Counter:
    """Best-fit decreasing on a histogram: equal bins and equal lengths are handled together."""
    rooms: dict[int, Counter] = {}  # room left -> configurations with it
    order: list[int] = []  # rooms that occur, ascending
    left = left.copy()

    def put(room, own, n):
        if room not in rooms:
            rooms[room] = Counter()
            bisect.insort(order, room)
        rooms[room][own] += n

    for length in range(capacity, 0, -1):
        while left[length]:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                each = capacity // length  # empty bins, filled with as many as fit
                bins = int(left[length]) // each
                if bins:
                    put(capacity - each * length, (length,) * each, bins)
                    left[length] -= bins * each
                if left[length]:
                    rest = int(left[length])
                    put(capacity - rest * length, (length,) * rest, 1)
                    left[length] = 0
                continue
            room = order[at]
            own, n = next(iter(rooms[room].items()))
            used = min(n, int(left[length]))
            rooms[room][own] -= used
            if not rooms[room][own]:
                del rooms[room][own]
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            put(room - length, (*own, length), used)
            left[length] -= used
    return sum((c for c in rooms.values()), Counter())


def segments(plan_: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence, copies, offset): where pieces of a length go by rank."""
    out, taken, sequence = [], Counter(), 0
    for own, used in plan_:
        offset = 0
        for length, copies in sorted(Counter(own).items(), reverse=True):
            out.append((length, taken[length], sequence, copies, offset))
            taken[length] += copies * used
            offset += copies * length
        sequence += used
    return np.array(sorted(out), np.int64).reshape(-1, 5)


PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece, numbered among the pieces of its length in its input task."""

    def cut(parts):
        encode = byte_bpe.encoder(tokenizer).encode
        part_id, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part in batches.slices(parts):
            ids, counts = encode(part.column("text"))
            out = []
            for doc, own in zip(part.column("doc_id").to_pylist(), np.split(ids, np.cumsum(counts)[:-1])):
                own = np.append(own, np.uint32(end_id)).astype("<u4")
                short = len(own) % capacity
                edges = ([0] if short else []) + list(range(short, len(own) + 1, capacity))
                for n, (s, e) in enumerate(zip(edges, edges[1:])):
                    out.append((doc, n, s, e - s, zlib.crc32(own[s:e].tobytes()), part_id, seen[e - s]))
                    seen[e - s] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema
            )

    long = pa.int64()
    schema = pa.schema(
        [("doc_id", long), ("piece", pa.int32()), ("start", long), ("length", long)]
        + [("ids_crc32", long), ("part", pa.int32()), ("nth", long)]
    )
    return docs.mapInArrow(cut, PIECES)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = 1024,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents longer than ``capacity`` are cut, into pieces of ``capacity`` ids, of which the
    first may be shorter. A null or empty text is the end id alone. Repeated rows are packed as
    often as they occur and null ids like others; an empty table gives no rows. The plan lives on the
    driver and has a bound that does not depend on the corpus: lengths up to ``capacity``.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cut = written(pieces(rows, tokenizer, end_id, capacity), "pieces")
    per_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = written(
        per_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts"
    )
    histogram = np.zeros(capacity + 1, np.int64)
    for r in based.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        histogram[r.length] = r.n
    where = segments(plan(histogram))

    def place(parts):
        length, first, sequence, copies, offset = where.T
        keys = length * (1 << 40) + first
        for part in parts:
            own = part.column("length").to_numpy()
            rank = part.column("base").to_numpy() + part.column("nth").to_numpy()
            at = np.searchsorted(keys, own * (1 << 40) + rank, "right") - 1
            nth = rank - first[at]
            yield pa.RecordBatch.from_pydict(
                {
                    **{c: part.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")},
                    "sequence_id": sequence[at] + nth // copies[at],
                    "offset": offset[at] + nth % copies[at] * own,
                }
            )

    ranked = cut.join(based.select("part", "length", "base"), ["part", "length"])
    return ranked.mapInArrow(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
