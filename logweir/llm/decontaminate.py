"""Benchmark decontamination by greedy string tiling.

Words of a document that start a run of ``SEED`` words of some benchmark item are seeds. For each
document and item that share seeds, tiling marks the longest common run of unmarked words again
and again, found by rolling fingerprints from long to short, until none of ``SEED`` words is
left. An item whose words are covered by tiles to ``coverage`` or more is contained in the
document, in whatever order its passages stand.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm import batches

SEED = 5  # words; an item with fewer is one seed as a whole
COVERAGE = 0.6
BLOCK_BYTES = 32 << 20  # benchmark text held by a task at a time


@dataclass
class Items:
    """A block of the benchmark: words of all items and their seeds, sorted."""

    ids: list
    names: np.ndarray
    first: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> sorted seed names, their items


def items_of(ids: list, texts: list) -> Items:
    w = batches.words(pa.array(texts, pa.large_string()), lower=True)
    rows = w.row_of_word()
    sizes = np.diff(w.first)
    seeds = {}
    for length in range(1, SEED + 1):
        at, names = batches.windows(w, length)
        own = rows[at]
        fits = sizes[own] == length if length < SEED else np.ones(len(own), bool)
        pairs = np.unique(np.stack((names[fits], own[fits].astype(np.uint64)), 1), axis=0)
        if len(pairs):
            seeds[length] = (np.ascontiguousarray(pairs[:, 0]), pairs[:, 1].astype(np.int64))
    return Items(ids, w.names, w.first, seeds)


def tiles(document: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in document, place in item, length), longest first.

    Fingerprints of all runs of a length are compared at once; lengths fall from the longest
    possible, and after each tile its words are marked on both sides.
    """
    free_d, free_i = np.ones(len(document), bool), np.ones(len(item), bool)
    rolling_d, rolling_i = batches.Rolling(document), batches.Rolling(item)
    out = []
    length = min(len(document), len(item))

    def common(length):
        """Places of unmarked runs of the length in the document and the item that are equal."""
        taken_d = np.concatenate(([0], np.cumsum(~free_d)))
        taken_i = np.concatenate(([0], np.cumsum(~free_i)))
        at_d, at_i = np.arange(len(document) - length + 1), np.arange(len(item) - length + 1)
        at_d = at_d[taken_d[at_d + length] == taken_d[at_d]]
        at_i = at_i[taken_i[at_i + length] == taken_i[at_i]]
        name_d, name_i = rolling_d.of(at_d, at_d + length), rolling_i.of(at_i, at_i + length)
        hit = np.isin(name_d, name_i)
        return at_d[hit], name_d[hit], at_i, name_i

    while length >= least:
        # The longest length with a common run: a run of n words holds runs of every shorter length.
        low, high = least - 1, length
        while low < high:
            middle = (low + high + 1) // 2
            if len(common(middle)[0]):
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        length = low
        at_d, name_d, at_i, name_i = common(length)
        for d, name in zip(at_d.tolist(), name_d):
            if not free_d[d : d + length].all():
                continue
            for i in at_i[name_i == name].tolist():
                if free_i[i : i + length].all():
                    free_d[d : d + length] = False
                    free_i[i : i + length] = False
                    out.append((d, i, length))
                    break
    return out


def _matches(w: batches.Words, items: Items, coverage: float):
    """(row, item, tiles, words covered, words of the item) of contained items."""
    rows = w.row_of_word()
    hits = []
    for length, (names, own) in items.seeds.items():
        at, found = batches.windows(w, length)
        low, high = np.searchsorted(names, found, "left"), np.searchsorted(names, found, "right")
        hit = np.flatnonzero(high > low)
        counts = (high - low)[hit]
        item = own[batches.gather(low[hit], counts)]
        place = np.repeat(at[hit], counts)
        hits.append(np.stack((rows[place], item, place, np.full(len(place), length)), 1))
    hits = np.concatenate(hits) if hits else np.zeros((0, 4), np.int64)
    if not len(hits):
        return
    hits = hits[np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))]
    change = np.flatnonzero((np.diff(hits[:, 0]) != 0) | (np.diff(hits[:, 1]) != 0)) + 1
    for group in np.split(hits, change):
        row, item, length = group[0, 0], group[0, 1], group[0, 3]
        own = items.names[items.first[item] : items.first[item + 1]]
        # Every common run is made of seeds, so only words under seeds are tiled; a gap keeps
        # runs apart.
        under = np.unique(group[:, 2][:, None] + np.arange(length))
        gaps = np.flatnonzero(np.diff(under) > 1) + 1
        parts = []
        for n, run in enumerate(np.split(w.names[under], gaps)):
            parts += [run, np.array([batches._FULL - n], np.uint64)]
        found = tiles(np.concatenate(parts), own, int(min(SEED, len(own))))
        covered = sum(t[2] for t in found)
        if covered >= coverage * len(own):
            yield int(row), int(item), len(found), covered, len(own)


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> list[int]:
    """Number of blocks of about ``BLOCK_BYTES`` of benchmark text."""
    size = benchmark.agg(F.sum(F.octet_length(text) + 64)).first()[0] or 0
    return list(range(-(-size // BLOCK_BYTES)))


MATCHES = "doc_id long, item_id long, n_tiles long, words_covered long, item_words long, coverage double"


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    coverage: float = COVERAGE,
    text: str = "text",
    doc_id: str = "doc_id",
    item_id: str = "item_id",
) -> DataFrame:
    """One row per document and benchmark item that it contains.

    Words are compared after lower-casing A to Z. The benchmark is the stated query set: it is
    held in blocks of ``BLOCK_BYTES`` of text, and each block meets all documents in one pass without
    a shuffle. Null and empty texts contain nothing and are contained in nothing; repeated
    documents each give their rows, repeated items too; empty tables give no rows.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    items = items.where("text is not null")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = _blocks(items, "item_id", "text")
    out = None
    for block in blocks:
        # one block: BLOCK_BYTES of text on average
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(len(blocks))) == block)
        held = sorted((r.item_id is None, r.item_id or 0, r.item_id, r.text) for r in mine.collect())
        # read in each worker through Spark's own broadcast, not copied with every task
        shared = docs.sparkSession.sparkContext.broadcast(([h[2] for h in held], [h[3] for h in held]))

        def match(parts, shared=shared):
            own = items_of(*shared.value)
            for part in batches.slices(parts):
                w = batches.words(part.column("text"), lower=True)
                found = list(_matches(w, own, coverage))
                ids = part.column("doc_id").to_pylist()
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([ids[f[0]] for f in found], pa.int64()),
                        "item_id": pa.array([own.ids[f[1]] for f in found], pa.int64()),
                        "n_tiles": pa.array([f[2] for f in found], pa.int64()),
                        "words_covered": pa.array([f[3] for f in found], pa.int64()),
                        "item_words": pa.array([f[4] for f in found], pa.int64()),
                        "coverage": pa.array([f[3] / f[4] for f in found], pa.float64()),
                    }
                )

        hits = rows.mapInArrow(match, MATCHES)
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else docs.sparkSession.createDataFrame([], MATCHES)
