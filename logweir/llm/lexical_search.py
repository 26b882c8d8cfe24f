"""Ranked search for every item of a query set, by masks of the terms that documents hold.

One pass turns documents into postings of the items' terms and counts what weights need. A second
takes bands of documents of like length. For each item it groups a band's documents by the mask of
item terms they hold, and scores masks by falling maximum (every held term at the band's highest
frequency, in the band's shortest document) until no mask can reach the item's best so far.
"""

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.batches import gather
from logweir.llm.shares import written

BEST = 50
BLOCK_BYTES = 32 << 20  # text of items that a task holds at a time
PIECE = 1 << 20  # bytes of a text cut into terms at a time
READ = 8_192  # documents whose bands are cut together
BAND = 1_024  # documents of a band
CELLS = 4 << 20  # documents by terms of one item, at most
SPREAD = 64  # groups in which an item's candidates are first cut

# ASCII letters in lower case and digits stay, all other ASCII becomes a space; bytes from 0x80
# are parts of other characters and stay.
_TERMS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms(text: bytes | None):
    """Lists of the terms of a UTF-8 text, in order; a long text comes in several."""
    text = (text or b"").translate(_TERMS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split(b" ") if b" " in text[at:end] else [text[at:end]]
        at = end + 1


def _counts(text: bytes | None, vocabulary: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """Terms in all, and how often each term of the vocabulary occurs."""
    n, found = 0, {}
    for piece in terms(text):
        n += len(piece) - piece.count(b"")
        for term in piece:
            number = vocabulary.get(term)
            if number is not None:
                found[number] = found.get(number, 0) + 1
    return n, found


@dataclass
class Items:
    """A block of items: ids, the terms of each (places in the vocabulary) and the vocabulary."""

    ids: list
    terms: list[np.ndarray]
    vocabulary: dict[bytes, int]


def items_of(rows: list[tuple]) -> Items:
    """Items of (id, text) rows; rows that share an id are one item with the terms of all."""
    held, vocabulary = {}, {}
    for id, text in rows:
        own = held.setdefault(id, set())
        for piece in terms((text or "").encode()):
            own.update(vocabulary.setdefault(t, len(vocabulary)) for t in piece if t)
    return Items(list(held), [np.array(sorted(s), np.int64) for s in held.values()], vocabulary)


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """A term's weight from the number of documents that hold it, of ``n``."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def gain(weight, tf, m):
    """What a term adds to a document's score."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Best:
    """An item's best documents so far in a task: highest score, then smallest id, null last."""

    def __init__(self, most: int):
        self.most, self.heap = most, []

    @property
    def least(self) -> int:
        return -self.heap[0][0][0] if len(self.heap) == self.most else 1

    def add(self, score: int, id) -> None:
        key = (-score, id is None, id or 0)
        entry = (_Reversed(key), id)
        if len(self.heap) < self.most:
            heapq.heappush(self.heap, entry)
        elif key < self.heap[0][0]:
            heapq.heapreplace(self.heap, entry)


class _Reversed(tuple):
    """A tuple that sorts the other way round, so that a heap's head is the worst entry."""

    def __lt__(self, other):
        return tuple.__gt__(self, other)


class Band:
    """Postings of documents of like length, by term."""

    def __init__(self, starts, terms, counts, m):
        docs = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        order = np.argsort(terms, kind="stable")
        self.m = m
        self.docs, self.counts = docs[order], counts[order]
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order)).astype(np.int64)
        self.highest = np.maximum.reduceat(self.counts, self.starts) if len(order) else self.counts
        self.shortest = int(m.min())

    def find(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the item's terms the band holds, and their places in it."""
        place = np.searchsorted(self.terms, item)
        here = place < len(self.terms)
        here[here] = self.terms[place[here]] == item[here]
        return np.flatnonzero(here), place[here]

    def search(self, item: np.ndarray, weight: np.ndarray, ids: list, best: Best) -> None:
        here, place = self.find(item)
        if not len(here):
            return
        weight = weight[here]
        most = gain(weight, self.highest[place], self.shortest)
        if most.sum() < best.least:
            return
        n, width = len(self.m), len(here)
        sizes = self.ends[place] - self.starts[place]
        at = gather(self.starts[place], sizes)
        tf = np.zeros((width, n), np.int64)
        tf[np.repeat(np.arange(width), sizes), self.docs[at]] = self.counts[at]
        # The mask of a document is a column of bits; equal columns are a group.
        bits = np.packbits(tf > 0, axis=0)
        padded = np.zeros((n, -(-len(bits) // 8) * 8), np.uint8)
        padded[:, : len(bits)] = bits.T
        keys = padded.view(np.uint64)
        keys = keys.ravel() if keys.shape[1] == 1 else padded.view(f"V{padded.shape[1]}").ravel()
        _, first, group = np.unique(keys, return_index=True, return_inverse=True)
        bound = most @ (tf[:, first] > 0)
        order = np.argsort(-bound, kind="stable")
        members = np.argsort(group, kind="stable")
        sizes = np.bincount(group)
        starts = np.cumsum(sizes) - sizes
        at = 0
        while at < len(order) and bound[order[at]] >= best.least:
            # As many masks at a time as hold about a full list of documents.
            to = at + int(np.searchsorted(np.cumsum(sizes[order[at:]]), best.most)) + 1
            take = order[at:to]
            take = take[bound[take] >= best.least]
            docs = members[gather(starts[take], sizes[take])]
            scores = gain(weight[:, None], tf[:, docs], self.m[docs]).sum(0)
            for k in np.flatnonzero(scores >= best.least).tolist():
                if scores[k] > 0:
                    best.add(int(scores[k]), ids[docs[k]])
            at = to


POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "item int, doc_id long, score long"


def _lists(values: list[list[int]]) -> pa.Array:
    return pa.array(values, pa.list_(pa.int32()))


def _postings(rows: DataFrame, shared) -> DataFrame:
    """Documents with at least one term, and their terms that some item has."""

    def index(parts):
        vocabulary = shared.value.vocabulary
        for part in parts:
            ids, texts = part.column("doc_id"), part.column("text").cast(pa.large_binary())
            keep, n, held, counts = [], [], [], []
            for k in range(len(texts)):
                size, found = _counts(texts[k].as_py(), vocabulary)
                if size:
                    keep.append(k)
                    n.append(size)
                    held.append(list(found))
                    counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), _lists(held), _lists(counts)],
                names=["doc_id", "n", "terms", "counts"],
            )

    return rows.mapInArrow(index, POSTINGS)


def _statistics(postings: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms in all, and documents per vocabulary entry; summed in each task first."""

    def count(parts):
        docs, total, df = 0, 0, np.zeros(size, np.int64)
        for part in parts:
            docs += len(part)
            total += pc.sum(part.column("n")).as_py() or 0
            df += np.bincount(pc.list_flatten(part.column("terms")).to_numpy(), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict(
            {
                "term": pa.array(np.concatenate(([-2, -1], held)), pa.int32()),
                "count": pa.array(np.concatenate(([docs, total], df[held])), pa.int64()),
            }
        )

    rows = postings.mapInArrow(count, "term int, count long").groupBy("term").agg(F.sum("count").alias("count"))
    by = {r.term: r["count"] for r in rows.toLocalIterator()}
    df = np.zeros(size, np.int64)
    for term, n in by.items():
        if term >= 0:
            df[term] = n
    return by.get(-2, 0), by.get(-1, 0), df


def _found(postings: DataFrame, shared, statistics, most: int) -> DataFrame:
    docs, total, df = statistics

    def search(parts):
        items = shared.value
        w = weights(df, docs)
        own = [w[t] for t in items.terms]
        best = [Best(most) for _ in items.ids]
        band = max(8, min(BAND, CELLS // max([1, *map(len, items.terms)])))
        for part in parts:
            for at in range(0, len(part), READ):
                cut = part.slice(at, READ)
                n = cut.column("n").to_numpy()
                by_size = np.argsort(n, kind="stable")
                for k in range(0, len(by_size), band):
                    rows = by_size[k : k + band]
                    some = cut.take(pa.array(rows))
                    held = some.column("terms")
                    starts = held.offsets.to_numpy() - held.offsets[0].as_py()
                    flat = pc.list_flatten(held).to_numpy()
                    counts = pc.list_flatten(some.column("counts")).to_numpy().astype(np.int64)
                    m = np.array([50 + 50 * x * docs // total for x in n[rows].tolist()], np.int64)
                    one = Band(starts, flat, counts, m)
                    ids = some.column("doc_id").to_pylist()
                    for item, weight, mine in zip(items.terms, own, best):
                        one.search(item, weight, ids, mine)
        rows = [(i, id, -key[0]) for i, b in enumerate(best) for key, id in b.heap]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
            ],
            names=["item", "doc_id", "score"],
        )

    return postings.mapInArrow(search, FOUND)


def _top(found: DataFrame, most: int) -> DataFrame:
    """The best of each item: cut within groups of tasks, then among what they left."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]

    def cut(df, *keys):
        ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return ranked.where(F.col("rank") <= most)

    spread = found.withColumn("_spread", F.spark_partition_id() % SPREAD)
    return cut(cut(spread, "item", "_spread").drop("rank", "_spread"), "item")


def search(
    docs: DataFrame,
    items: DataFrame,
    most: int = BEST,
    text: str = "text",
    doc_id: str = "doc_id",
    item_id: str = "item_id",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``most`` highest-scoring documents of every item.

    Terms are maximal runs of ASCII letters, digits and other characters from U+0080; only A to Z are
    lower-cased. Statistics cover all documents with a term; null and empty texts have none. Rows of
    ``items`` with the same id, null included, are one item with the terms of all; an item without
    terms, and one that no document answers, has no rows. Repeated documents are ranked each for
    itself; of equal scores the smaller id goes first, null last. Empty tables give no rows; other
    columns are ignored. Items are the stated query set, held in blocks of ``BLOCK_BYTES`` of text,
    each of which meets all documents. A text is held whole by one task, its terms in pieces.
    """
    spark = docs.sparkSession
    queries = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{text}`").alias("text"))
    queries = queries.where("text IS NOT NULL")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    size = queries.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    out = None
    for block in range(blocks := -(-size // BLOCK_BYTES)):
        mine = queries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        held = items_of([(r.item_id, r.text) for r in mine.collect()])
        if not held.ids:
            continue
        shared = spark.sparkContext.broadcast(held)
        postings = written(_postings(rows, shared), "postings")
        found = _found(postings, shared, _statistics(postings, len(held.vocabulary)), most)
        names = spark.createDataFrame(list(enumerate(held.ids)), "item int, item_id long")
        ranked = _top(found, most).join(F.broadcast(names), "item")  # one row an item of the block
        ranked = ranked.select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
