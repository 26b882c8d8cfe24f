"""Language-model scores: context-tree weighting over bytes, and word unigrams beside it.

Each byte is eight binary decisions. A node of the tree is a context (the bytes before, up to ``depth``)
and the bits of the byte decided so far. Every node holds a Krichevsky-Trofimov estimate of its bit;
context-tree weighting mixes the estimates over all depths with the weights that the counts of
the training documents give.

Contexts of up to two bytes are a table that workers hold. Deeper ones grow with the corpus: the
distinct runs of ``depth + 1`` bytes of a block of documents go, with their counts, to buckets by the three
bytes nearest to the last, so a bucket holds whole subtrees. A bucket sums the blocks' counts, weighs its
subtrees from the leaves up and passes on the sums for two bytes. Once those are known it works out
the probability of each of its distinct runs, once, and every block looks up its own. A block is as large
as a worker can hold, as the larger it is the fewer of its runs are distinct.

Word counts grow with the corpus and are never held as a whole. Words with at least a share of
1 / ``FREQUENT`` of all tokens, at most ``FREQUENT`` words, are broadcast; all others are looked up in a
distributed join of packed rows: requests of a block of documents meet the counts of a bucket of words.
"""

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm import batches
from logweir.llm.shares import crc_of_id, partitions, written

FREQUENT = 1 << 21  # words held by every worker, 16 bytes each
END = np.uint64(0x5EED)  # stands for the end of a text among the words
GRAMS = 1 << 30  # added to the bucket of a request for byte runs
BLOCK_BYTES = 16 << 20  # text of a block whose distinct byte runs are asked for together
PIECE_BYTES = 4 << 20  # text of a block whose byte runs are told apart at a time
HELD = 256 << 20  # bytes of counts of a bucket that are held before they are summed
_BYTE, _EIGHT = np.uint64(255), np.uint64(8)
_LOG_PI = math.log(math.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5, by Stirling's series at x + 8."""
    x = np.asarray(x, np.float64)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    shift = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the KT probability of a node's bits."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - _LOG_PI


_HALF, _WHOLE = (_lgamma(np.arange(1 << 16) + x) for x in (0.5, 1.0))


def _kt_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The same for whole numbers, mostly small: looked up."""
    total = zeros + ones
    small = total < len(_HALF)
    out = np.empty(len(total))
    out[small] = _HALF[zeros[small]] + _HALF[ones[small]] - _WHOLE[total[small]] - _LOG_PI
    out[~small] = _kt(zeros[~small], ones[~small])
    return out


def _bits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of bytes (..., 256) as counts of zeros and ones at the 255 bit nodes, in heap order."""
    zeros, ones = np.zeros((*counts.shape[:-1], 256)), np.zeros((*counts.shape[:-1], 256))
    level = counts.astype(np.float64)
    for depth in range(7, -1, -1):
        pairs = level.reshape(*counts.shape[:-1], 1 << depth, 2)
        zeros[..., 1 << depth : 2 << depth] = pairs[..., 0]
        ones[..., 1 << depth : 2 << depth] = pairs[..., 1]
        level = pairs.sum(-1)
    return zeros, ones


_NODE = np.array([[(1 << d) | (b >> (8 - d)) for d in range(8)] for b in range(256)])
_BIT = np.array([[(b >> (7 - d)) & 1 for d in range(8)] for b in range(256)])


def _bytes(one: np.ndarray) -> np.ndarray:
    """log10 probabilities of bytes from the probability of a one at each bit node."""
    p = one[..., _NODE]
    return np.log10(np.where(_BIT == 1, p, 1 - p)).sum(-1)


def weights(counts) -> tuple[np.ndarray, np.ndarray]:
    """log of the product of the children's weighted probabilities, at the root and by last byte.

    ``counts(last)`` gives the counts (256 bytes before it, 256 next bytes) of one last byte.
    """
    root = np.zeros(256)
    inner = np.zeros((256, 256))
    for last in range(256):  # bounded by the alphabet
        zeros, ones = _bits(counts(last))
        leaf = _kt(zeros, ones)
        below = leaf.sum(0)
        own = _kt(zeros.sum(0), ones.sum(0))
        inner[last] = below
        root += np.logaddexp(own, below) - math.log(2)
    return root, inner


def table(counts) -> np.ndarray:
    """log10 P(byte | two bytes before), indexed [last byte][byte before it][byte].

    A node's own estimate counts with its share of the node's weighted probability.
    """
    below_root, below_inner = weights(counts)
    totals = np.stack([counts(last).sum(0) for last in range(256)])
    zeros, ones = _bits(totals)
    root_zeros, root_ones = zeros.sum(0), ones.sum(0)
    stay_root = 1 / (1 + np.exp(np.clip(below_root - _kt(root_zeros, root_ones), -700, 700)))
    p_root = (root_ones + 0.5) / (root_zeros + root_ones + 1)
    out = np.zeros((256, 256, 256), np.float32)
    for last in range(256):
        z, o = zeros[last], ones[last]
        stay = 1 / (1 + np.exp(np.clip(below_inner[last] - _kt(z, o), -700, 700)))
        p_inner = (o + 0.5) / (z + o + 1)
        leaf_zeros, leaf_ones = _bits(counts(last))
        p_leaf = (leaf_ones + 0.5) / (leaf_zeros + leaf_ones + 1)
        mixed = stay_root * p_root + (1 - stay_root) * (stay * p_inner + (1 - stay) * p_leaf)
        out[last] = _bytes(mixed)
    return out


def top(counts, below_leaf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a two-byte context, A, B): a bit is one with probability A + B q, q from deeper contexts.

    ``below_leaf(last)`` gives the log of the product of the weighted probabilities three bytes deep.
    Contexts never seen share a row by last byte.
    """

    def stay(own, below):
        return 1 / (1 + np.exp(np.clip(below - own, -700, 700)))

    totals = np.stack([counts(last).sum(0) for last in range(256)])
    zeros, ones = _bits(totals)
    own_inner, below_inner = _kt(zeros, ones), np.zeros((256, 256))
    for last in range(256):  # bounded by the alphabet
        own = _kt(*_bits(counts(last)))
        below_inner[last] = (np.logaddexp(own, below_leaf(last)) - math.log(2)).sum(0)
    below_root = (np.logaddexp(own_inner, below_inner) - math.log(2)).sum(0)
    root_zeros, root_ones = zeros.sum(0), ones.sum(0)
    stay_root = stay(_kt(root_zeros, root_ones), below_root)
    p_root = (root_ones + 0.5) / (root_zeros + root_ones + 1)
    row, fixed, factor, n = np.zeros((256, 256), np.int32), [], [], 0
    for last in range(256):
        own = counts(last)
        seen = np.flatnonzero(own.any(1))
        z, o = _bits(np.concatenate((own[seen], np.zeros((1, 256), own.dtype))))
        below = np.concatenate((below_leaf(last)[seen], np.zeros((1, 256))))
        stay_leaf, p_leaf = stay(_kt(z, o), below), (o + 0.5) / (z + o + 1)
        stay_inner = stay(own_inner[last], below_inner[last])
        p_inner = (ones[last] + 0.5) / (zeros[last] + ones[last] + 1)
        rest = (1 - stay_root) * (1 - stay_inner)
        fixed.append(stay_root * p_root + (1 - stay_root) * stay_inner * p_inner + rest * stay_leaf * p_leaf)
        factor.append(rest * (1 - stay_leaf))
        row[last] = n + len(seen)
        row[last, seen] = n + np.arange(len(seen))
        n += len(seen) + 1
    return row.ravel(), np.concatenate(fixed).astype(np.float32), np.concatenate(factor).astype(np.float32)


def _grams(data: np.ndarray, rows: np.ndarray, depth: int, start: int = 0, end: int | None = None) -> np.ndarray:
    """For bytes from ``start`` to ``end`` the ``depth`` bytes before, the nearest highest, and the byte lowest."""
    own = data[start:end]
    near = data[max(start - 7, 0) : start]
    padded = np.concatenate((np.zeros(7 - len(near), np.uint8), near, own))
    out = np.ndarray((len(own),), "<u8", padded, strides=(1,)) << _EIGHT  # the byte before is highest
    out >>= np.uint64(8 * (7 - depth))
    out &= ~_BYTE
    out |= own
    for d in range(depth):  # zeros stand before a text
        at = rows[:-1] + d
        at = at[(at < rows[1:]) & (at >= start) & (at < start + len(own))] - start
        out[at] &= np.uint64(((1 << 8 * d) - 1) << 8 * (depth + 1 - d) | 255)
    return out


class Runs:
    """The distinct byte runs of a block of texts, found piece by piece."""

    def __init__(self, data: np.ndarray, rows: np.ndarray, depth: int):
        self.rows, self.size = rows, len(data)
        self.pieces = []
        for start in range(0, len(data), PIECE_BYTES):
            found = pc.dictionary_encode(pa.array(_grams(data, rows, depth, start, start + PIECE_BYTES)))
            own = found.dictionary.to_numpy()
            order = np.argsort(own)
            rank = np.empty(len(own), np.int32)
            rank[order] = np.arange(len(own))
            self.pieces.append((start, rank[found.indices.to_numpy()], own[order]))
        names = np.sort(np.concatenate([own for _, _, own in self.pieces]), kind="stable")  # merges sorted pieces
        self.names = names[np.concatenate(([True], names[1:] != names[:-1]))]

    def _placed(self):
        """Pieces: where they start, for every byte its run in the piece, and the runs' places in ``names``."""
        for start, which, own in self.pieces:
            yield start, which, np.searchsorted(self.names, own)

    def counts(self, learned: np.ndarray) -> np.ndarray:
        """How often the rows marked in ``learned`` hold each run."""
        n = np.zeros(len(self.names), np.int64)
        marked = np.repeat(learned, np.diff(self.rows))
        for start, which, at in self._placed():
            n[at] += np.bincount(which[marked[start : start + len(which)]], minlength=len(at))
        return n

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each row the sum over its bytes of its runs' ``values``."""
        out = np.zeros(len(self.rows) - 1)
        for start, which, at in self._placed():
            edges = np.clip(self.rows - start, 0, len(which))
            some = np.flatnonzero(np.diff(edges))
            out[some] += np.add.reduceat(values[at][which].astype(np.float64), edges[some])
        return out


def _bucket(grams: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    nearest = grams >> np.uint64(8 * (depth - 2))
    return (batches.mix(nearest + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)


def _dealt(grams: np.ndarray, depth: int, buckets: int):
    """An order of sorted ``grams`` by bucket, and (bucket, from, to) in that order."""
    bucket = _bucket(grams, depth, buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return order, [(b, edges[b], edges[b + 1]) for b in np.flatnonzero(np.diff(edges)).tolist()]


def _node(names: np.ndarray, k: int) -> np.ndarray:
    """The context of (context, byte) with the node of the byte's first ``k`` bits."""
    return (names & ~_BYTE) | np.uint64(1 << k) | ((names & _BYTE) >> np.uint64(8 - k))


class Subtrees:
    """The part of the tree from three bytes of context down, of the byte runs of a bucket."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, depth: int):
        self.depth, self.levels = depth, {}
        self.above, self.below = np.zeros(0, np.uint64), np.zeros(0)
        if not len(grams):
            return
        weighted: list[tuple[np.ndarray, np.ndarray]] = []
        for d in range(depth, 2, -1):
            names, count = _summed(self._names(grams, d), n)
            level, above = [], []
            for k in range(8):
                node = _node(names, k)
                starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
                ones = np.add.reduceat(count * (names >> np.uint64(7 - k) & np.uint64(1)).astype(np.int64), starts)
                zeros = np.add.reduceat(count, starts) - ones
                keys, own = node[starts], _kt_of(zeros, ones)
                stay = np.ones(len(keys))
                log_w = own
                if d < depth:
                    child, log_child = weighted[k]
                    below = np.bincount(np.searchsorted(keys, self._parent(child)), log_child, len(keys))
                    stay = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))
                    log_w = np.logaddexp(own, below) - math.log(2)
                level.append((keys, stay, (ones + 0.5) / (zeros + ones + 1)))
                above.append((keys, log_w))
            self.levels[d], weighted = level, above
        keys = np.concatenate([self._parent(x) for x, _ in weighted])
        self.above, inverse = np.unique(keys, return_inverse=True)
        self.below = np.bincount(inverse, np.concatenate([x for _, x in weighted]), len(self.above))

    def _names(self, grams, d):
        return (grams >> np.uint64(8 * (self.depth - d + 1)) << _EIGHT) | (grams & _BYTE)

    @staticmethod
    def _parent(keys):
        return (keys >> np.uint64(16) << _EIGHT) | (keys & _BYTE)

    def ones(self, grams: np.ndarray) -> np.ndarray:
        """(grams, 8): the mixed probability of a one at each bit from three bytes of context down."""
        out = np.full((len(grams), 8), 0.5)
        for d in sorted(self.levels, reverse=True):
            names = self._names(grams, d)
            for k, (keys, stay, p) in enumerate(self.levels[d]):
                node = _node(names, k)
                at = np.minimum(np.searchsorted(keys, node), len(keys) - 1)
                found = keys[at] == node
                own = np.where(found, stay[at], 0.5)
                out[:, k] = own * np.where(found, p[at], 0.5) + (1 - own) * out[:, k]
        return out


def _packed(values: np.ndarray) -> bytes:
    """Sorted rows as planes of bytes, compressed; the high planes hardly change."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _unpacked(payload: bytes, dtype) -> np.ndarray:
    size, width = int.from_bytes(payload[:8], "little"), np.dtype(dtype).itemsize
    if not size:
        return np.zeros(0, dtype)
    raw = pa.decompress(payload[8:], decompressed_size=size, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


_GRAM = np.dtype([("name", "<u8"), ("n", "<i8")])  # a byte run, and how often training documents hold it


def _entries(names: np.ndarray, n: np.ndarray) -> np.ndarray:
    entry = np.zeros(len(names), _GRAM)
    entry["name"], entry["n"] = names, n
    return entry


def _trees(requests: DataFrame, depth: int, buckets: int) -> DataFrame:
    """(bucket, payload, above, below): byte runs with their counts, and sums for two bytes of context."""

    def merged(parts):
        bucket, held, size = None, [], 0

        def summed():
            entry = np.concatenate([_unpacked(x, _GRAM) for x in held])
            return _summed(entry["name"], entry["n"])

        def packed(names, n):
            return _packed(_entries(names, n))

        def tree():
            names, n = summed()
            subtrees = Subtrees(names[n > 0], n[n > 0], depth)
            return pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array([bucket], pa.int32()),
                    "payload": pa.array([packed(names, n)], pa.binary()),
                    "above": pa.array([batches.signed(subtrees.above)], pa.list_(pa.int64())),
                    "below": pa.array([subtrees.below], pa.list_(pa.float64())),
                }
            )

        for part in parts:
            for b, payload in zip(part.column("bucket").to_pylist(), part.column("payload")):
                if b != bucket and held:
                    yield tree()
                    held, size = [], 0
                bucket = b
                held.append(payload.as_py())
                size += int.from_bytes(held[-1][:8], "little")
                if size > HELD and len(held) > 1:
                    held = [packed(*summed())]
                    size = int.from_bytes(held[0][:8], "little") // 2
        if held:
            yield tree()

    return written(
        requests.select("bucket", "payload")
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(merged, "bucket int, payload binary, above array<long>, below array<double>"),
        "trees",
    )


def _deep_answers(requests: DataFrame, trees: DataFrame, shared, depth: int, buckets: int) -> DataFrame:
    """For each request of byte runs the log10 probabilities of their last bytes."""

    def scored(names: np.ndarray, n: np.ndarray) -> np.ndarray:
        row, fixed, factor = shared.value
        subtrees = Subtrees(names[n > 0], n[n > 0], depth)
        out = np.zeros(len(names), np.float32)
        for at in range(0, len(names), 1 << 18):
            own = names[at : at + (1 << 18)]
            q = subtrees.ones(own)
            byte = (own & _BYTE).astype(np.int64)
            context = row[(own >> np.uint64(8 * (depth - 1))).astype(np.int64)]
            nodes = _NODE[byte]
            p = fixed[context[:, None], nodes] + factor[context[:, None], nodes] * q
            out[at : at + len(own)] = np.log10(np.where(_BIT[byte] == 1, p, 1 - p)).sum(1)
        return out

    def answer(parts):
        names = log_p = None
        for part in parts:
            for b, block, payload in zip(part.column("bucket").to_pylist(), part.column("block").to_pylist(), part.column("payload")):
                entry = _unpacked(payload.as_py(), _GRAM)
                if block < 0:  # the bucket's own runs, sorted before the requests
                    names, log_p = np.ascontiguousarray(entry["name"]), scored(entry["name"], entry["n"])
                    continue
                yield _work_row(block, GRAMS + b, _packed(log_p[np.searchsorted(names, entry["name"])]))

    return (
        requests.select("block", "bucket", "payload")
        .unionByName(trees.select(F.lit(-1).cast("long").alias("block"), "bucket", "payload"))
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket", "block")
        .mapInArrow(answer, _WORK)
    )


def _contexts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """last << 16 | before << 8 | byte for every byte; zeros stand before a text."""
    wide = data.astype(np.int64)
    last, before = np.zeros_like(wide), np.zeros_like(wide)
    last[1:], before[2:] = wide[:-1], wide[:-2]
    starts = rows[:-1][np.diff(rows) > 0]
    last[starts] = 0
    before[starts] = 0
    second = starts[starts + 1 < len(wide)] + 1
    before[second] = 0
    return (last << 16) | (before << 8) | wide


def _summed(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(names, return_inverse=True)
    return distinct, np.bincount(inverse, counts, len(distinct)).astype(np.int64)


def _training_counts(docs: DataFrame) -> DataFrame:
    """(kind, name, n): counts of words (kind 0) and of byte contexts (kind 1), one task's at a time."""

    def count(parts):
        context = np.zeros(1 << 24, np.int32)
        held, size = [], 0

        def flush():
            names, n = _summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            return _count_rows(0, batches.signed(names), n)

        documents = 0
        for part in batches.slices(parts):
            w = batches.words(part.column("text"), lower=True)
            documents += part.num_rows
            names, n = np.unique(w.names, return_counts=True)
            held.append((names, n))
            size += len(names)
            at, n = np.unique(_contexts(w.data, w.rows), return_counts=True)
            context[at] += n.astype(np.int32)
            if size > 2_000_000:
                yield flush()
                held, size = [], 0
            if documents > 1_000_000 or context.max(initial=0) > 1 << 30:
                at = np.flatnonzero(context)
                yield _count_rows(1, at, context[at])
                context[:] = 0
                yield _count_rows(0, batches.signed(np.array([END])), np.array([documents]))
                documents = 0
        if held:
            yield flush()
        at = np.flatnonzero(context)
        yield _count_rows(1, at, context[at])
        yield _count_rows(0, batches.signed(np.array([END])), np.array([documents]))

    return docs.select("text").mapInArrow(count, "kind int, name long, n long")


def _count_rows(kind: int, names: np.ndarray, n: np.ndarray):
    return pa.RecordBatch.from_pydict(
        {
            "kind": np.full(len(names), kind, np.int32),
            "name": names.astype(np.int64, copy=False),
            "n": n.astype(np.int64),
        }
    )


def _dense(names: np.ndarray, n: np.ndarray):
    """Counts by last byte from sparse (context, n) columns."""
    edges = np.searchsorted(names, np.arange(257) << 16)

    def counts(last):
        out = np.zeros(1 << 16, np.int64)
        out[names[edges[last] : edges[last + 1]] & 0xFFFF] = n[edges[last] : edges[last + 1]]
        return out.reshape(256, 256)

    return counts


_WORK = "block long, bucket int, payload binary"
_ENTRY = np.dtype([("name", "<u8"), ("doc", "<i4"), ("n", "<i4")])
_SUMS = np.dtype([("doc", "<i4"), ("known", "<i8"), ("score", "<f8")])
_OWN = np.dtype(
    [("doc_id", "<i8"), ("null", "?"), ("held", "?"), ("bytes", "<i8"), ("tokens", "<i8"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")]
)


def score(
    docs: DataFrame, folds: int = 5, held_out: int = 1, text: str = "text", doc_id: str = "doc_id",
    depth: int = 2,
) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents outside the fold ``held_out`` of crc32(doc_id) are learned from, all are scored, after
    lower-casing A to Z. ``base_score`` is the add-half unigram score of words and an end;
    ``score`` is log10 of the probability of the bytes by the tree of ``depth`` (2 to 7) bytes of
    context. A null text counts as empty: it has
    the end alone and score 0. Repeated rows count as often as they occur; a null id is in no
    held-out fold. An empty table gives no rows; with no training rows, counts are zero.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(crc_of_id(), F.lit(folds)) == held_out, F.lit(False))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn(
        "held_out", held
    )
    counted = written(
        _training_counts(rows.where("not held_out")).groupBy("kind", "name").agg(F.sum("n").alias("n"))
        .where("n > 0"),
        "training-counts",
    )
    words = counted.where("kind = 0").select("name", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if not 2 <= depth <= 7:
        raise ValueError("depth must be 2 to 7")
    deep, buckets = depth > 2, partitions(docs)
    # at most 2^24 contexts, and at most FREQUENT words of so large a share
    near = _dense(*_pairs(counted.where("kind = 1").select("name", "n")))
    tree = None if deep else table(near)
    least = max(1, -(-total // FREQUENT))
    names, n = _pairs(words.where(F.col("n") >= least))
    names = names.view(np.uint64)
    order = np.argsort(names)
    below = math.log10(total + 0.5 * (distinct + 1))
    shared = spark.sparkContext.broadcast((tree, names[order], n[order]))
    rare = least > 1

    def work(parts):
        for part in batches.slices(parts, most=BLOCK_BYTES if deep else batches.SLICE_BYTES):
            own, asked, who, texts = np.zeros(part.num_rows, _OWN), [], [], []
            at = 0
            for piece in batches.slices([part]):
                to = at + piece.num_rows
                names, owners, data = words_of(piece, own[at:to])
                asked.append(names)
                who.append(owners + at)
                texts.append(data)
                at = to
            block = uuid.uuid4().int >> 65
            yield _work_row(block, -1, own.tobytes())
            if deep:
                data = np.concatenate(texts)
                rows = np.concatenate(([0], np.cumsum(own["bytes"])))
                yield _work_row(block, -2, _packed(data))
                yield from runs_of(block, data, rows, ~own["held"])
            yield from rare_of(block, np.concatenate(asked), np.concatenate(who))

    def words_of(part, own):
        """Fill in ``own``, and give the names to look up, whose they are, and the bytes."""
        table_, common, common_n = shared.value
        w = batches.words(part.column("text"), lower=True)
        n_docs = part.num_rows
        owner = np.concatenate((w.row_of_word(), np.arange(n_docs)))
        name = np.concatenate((w.names, np.full(n_docs, END)))
        at = np.searchsorted(common, name)
        found = at < len(common)
        found[found] = common[at[found]] == name[found]
        c = np.zeros(len(name))
        c[found] = common_n[at[found]]
        ids = part.column("doc_id")
        own["null"] = ids.is_null().to_numpy(zero_copy_only=False)
        own["doc_id"] = ids.fill_null(0).to_numpy()
        own["held"] = part.column("held_out").to_numpy(zero_copy_only=False)
        own["bytes"] = np.diff(w.rows)
        own["tokens"] = np.diff(w.first) + 1
        settled = found | (not rare)
        own["known"] = np.bincount(owner[found], minlength=n_docs)
        own["base"] = np.bincount(owner[settled], np.log10(c[settled] + 0.5) - below, minlength=n_docs)
        if not deep:
            log_p = np.zeros(len(w.data) + 1)
            np.cumsum(table_.ravel()[_contexts(w.data, w.rows)], out=log_p[1:], dtype=np.float64)
            own["score"] = np.diff(log_p[w.rows])
        return name[~settled], owner[~settled], w.data

    def runs_of(block, data, rows, learned):
        """The block's distinct byte runs by bucket, with their counts in documents learned from."""
        if not len(data):
            return
        runs = Runs(data, rows, depth)
        entry = _entries(runs.names, runs.counts(learned))
        order, cuts = _dealt(entry["name"], depth, buckets)
        entry = entry[order]
        for b, start, end in cuts:
            yield _work_row(block, GRAMS + b, _packed(entry[start:end]))

    def rare_of(block, asked, who):
        """Words of the block that are not held, by bucket."""
        if not len(asked):
            return
        order = np.lexsort((who, asked))
        asked, who = asked[order], who[order]
        new = np.concatenate(([True], (np.diff(asked) != 0) | (np.diff(who) != 0)))
        entry = np.zeros(int(new.sum()), _ENTRY)
        entry["name"], entry["doc"] = asked[new], who[new]
        entry["n"] = np.diff(np.append(np.flatnonzero(new), len(asked)))
        bucket = np.ascontiguousarray(entry["name"]).view(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        entry, bucket = entry[order], bucket[order]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in np.unique(bucket).tolist():
            yield _work_row(block, b, entry[edges[b] : edges[b + 1]].tobytes())

    # Written once, so the random block numbers stay what they are if a task runs again.
    todo = written(rows.mapInArrow(work, _WORK), "score-requests")
    answers = todo.where("bucket < 0").select("block", "bucket", "payload")
    if rare:
        asked = todo.where((F.col("bucket") >= 0) & (F.col("bucket") < GRAMS))
        known = words.where(F.col("n") < least).select(
            F.pmod("name", F.lit(buckets)).cast("int").alias("bucket"),
            "name",
            "n",
        )

        def answer(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            names = right["name"].to_numpy().astype(np.int64).view(np.uint64)
            order = np.argsort(names)
            names, n = names[order], right["n"].to_numpy()[order]
            out = []
            for block, payload in zip(left["block"], left["payload"]):
                entry = np.frombuffer(payload, _ENTRY)
                at = np.searchsorted(names, entry["name"])
                found = at < len(names)
                found[found] = names[at[found]] == entry["name"][found]
                c = np.zeros(len(entry))
                c[found] = n[at[found]]
                who, inverse = np.unique(entry["doc"], return_inverse=True)
                sums = np.zeros(len(who), _SUMS)
                sums["doc"] = who
                sums["known"] = np.bincount(inverse, entry["n"] * found)
                sums["score"] = np.bincount(inverse, entry["n"] * (np.log10(c + 0.5) - below))
                out.append((block, 0, sums.tobytes()))
            return pd.DataFrame(out, columns=["block", "bucket", "payload"])

        answers = answers.unionByName(
            asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInPandas(answer, _WORK)
        )

    if deep:
        requests = todo.where(F.col("bucket") >= GRAMS).withColumn("bucket", F.col("bucket") - GRAMS)
        trees = _trees(requests, depth, buckets)
        sums = (
            trees.select(F.explode(F.arrays_zip("above", "below")).alias("x"))
            .groupBy("x.above").agg(F.sum("x.below").alias("below")).toArrow()
        )
        above = sums.column(0).to_numpy().astype(np.int64)
        order = np.argsort(above)
        above, below_sums = above[order], sums.column(1).to_numpy().astype(np.float64)[order]
        edges = np.searchsorted(above, np.arange(257) << 16)

        def below_leaf(last):
            out = np.zeros(1 << 16)
            own = slice(edges[last], edges[last + 1])
            out[above[own] & 0xFFFF] = below_sums[own]
            return out.reshape(256, 256)

        shared_top = spark.sparkContext.broadcast(top(near, below_leaf))
        answers = answers.unionByName(_deep_answers(requests, trees, shared_top, depth, buckets))

    def scores(data, lengths, found):
        """log10 probability of each text from those of the distinct byte runs, bucket by bucket."""
        if not len(data):
            return np.zeros(len(lengths))
        runs = Runs(data, np.concatenate(([0], np.cumsum(lengths))), depth)
        log_p = np.zeros(len(runs.names), np.float32)
        log_p[_dealt(runs.names, depth, buckets)[0]] = np.concatenate(found)
        return runs.sums(log_p)

    def gathered(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bucket", kind="stable")
        at = group["bucket"].to_numpy()
        payloads = group["payload"]
        own = np.frombuffer(payloads[at == -1].iloc[0], _OWN).copy()
        if deep:
            data = _unpacked(payloads[at == -2].iloc[0], np.uint8)
            own["score"] = scores(data, own["bytes"], [_unpacked(x, np.float32) for x in payloads[at >= GRAMS]])
        for payload in payloads[(at >= 0) & (at < GRAMS)]:
            sums = np.frombuffer(payload, _SUMS)
            own["known"][sums["doc"]] += sums["known"]
            own["base"][sums["doc"]] += sums["score"]
        ids = pd.array(own["doc_id"], dtype="Int64")
        ids[own["null"]] = pd.NA
        return pd.DataFrame(
            {
                "doc_id": ids,
                "held_out": own["held"],
                "n_tokens": own["tokens"],
                "n_known": own["known"],
                "train_tokens": np.full(len(own), total, np.int64),
                "base_score": own["base"],
                "score": own["score"],
            }
        )

    return answers.groupBy("block").applyInPandas(
        gathered,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
    )


def _work_row(block: int, bucket: int, payload: bytes):
    return pa.RecordBatch.from_pydict(
        {
            "block": pa.array([block], pa.int64()),
            "bucket": pa.array([bucket], pa.int32()),
            "payload": pa.array([payload], pa.binary()),
        }
    )


def _pairs(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Columns of a bounded (name, n) table, sorted by name."""
    got = df.toArrow()
    names, n = (got.column(i).to_numpy().astype(np.int64) for i in range(2))
    order = np.argsort(names)
    return names[order], n[order]
