"""Repeated passages by level-wise doubling, and texts without them.

A window is ``window`` words in a row of one document. A window can only repeat if the shorter
windows in it do. So windows of a short length are tested first, and only those that repeat are
extended to twice the length, until the full length is reached or none is left. At a short length a
full window is represented by the one shorter window in it with the least fingerprint: two
equal full windows have the same representative, so few rows stand for all windows and no
repeat is missed.

Counting combines before it shuffles. A fingerprint that a large part of the corpus shares is counted
and joined instead of gathered, so no task holds all its places.
"""

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm import batches
from logweir.llm.shares import partitions, written
from logweir.session import broadcast_if_small

SHORTEST = 12  # words of the first level, at least, unless the window itself is shorter
PACK = 1 << 20  # windows that a task holds to combine equal ones before the shuffle
HOT = 10_000  # places of a fingerprint above which they are not gathered in one task
COMMON = 1 << 22  # repeated windows of such fingerprints that every worker holds, 8 bytes each


def levels(window: int) -> list[int]:
    """Lengths from the first level to ``window``, each at most twice the one before."""
    out = [window]
    while -(-out[0] // 2) >= SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out


def representatives(w: batches.Words, length: int, window: int):
    """Starts of all full windows, for each the start of its representative, and all short names."""
    at, _ = batches.windows(w, window)
    starts, names = batches.windows(w, length)
    of = np.zeros(len(w.names), np.uint64)
    of[starts] = names
    if not len(at):
        return at, at, of
    span = window - length + 1
    return at, sliding_window_view(of, span)[at].argmin(1) + at, of


def _alive(w: batches.Words, length: int, window: int, survivors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Full windows whose representative of ``length`` words is among ``survivors``, by row."""
    at, chosen, names = representatives(w, length, window)
    live = np.zeros(len(w.names), bool)
    for row, places in enumerate(survivors):
        live[w.first[row] + np.asarray(places, np.int64)] = True
    keep = live[chosen] if len(at) else np.zeros(0, bool)
    return at[keep], chosen[keep], names


def _survivors(rows: DataFrame, name: str) -> DataFrame:
    """(doc, places, hot) of the (name, doc, place) rows whose name occurs more than once."""
    counts = written(rows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), f"{name}-counts")
    # Names above HOT are few and marked in passing, so their rows go into no task by name.
    crowded = counts.where(F.col("n") > HOT).select("name", F.lit(True).alias("hot"))
    marked = rows.join(broadcast_if_small(crowded), "name", "left")
    cold = marked.where("hot IS NULL").join(counts.where(F.col("n") <= HOT), "name")
    found = cold.select("doc", "place", F.lit(False).alias("hot")).unionByName(
        marked.where("hot").select("doc", "place", "hot")
    )
    return written(
        found.groupBy("doc").agg(
            F.collect_list("place").alias("places"), F.collect_list("hot").alias("hot")
        ),
        name,
    )


def _with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Documents that ``places`` names, with their places; others are dropped before the shuffle."""
    ids = broadcast_if_small(places.select("doc"))
    return docs.join(ids, "doc", "left_semi").join(places, "doc")


def _first_rows(docs: DataFrame, length: int, window: int) -> DataFrame:
    def emit(parts):
        for part in batches.slices(parts):
            w = batches.words(part.column("text"))
            _, chosen, names = representatives(w, length, window)
            yield _rows(part, w, np.unique(chosen), names)

    return docs.mapInArrow(emit, "name long, doc long, place int")


def _rows(part, w, chosen, names):
    row = w.row_of_word()[chosen]
    return pa.RecordBatch.from_pydict(
        {
            "name": batches.signed(names[chosen]),
            "doc": part.column("doc").take(pa.array(row)),
            "place": (chosen - w.first[row]).astype(np.int32),
        }
    )


def _next_rows(docs: DataFrame, places: DataFrame, length: int, longer: int, window: int) -> DataFrame:
    def emit(parts):
        for part in batches.slices(parts):
            w = batches.words(part.column("text"))
            live, _, _ = _alive(w, length, window, part.column("places").to_pylist())
            at, chosen, names = representatives(w, longer, window)
            yield _rows(part, w, np.unique(chosen[np.isin(at, live)]), names)

    return _with_places(docs, places).mapInArrow(emit, "name long, doc long, place int")


_CANDIDATES = "name long, doc long, first int, hot boolean, windows binary"


def _candidates(docs: DataFrame, places: DataFrame, length: int, window: int) -> DataFrame:
    """Per surviving representative: the fingerprints of the full windows it stands for, a run each."""

    def emit(parts):
        for part in batches.slices(parts):
            w = batches.words(part.column("text"))
            survivors, hot = part.column("places").to_pylist(), part.column("hot").to_pylist()
            live, chosen, names = _alive(w, length, window, survivors)
            crowded = np.zeros(len(w.names), bool)
            for row, (own, flags) in enumerate(zip(survivors, hot)):
                crowded[w.first[row] + np.asarray(own, np.int64)] = flags
            full = batches.Rolling(w.names).of(live, live + window)
            # windows of one representative follow one another, but for the last of a row
            cut = np.flatnonzero((np.diff(chosen) != 0) | (np.diff(live) != 1)) + 1
            starts = np.concatenate(([0], cut)) if len(live) else cut
            ends = np.concatenate((cut, [len(live)])) if len(live) else cut
            row = w.row_of_word()[live[starts]]
            raw = full.tobytes()
            yield pa.RecordBatch.from_pydict(
                {
                    "name": batches.signed(names[chosen[starts]]),
                    "doc": part.column("doc").take(pa.array(row)),
                    "first": (live[starts] - w.first[row]).astype(np.int32),
                    "hot": crowded[chosen[starts]],
                    "windows": pa.array([raw[8 * s : 8 * e] for s, e in zip(starts, ends)], pa.binary()),
                }
            )

    return _with_places(docs, places).mapInArrow(emit, _CANDIDATES)


def _repeated(candidates: DataFrame, tasks: int) -> DataFrame:
    """(doc, start, end): runs of full windows that occur elsewhere, as word ranges to come."""

    def gathered(parts):
        """Rows come sorted by name; a name's rows are judged together."""
        held: list[pa.RecordBatch] = []

        def judged(rows: pa.Table):
            blobs = rows.column("windows").combine_chunks()
            sizes = np.array([len(b) for b in blobs.to_pylist()], np.int64) // 8
            full = np.frombuffer(b"".join(blobs.to_pylist()), np.uint64)
            _, inverse, counts = np.unique(full, return_inverse=True, return_counts=True)
            repeats = counts[inverse] > 1
            which = np.repeat(np.arange(len(sizes)), sizes)
            place = batches.gather(rows.column("first").to_numpy().astype(np.int64), sizes)
            which, place = which[repeats], place[repeats]
            cut = np.flatnonzero((np.diff(which) != 0) | (np.diff(place) != 1)) + 1
            starts = np.concatenate(([0], cut)) if len(which) else cut
            ends = np.concatenate((cut, [len(which)])) if len(which) else cut
            docs = rows.column("doc").combine_chunks().take(pa.array(which[starts]))
            return pa.RecordBatch.from_pydict(
                {
                    "doc": docs,
                    "start": place[starts].astype(np.int32),
                    "end": (place[ends - 1] + 1).astype(np.int32),
                }
            )

        for part in parts:
            if not part.num_rows:
                continue
            names = part.column("name").to_numpy()
            last = int(np.searchsorted(names, names[-1]))
            if last or (held and held[-1].column("name")[-1].as_py() != names[0]):
                held.append(part.slice(0, last))
                yield judged(pa.Table.from_batches(held))
                held = []
            held.append(part.slice(last))
        if held:
            yield judged(pa.Table.from_batches(held))

    shape = "doc long, start int, end int"
    cold = (
        candidates.where("not hot")
        .select("name", "doc", "first", "windows")
        .repartition(tasks, "name")
        .sortWithinPartitions("name")
        .mapInArrow(gathered, shape)
    )

    hot = candidates.where("hot").select("doc", "first", "windows")
    counts = _counted(hot).groupBy("window").agg(F.sum("n").alias("n"))
    common = written(counts.where("n > 1").select("window"), "common-windows")
    return cold.unionByName(_marked(hot, common, shape))


def _counted(hot: DataFrame) -> DataFrame:
    """(window, n): how often windows occur, equal ones of a task combined, ``PACK`` at a time."""

    def count(parts):
        held, size = [], 0

        def flush():
            window, n = np.unique(np.frombuffer(b"".join(held), np.int64), return_counts=True)
            return pa.RecordBatch.from_pydict({"window": window, "n": n})

        for part in parts:
            for blob in part.column("windows"):
                held.append(blob.as_py())
                size += len(held[-1]) // 8
                if size >= PACK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return hot.select("windows").mapInArrow(count, "window long, n long")


def _marked(hot: DataFrame, common: DataFrame, shape: str) -> DataFrame:
    """(doc, start, end): runs of windows that are among ``common``.

    These are windows that repeat under a fingerprint with more than ``HOT`` places. Up to ``COMMON``
    of them go to every worker; more are joined, window by window.
    """
    if common.count() > COMMON:
        rest = _spread(hot.withColumnRenamed("first", "start")).join(common, "window")
        return rest.select("doc", "start", (F.col("start") + 1).alias("end"))
    window = common.toArrow().column(0).to_numpy()
    shared = hot.sparkSession.sparkContext.broadcast(np.sort(window))

    def mark(parts):
        known = shared.value
        for part in parts:
            blobs = part.column("windows").to_pylist()
            if not blobs or not len(known):
                continue
            sizes = np.array([len(b) for b in blobs], np.int64) // 8
            own = np.frombuffer(b"".join(blobs), np.int64)
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            repeats = known[at] == own
            doc = np.repeat(part.column("doc").to_numpy(), sizes)[repeats]
            place = batches.gather(part.column("first").to_numpy().astype(np.int64), sizes)[repeats]
            cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(place) != 1)) + 1
            starts = np.concatenate(([0], cut)) if len(doc) else cut
            ends = np.concatenate((cut, [len(doc)])) if len(doc) else cut
            yield pa.RecordBatch.from_pydict(
                {
                    "doc": doc[starts],
                    "start": place[starts].astype(np.int32),
                    "end": (place[ends - 1] + 1).astype(np.int32),
                }
            )

    return hot.mapInArrow(mark, shape)


def _spread(runs: DataFrame) -> DataFrame:
    """One row per window of (doc, start, windows) rows."""

    def spread(parts):
        for part in parts:
            blobs = part.column("windows").to_pylist()
            sizes = np.array([len(b) for b in blobs], np.int64) // 8
            which = np.repeat(np.arange(len(blobs)), sizes)
            first = part.column("start").to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "window": np.frombuffer(b"".join(blobs), np.int64),
                    "doc": part.column("doc").take(pa.array(which)),
                    "start": batches.gather(first, sizes).astype(np.int32),
                }
            )

    return runs.mapInArrow(spread, "window long, doc long, start int")


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """(doc, runs): for each document the runs of starts of windows that also start elsewhere."""
    lengths = levels(window)
    tasks = partitions(docs)
    places = None
    if len(lengths) == 1:
        lengths = [window, window]  # the window itself is short: its own length is the first level
    for n, length in enumerate(lengths[:-1]):
        if places is None:
            rows = _first_rows(docs, length, window)
        else:
            rows = _next_rows(docs, places, lengths[n - 1], length, window)
        places = _survivors(written(rows, f"windows-{length}"), f"survivors-{length}")
        if places.isEmpty():
            break
    candidates = written(_candidates(docs, places, length, window), "candidates")
    return written(
        _repeated(candidates, tasks)
        .groupBy("doc")
        .agg(F.collect_list(F.struct("start", "end")).alias("runs")),
        "repeated",
    )


def without_repeats(
    docs: DataFrame, window: int = 35, text: str = "text", doc_id: str = "doc_id", texts: bool = False
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, and ``kept`` if ``texts``.

    A word is removed when a window that covers it also starts anywhere else in the corpus, the same
    document included; windows are judged on the input. Words are compared as they are. Null and
    empty texts have no words; a text shorter than the window keeps all of them. Rows are numbered
    once and written, and told apart by number, so ids may be null or repeat, with equal texts or
    different ones. An empty table gives no rows.
    """
    plain = written(
        docs.select(
            F.monotonically_increasing_id().alias("doc"),
            F.col(doc_id).cast("long").alias("doc_id"),
            F.col(text).alias("text"),
        ),
        "rows",
    )
    runs = repeated_windows(plain.select("doc", "text"), window)

    def cut(parts):
        for part in batches.slices(parts):
            rows = zip(
                part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("runs").to_pylist()
            )
            out = []
            for doc, body, own in rows:
                found = (body or "").encode().split()
                gone = np.zeros(len(found) + 1, np.int64)
                for run in own or ():
                    gone[run["start"]] += 1
                    gone[run["end"] - 1 + window] -= 1
                keep = np.cumsum(gone)[: len(found)] == 0
                left = b" ".join(found[i] for i in np.flatnonzero(keep)) if own else b" ".join(found)
                out.append(
                    {
                        "doc_id": doc,
                        "n_words": len(found),
                        "n_removed": int(len(found) - keep.sum()),
                        "kept_sha256": hashlib.sha256(left).hexdigest(),
                        "kept": left.decode() if texts else None,
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("n_removed", pa.int64()),
            ("kept_sha256", pa.string()),
            ("kept", pa.string()),
        ]
    )
    none = F.lit(None).cast("array<struct<start:int,end:int>>")
    ids = broadcast_if_small(runs.select("doc"))
    whole = plain.join(ids, "doc", "left_anti").withColumn("runs", none)
    touched = _with_places(plain, runs)
    shape = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    out = whole.select("doc_id", "text", "runs").mapInArrow(cut, shape).unionByName(
        touched.select("doc_id", "text", "runs").mapInArrow(cut, shape)
    )
    return out if texts else out.drop("kept")
