"""Language identification by nearest centroid.

A text is lower-cased and reduced to letters with single spaces; its byte 1- to 3-grams, hashed
to ``DIMENSIONS``, weighted by TF-IDF and normalised, are compared by cosine with several centroids per
language. The centroids come from spherical k-means within each language. A text whose nearest
centroid is farther than almost all labelled texts of its language and length are from theirs is
rejected.

Document frequencies and the distances to reject at come from all labelled documents. The centroids
are fitted on about ``SAMPLED`` of them per language, drawn by a hash of id and text; rows equal in
both count once there. Every document is classified.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm import batches
from logweir.llm.shares import crc_of_id, draw, written

DIMENSIONS = 4_096
SAMPLED = 500  # expected labelled documents per language
CENTROIDS = 3  # per language
TURNS = 10  # of k-means
UNKNOWN = "und"
# A text is rejected when its cosine falls below this part of the lowest percentile of the labelled
# texts of its language and length, together with as many shorter lengths as make LEAST_TEXTS texts;
# where all of them are too few, below the lesser part of the percentile of its language.
REJECTED_BELOW = 0.8
REJECTED_BELOW_ALL = 0.3
LEAST_TEXTS = 50
LENGTHS = 32  # classes by the logarithm of the number of n-grams
BINS = 1_000  # of a cosine

# Bytes of letters and of characters beyond ASCII stay; all else separates words.
_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _has_letter(column) -> np.ndarray:
    """Rows with at least one letter of any script."""
    column = pc.fill_null(column, "")
    found = pc.match_substring_regex(column, r"\p{L}")
    return found.to_numpy(zero_copy_only=False)


def counts(column) -> np.ndarray:
    """Hashed n-gram counts, a row per text."""
    column = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    data, rows = batches.text_bytes(column)
    out = np.zeros((len(rows) - 1, DIMENSIONS), np.float32)
    # a space before each text, and one for every run of other characters
    padded = np.insert(_LETTER[data], rows[:-1], 0x20)
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows) + 1)
    keep = np.ones(len(padded), bool)
    keep[1:] = ~((padded[1:] == 0x20) & (padded[:-1] == 0x20) & (owner[1:] == owner[:-1]))
    padded, owner = padded[keep].astype(np.uint64), owner[keep]
    codes = [padded]
    if len(padded) > 1:
        codes.append((padded[:-1] << np.uint64(8)) | padded[1:] | np.uint64(1 << 32))
    if len(padded) > 2:
        codes.append(
            (padded[:-2] << np.uint64(16)) | (padded[1:-1] << np.uint64(8)) | padded[2:] | np.uint64(2 << 32)
        )
    for n, code in enumerate(codes):
        own = owner[: len(code)]
        whole = own == owner[n:]  # not across texts
        bucket = (batches.mix(code[whole]) >> np.uint64(52)).astype(np.int64)
        flat = np.bincount(own[whole] * DIMENSIONS + bucket, minlength=out.size)
        out += flat.reshape(out.shape)
    return out


def _small(parts):
    """Slices of at most 200 rows, so that their count matrices stay small."""
    for part in batches.slices(parts):
        for at in range(0, part.num_rows, 200):
            yield part.slice(at, 200)


def weighted(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Logarithmic TF times IDF, of length one."""
    x = np.log1p(count) * idf
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, started from the row nearest the mean and then the farthest rows."""

    def unit(m):
        length = np.linalg.norm(m, axis=-1, keepdims=True)
        return m / np.where(length > 0, length, 1)

    centres = x[[int((x @ unit(x.mean(0))).argmax())]]
    while len(centres) < min(k, len(x)):
        centres = np.concatenate((centres, x[[int((x @ centres.T).max(1).argmin())]]))
    for _ in range(TURNS):
        nearest = (x @ centres.T).argmax(1)
        own = [x[nearest == c].mean(0) if (nearest == c).any() else centres[c] for c in range(len(centres))]
        centres = unit(np.stack(own))
    return centres.astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # unit rows
    language: np.ndarray  # of each centroid
    floor: np.ndarray | None = None  # per language and length, the cosine below which a text is rejected

    def nearest(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language of each text, its cosine, and the class of the text's length."""
        count = counts(column)
        cosine = weighted(count, self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        length = np.log2(1 + count.sum(1, dtype=np.float64)).astype(np.int64)
        length = np.minimum(length, LENGTHS - 1)
        return self.language[best], np.clip(cosine[np.arange(len(best)), best], 0, 1), length


def floors(texts: np.ndarray) -> np.ndarray:
    """Cosines to reject below, from numbers of texts by language, length and bin of the cosine."""

    def lowest(histogram):
        """Lower edge of the bin that holds the first percentile."""
        return int(np.searchsorted(np.cumsum(histogram), max(1, 0.01 * histogram.sum()))) / BINS

    out = np.zeros(texts.shape[:2])
    for language, by_length in enumerate(texts):
        if not by_length.any():
            continue
        for length in range(len(by_length)):
            held = np.cumsum(by_length[length::-1].sum(1))
            if held[-1] < LEAST_TEXTS:
                out[language, length] = REJECTED_BELOW_ALL * lowest(by_length.sum(0))
            else:
                first = length - int(np.searchsorted(held, LEAST_TEXTS))
                out[language, length] = REJECTED_BELOW * lowest(by_length[first : length + 1].sum(0))
    return out


def fit(labelled: DataFrame, sampled: int = SAMPLED) -> Model | None:
    """Fit on (doc_id, text, lang) rows; None if no row has a language and a letter."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    # one small row per language
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, sampled / n))])
    drawn = rows.where(draw("doc_id", "text") < share[F.col("lang")]).distinct()

    def count(parts):
        for part in _small(parts):
            keep = part.filter(pa.array(_has_letter(part.column("text"))))
            if keep.num_rows:
                raw = [x.tobytes() for x in counts(keep.column("text")).astype(np.float32)]
                yield pa.RecordBatch.from_pydict({"lang": keep.column("lang"), "counts": raw})

    found = written(drawn.mapInArrow(count, "lang string, counts binary"), "language-sample")

    def frequency(parts):
        """How many of a task's texts hold each n-gram; under -1, how many texts there are."""
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for part in _small(parts):
            own = counts(part.column("text"))[_has_letter(part.column("text"))]
            total += (own > 0).sum(0)
            n += len(own)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict(
            {"gram": np.concatenate(([-1], held)).astype(np.int64), "n": np.concatenate(([n], total[held]))}
        )

    # a row per dimension
    grams = rows.select("text").mapInArrow(frequency, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    held = {r.gram: r.n for r in grams.collect()}
    n = held.pop(-1, 0)
    if not n:
        return None
    df = np.zeros(DIMENSIONS, np.int64)
    df[list(held)] = list(held.values())
    idf = (np.log((1 + n) / (1 + df)) + 0.05).astype(np.float32)

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        x = weighted(np.stack([np.frombuffer(r, np.float32) for r in group["counts"]]), idf)
        order = np.lexsort(x.T[:8])  # the same start whatever order the rows come in
        centres = clusters(x[order], CENTROIDS)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centre": [c.tobytes() for c in centres]})

    # a few rows per language, from at most about SAMPLED each
    got = found.groupBy("lang").applyInPandas(cluster, "lang string, centre binary").collect()
    languages = sorted({r.lang for r in got})
    got = sorted(got, key=lambda r: (r.lang, bytes(r.centre)))
    model = Model(
        languages,
        idf,
        np.stack([np.frombuffer(r.centre, np.float32) for r in got]),
        np.array([languages.index(r.lang) for r in got]),
    )
    model.floor = floors(_cosines(rows, model))
    return model


def _cosines(rows: DataFrame, model: Model) -> np.ndarray:
    """Numbers of texts of ``rows`` by predicted language, length and bin of the cosine."""
    shape = (len(model.languages), LENGTHS, BINS + 1)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measure(parts):
        total = np.zeros(shape, np.int64)
        for part in _small(parts):
            column = part.column("text")
            column = column.filter(pa.array(_has_letter(column)))
            if len(column):
                best, cosine, length = shared.value.nearest(column)
                np.add.at(total, (best, length, (cosine * BINS).astype(np.int64)), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": at, "n": total.ravel()[at]})

    texts = np.zeros(shape, np.int64)
    # at most a row per cell
    summed = rows.select("text").mapInArrow(measure, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    for r in summed.collect():
        texts.ravel()[r["at"]] = r.n
    return texts


def predict(
    docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with lang_pred, score (cosine, 0 to 1) and rejected.

    A text that is null or has no letter of any script gets ``und``, score 0, and is rejected, as is
    every text if there is no model. ``keep`` lists the columns to carry along, all by default.
    """
    carried = [f for f in docs.schema.fields if keep is None or f.name in keep]
    names = [f.name for f in carried]
    rows = docs.select(F.col(text).alias("_read"), *[F.col(f"`{n}`") for n in names])
    # a model of a few centroids
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def classify(parts):
        own = shared.value
        for part in batches.slices(parts, "_read"):
            labels, scores, rejected = [], [], []
            for small in _small([pa.RecordBatch.from_arrays([part.column(0)], names=["text"])]):
                column = small.column(0)
                has = _has_letter(column)
                if own is None:
                    has[:] = False
                    best = length = np.zeros(len(has), np.int64)
                    cosine = np.zeros(len(has))
                else:
                    best, cosine, length = own.nearest(column)
                for h, b, c, n in zip(has.tolist(), best.tolist(), cosine.tolist(), length.tolist()):
                    labels.append(own.languages[b] if h else UNKNOWN)
                    scores.append(c if h else 0.0)
                    rejected.append(not h or c < own.floor[b, n])
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(labels, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(rejected, pa.bool_())],
                names=[*names, "lang_pred", "score", "rejected"],
            )

    from pyspark.sql import types as T

    shape = T.StructType(
        [
            *carried,
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )
    return rows.mapInArrow(classify, shape)


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected.

    Learns from the documents with a language whose fold is not ``held_out``. Empty tables give no
    rows; repeated rows and null ids stay; columns beyond doc_id, text and lang are not read.
    """
    fold = F.pmod(crc_of_id(), F.lit(folds)) == held_out
    rows = docs.select("doc_id", "text", "lang", F.coalesce(fold, F.lit(False)).alias("held_out"))
    model = fit(rows.where("not held_out"))
    return predict(rows, model, keep=["doc_id", "held_out"])
