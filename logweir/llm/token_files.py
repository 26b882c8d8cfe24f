"""Token ids as binary shards: each document its own zstandard frame under one shared dictionary.

A written folder holds

- ``blocks``: one row per block of a shard, with the frames of its documents after one another,
- ``index``: one row per document, with its shard, block, place and length in the block, number of
  ids, and ``start``, the ids of all documents before it,
- ``dictionary``: the dictionary, its sha256 and the byte width of an id.

Shards are ranges of the id column, so shard, block and place follow ascending document order. Spark
writes the tables and commits them; a task that is lost is simply run again.

Null texts count as empty and hold the end id alone. Repeated document ids keep all their rows,
in any order among themselves; a null id comes first. An empty table gives empty tables and an
empty dictionary. Columns beyond id and text are ignored.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm import batches, byte_bpe
from logweir.llm.shares import draw, partitions

BLOCK_BYTES = 512 << 10  # raw bytes of frames per block, at least one document
DICTIONARY_BYTES = 64 << 10
SAMPLED_DOCUMENTS = 2_000  # at most; only the size of frames depends on them
SAMPLED_BYTES = 16 << 10  # the dictionary serves short documents and learns from them

BLOCKS = "shard int, block int, dictionary_sha256 string, frames binary"
INDEX = "doc_id long, shard int, block int, place long, length long, n_ids long, start long"


def _serialized(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def _sample(docs: DataFrame) -> DataFrame | None:
    """(text): at most ``SAMPLED_DOCUMENTS`` distinct short rows, drawn by a hash of id and text.

    Rows equal in both are one, combined in the tasks that draw them, so neither null or repeated
    ids nor copies make the sample larger. None for an empty table.
    """
    rows = docs.count()
    if not rows:
        return None
    drawn = docs.withColumn("draw", draw("doc_id", "text")).where(
        (F.col("draw") < min(1.0, SAMPLED_DOCUMENTS / rows)) & (F.octet_length("text") <= SAMPLED_BYTES)
    )
    return drawn.distinct().orderBy("draw", "text").limit(SAMPLED_DOCUMENTS).select("text")


def _learned(spark: SparkSession, docs: DataFrame, path: str, width: int) -> bytes:
    """A dictionary from a sample of short documents."""
    import zstandard

    sample = _sample(docs)
    if sample is None:
        return b""

    def serialize(parts):
        encode = byte_bpe.encoder(path).encode
        for part in batches.slices(parts):
            ids, counts = encode(part.column("text"))
            cut = np.split(ids, np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_pydict({"raw": [_serialized(x, width) for x in cut]})

    # at most SAMPLED_DOCUMENTS of at most SAMPLED_BYTES
    raw = [r.raw for r in sample.mapInArrow(serialize, "raw binary").collect() if r.raw]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(raw)).as_bytes()
    except zstandard.ZstdError:  # too few documents to learn from: use them as they are
        return b"".join(sorted(raw))[-DICTIONARY_BYTES:]


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write them under ``folder``.

    ``tokenizer`` is the path of a byte-level BPE file that every executor can open.
    """
    import zstandard

    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width = 2 if len(byte_bpe.encoder(tokenizer).lengths) <= 1 << 16 else 4
    raw = _learned(spark, docs, tokenizer, width)
    digest = hashlib.sha256(raw).hexdigest()

    def blocks(parts):
        encode = byte_bpe.encoder(tokenizer).encode
        shard, block = TaskContext.get().partitionId(), 0
        known = _dictionary(raw)
        compressor = zstandard.ZstdCompressor(dict_data=known, write_content_size=True)
        ids_of, places, lengths, counts, frames, size = [], [], [], [], [], 0

        def row():
            return pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "block": pa.array([block], pa.int32()),
                    "dictionary_sha256": [digest],
                    "frames": [b"".join(frames)],
                    "doc_ids": pa.array([ids_of], pa.list_(pa.int64())),
                    "places": pa.array([places], pa.list_(pa.int64())),
                    "lengths": pa.array([lengths], pa.list_(pa.int64())),
                    "n_ids": pa.array([counts], pa.list_(pa.int64())),
                }
            )

        for part in batches.slices(parts):
            ids, per_row = encode(part.column("text"))
            docs_here = part.column("doc_id").to_pylist()
            for doc, own in zip(docs_here, np.split(ids, np.cumsum(per_row)[:-1])):
                if end_id is not None:
                    own = np.append(own, np.uint32(end_id))
                frame = compressor.compress(_serialized(own, width))
                if frames and size + len(frame) > BLOCK_BYTES:
                    yield row()
                    block += 1
                    ids_of, places, lengths, counts, frames, size = [], [], [], [], [], 0
                ids_of.append(doc)
                places.append(size)
                lengths.append(len(frame))
                counts.append(len(own))
                frames.append(frame)
                size += len(frame)
        if frames:
            yield row()

    shape = (
        "shard int, block int, dictionary_sha256 string, frames binary, "
        "doc_ids array<long>, places array<long>, lengths array<long>, n_ids array<long>"
    )
    ordered = docs.repartitionByRange(partitions(docs), "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(blocks, shape).write.option("compression", "none").parquet(f"{folder}/blocks")
    spark.createDataFrame(
        [(digest, bytearray(raw), width)], "sha256 string, dictionary binary, width int"
    ).coalesce(1).write.parquet(f"{folder}/dictionary")
    _index(spark.read.parquet(f"{folder}/blocks")).write.parquet(f"{folder}/index")


def _index(blocks: DataFrame) -> DataFrame:
    """One row per document; ``start`` from the totals of all blocks before, one row a block."""
    totals = blocks.select(
        "shard", "block", F.expr("aggregate(n_ids, 0L, (a, b) -> a + b)").alias("total")
    )
    shards = totals.groupBy("shard").agg(F.sum("total").alias("total"))
    # one small row per shard
    base, at = {}, 0
    for r in shards.orderBy("shard").collect():
        base[r.shard] = at
        at += r.total
    bases = blocks.sparkSession.createDataFrame(
        list(base.items()) or [(0, 0)], "shard int, base long"
    )
    from pyspark.sql import Window

    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = (
        totals.withColumn("before", F.coalesce(F.sum("total").over(within), F.lit(0)))
        .join(F.broadcast(bases), "shard")  # one row of 12 bytes per shard
        .select("shard", "block", (F.col("base") + F.col("before")).alias("begin"))
    )

    def spread(parts):
        for part in parts:
            for r in part.to_pylist():
                n = len(r["doc_ids"])
                counts = np.array(r["n_ids"], np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(r["doc_ids"], pa.int64()),
                        "shard": pa.array([r["shard"]] * n, pa.int32()),
                        "block": pa.array([r["block"]] * n, pa.int32()),
                        "place": pa.array(r["places"], pa.int64()),
                        "length": pa.array(r["lengths"], pa.int64()),
                        "n_ids": counts,
                        "start": r["begin"] + np.cumsum(counts) - counts,
                    }
                )

    columns = ["shard", "block", "doc_ids", "places", "lengths", "n_ids"]
    return blocks.select(*columns).join(begun, ["shard", "block"]).mapInArrow(spread, INDEX)


def documents(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents of a written folder: doc_id, start, n_ids and ``raw``, ids of ``width`` bytes each.

    With ``doc_ids`` only the blocks that hold them are read, and only their frames opened.
    """
    stored = spark.read.parquet(f"{folder}/dictionary").first()
    if hashlib.sha256(bytes(stored.dictionary)).hexdigest() != stored.sha256:
        raise ValueError(f"{folder}: the dictionary does not have the hash it was stored under")
    raw, digest = bytes(stored.dictionary), stored.sha256
    index = spark.read.parquet(f"{folder}/index")
    blocks = spark.read.parquet(f"{folder}/blocks").select(
        "shard", "block", "dictionary_sha256", "frames"
    )
    if doc_ids is not None:
        index = index.where(F.col("doc_id").isin(doc_ids))
    wanted = index.groupBy("shard", "block").agg(
        F.collect_list(F.struct("place", "length", "doc_id", "start", "n_ids")).alias("docs")
    )

    def opened(parts):
        import zstandard

        reader = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        for part in parts:
            for at in range(part.num_rows):  # one block at a time
                r = part.slice(at, 1).to_pylist()[0]
                if r["dictionary_sha256"] != digest:
                    raise ValueError("block written under another dictionary")
                found = sorted(r["docs"], key=lambda d: d["place"])
                frames = [r["frames"][d["place"] : d["place"] + d["length"]] for d in found]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([d["doc_id"] for d in found], pa.int64()),
                        "start": pa.array([d["start"] for d in found], pa.int64()),
                        "n_ids": pa.array([d["n_ids"] for d in found], pa.int64()),
                        "raw": [reader.decompress(f) if f else b"" for f in frames],
                        "frame_bytes": pa.array([len(f) for f in frames], pa.int64()),
                    }
                )

    return wanted.join(blocks, ["shard", "block"]).mapInArrow(
        opened, "doc_id long, start long, n_ids long, raw binary, frame_bytes long"
    )


def digests(read: DataFrame, width: int) -> DataFrame:
    """Per document: doc_id, start, n_tokens, crc32 of the ids as 32-bit integers, frame bytes."""

    def crc(parts):
        kind = "<u2" if width == 2 else "<u4"
        for part in parts:
            raws = part.column("raw").to_pylist()
            crcs = [zlib.crc32(np.frombuffer(x, kind).astype("<u4").tobytes()) for x in raws]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "start": part.column("start"),
                    "n_tokens": part.column("n_ids"),
                    "ids_crc32": pa.array(crcs, pa.int64()),
                    "frame_bytes": part.column("frame_bytes"),
                }
            )

    shape = "doc_id long, start long, n_tokens long, ids_crc32 long, frame_bytes long"
    return read.mapInArrow(crc, shape)


def width_of(spark: SparkSession, folder: str) -> int:
    return spark.read.parquet(f"{folder}/dictionary").first().width
