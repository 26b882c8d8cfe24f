"""A corpus from raw documents to packed sequences, in stages that each write and reread a table.

Each stage takes (spark, docs, sf_dir) and returns the documents that stay, with the columns of
``documents``; the last returns the packed pieces.
"""

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm import catalog, decontaminate, exact_copies, jaccard, language_id, packing
from logweir.llm.shares import partitions, temporary, written
from logweir.session import scratch_path

# Words a shingle and similarity from which two documents are near copies.
SHINGLE, SIMILARITY = 5, Fraction(4, 5)


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """(row, document): the rows of a stage's input, numbered once and written.

    A stage tells rows apart by number, so ids may be null or repeat; the columns of a document
    travel as one, so they may have any names.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return written(docs.select(F.monotonically_increasing_id().alias("row"), whole.alias("document")), name)


def _gone(all_rows: DataFrame, stays: DataFrame) -> str:
    """Path of a table of the numbers that do not stay; it outlives what it was made from."""
    path = scratch_path(all_rows.sparkSession, "gone")
    all_rows.join(stays, "row", "left_anti").write.parquet(path)
    return path


def _without(rows: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The documents of ``rows`` whose number is not among ``gone`` (row)."""
    left = rows.join(gone, "row", "left_anti")
    return left.select(*[F.col("document").getField(c).alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier rejects; it learns from the labelled folds of the input.

    Null and letterless texts are rejected. Each row is judged for itself, so ids may be null or
    repeat; an empty table gives none.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = language_id.fit(docs.where(~F.coalesce(fold, F.lit(False))).select("doc_id", "text", "lang"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    judged = language_id.predict(docs.select("text", whole.alias("document")), model, keep=["document"])
    kept = judged.where("not rejected")
    return kept.select(*[F.col("document").getField(c).alias(c) for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; of several with that id the last read.

    A row without id stays only if all equal texts have none. Null equals the empty text. An empty
    table gives no rows.
    """
    rows = _numbered(docs, "exact-rows")
    numbers = F.struct(F.col("document.doc_id").alias("id"), "row")
    with temporary(spark):
        named = exact_copies.identities(rows.select(numbers.alias("doc"), F.col("document.text").alias("text")))
        stays = named.groupBy("level", "name").agg(F.max("doc").alias("doc"))
        gone = _gone(named.select("doc.row"), stays.select("doc.row"))
    return _without(rows, spark.read.parquet(gone), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by similarity, over any number of links, one stays: the smallest id, null last.

    Of several with that id the first read stays. A text without words links with nothing; an empty
    table gives no rows.
    """
    rows = _numbered(docs, "near-rows")
    plain = rows.select(F.col("row").alias("doc"), F.col("document.doc_id").cast("long").alias("doc_id"), F.col("document.text").alias("text"))
    with temporary(spark):
        found = jaccard.near_rows(plain, SHINGLE, SIMILARITY, tasks=partitions(docs))
        found = written(found.select(F.col("doc").alias("row"), "doc_id", "group"), "near-groups")
        first = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
        stays = found.groupBy("group").agg(F.min_by("row", first).alias("row"))
        gone = _gone(found.select("row"), stays.select("row"))
    return _without(rows, spark.read.parquet(gone), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a benchmark item go; null and empty texts and texts of other rows stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _numbered(docs, "decontamination-rows")
    plain = rows.select(F.col("row").alias("doc_id"), F.col("document.text").alias("text"))
    gone = decontaminate.contaminated(plain, benchmark).select(F.col("doc_id").alias("row")).distinct()
    return _without(rows, gone, docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of at most 1024 ids; null is the empty text."""
    path = catalog.tokenizer("byte_bpe_50k.json")
    return packing.pack(docs, path, catalog.END_ID, catalog.SEQUENCE)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# Language, near copies, tiling and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
