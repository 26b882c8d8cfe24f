"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of ``BLOCK`` characters. Distinct blocks are sorted and get integers as
names; then adjacent names are paired, distinct pairs get names, and so on until each document
has one name. Equal names at the same level mean equal texts by construction, so no hash decides.
A fingerprint of a block only addresses the row that carries a block's name, which spares a second
shuffle of the texts; blocks whose fingerprints coincide are looked up by their whole text.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.shares import partitions, written

BLOCK = 8_192  # characters
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalized(column: str = "text"):
    """Null is empty; only A to Z are lower-cased."""
    return F.translate(F.coalesce(F.col(column), F.lit("")), CAPITALS, SMALL)


def _named(distinct: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """A unique integer per row: the task in the high bits, the place in sorted order in the low.

    Rows of a task are fixed by their hash and their order by the sort, so a task that runs again
    after a loss gives the same names.
    """
    return (
        distinct.repartition(tasks, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("name", F.monotonically_increasing_id())
    )


def _first_level(docs: DataFrame, tasks: int) -> DataFrame:
    """(row, doc, place, blocks, name, sha) for every block of every document."""
    cut = docs.select("row", "doc", F.sha2("text", 256).alias("sha"), "text").select(
        "row",
        "doc",
        "sha",
        F.expr(f"greatest(1, cast(ceil(char_length(text) / {BLOCK}) as int))").alias("blocks"),
        F.posexplode(
            F.expr(
                f"transform(sequence(0, greatest(0, cast(ceil(char_length(text) / {BLOCK}) as int) - 1)),"
                f" i -> substring(text, i * {BLOCK} + 1, {BLOCK}))"
            )
        ).alias("place", "block"),
    ).withColumn("address", F.xxhash64("block"))
    names = written(
        _named(cut.select("address", "block").distinct(), ["address", "block"], tasks)
        .select("address", "name", F.lit(None).cast("string").alias("block")),
        "block-names",
    )
    shared = names.groupBy("address").count().where("count > 1").select("address")
    places = cut.select(
        "row", "doc", "blocks", "place", "address", F.when(F.col("place") == 0, F.col("sha")).alias("sha")
    )
    if shared.isEmpty():
        return places.join(names.drop("block"), "address").drop("address")
    # Fingerprints that two blocks share: these blocks are named and joined by their text.
    odd = cut.join(shared, "address", "left_semi")
    odd_names = written(
        _named(odd.select("block").distinct(), ["block"], tasks).withColumn("name", -1 - F.col("name")),
        "odd-names",
    )
    plain = places.join(shared, "address", "left_anti").join(names.drop("block"), "address").drop("address")
    return plain.unionByName(
        odd.join(odd_names, "block").select(
            "row",
            "doc",
            "blocks",
            "place",
            F.when(F.col("place") == 0, F.col("sha")).alias("sha"),
            "name",
        )
    )


def identities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, sha, level, name) per row of ``docs``, where equal (level, name) means equal text.

    Rows are numbered once and written with their first names, so ``doc`` may repeat. Levels grow
    with the logarithm of the longest text.
    """
    tasks = partitions(docs)
    plain = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc", normalized(text).alias("text")
    )
    now = written(_first_level(plain, tasks), "named-blocks")
    done = now.where("blocks = 1").select("doc", "sha", F.lit(0).alias("level"), "name")
    longest = now.agg(F.max("blocks")).first()[0] or 0
    level, blocks = 0, longest
    now = now.where("blocks > 1")
    while blocks > 1:
        level, blocks = level + 1, (blocks + 1) // 2
        pairs = written(
            now.groupBy("row", F.expr("cast(place div 2 as int)").alias("place")).agg(
                F.max("doc").alias("doc"),
                F.max("blocks").alias("blocks"),
                F.max(F.expr("if(place % 2 = 0, name, null)")).alias("left"),
                F.max(F.expr("if(place % 2 = 1, name, null)")).alias("right"),
                F.max("sha").alias("sha"),
            ),
            f"pairs-{level}",
        )
        names = written(
            _named(pairs.select("left", "right").distinct(), ["left", "right"], tasks),
            f"pair-names-{level}",
        )
        now = written(
            pairs.alias("p")
            .join(
                names.alias("n"),
                (F.col("p.left") == F.col("n.left")) & F.col("p.right").eqNullSafe(F.col("n.right")),
            )
            .selectExpr(
                "p.row", "p.doc", "p.sha", "p.place", "cast(ceil(p.blocks / 2) as int) as blocks", "n.name"
            ),
            f"named-{level}",
        )
        done = done.unionByName(
            now.where("blocks = 1").select("doc", "sha", F.lit(level).alias("level"), "name")
        )
        now = now.where("blocks > 1")
    return done


def exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A to Z; null counts as empty. Of equal texts
    the largest doc_id stays. Ids are expected to be unique; of rows that repeat the largest id
    all count as kept. A null id stays only in a group of null ids. An empty table gives none.
    """
    rows = identities(
        docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")), "text"
    )
    groups = rows.groupBy("level", "name").agg(
        F.max("doc").alias("keep_id"), F.count("*").alias("group_size")
    )
    return rows.join(groups, ["level", "name"]).select(
        F.col("doc").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("doc").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
