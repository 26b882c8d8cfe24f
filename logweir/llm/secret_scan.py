"""Secret scan with corpus-wide ownership of what it finds.

Three fixed patterns give the base spans. Beyond them, long unbroken tokens that look random are
candidates; each is hashed, and the numbers of distinct owners and repositories that hold a hash
separate examples that many copy from credentials that only one owner has. The latter are added
as spans of kind ``owned``. Base spans always stay; both counts are reported beside every span.
"""

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm import batches
from logweir.llm.heavy import join_heavy
from logweir.llm.shares import written

# The patterns of the three base kinds and their least lengths.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6

# Candidates beyond the base: at least so many characters with small letters, capitals and digits.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
LEAST_ENTROPY = 3.5  # bits a character
KINDS = ("assign", "access", "hex", "owned")


def _entropy(value: str) -> float:
    _, counts = np.unique(np.frombuffer(value.encode(), np.uint8), return_counts=True)
    share = counts / len(value)
    return float(-(share * np.log2(share)).sum())


def _random_looking(value: str) -> bool:
    return (
        any(c.isdigit() for c in value)
        and any("a" <= c <= "z" for c in value)
        and any("A" <= c <= "Z" for c in value)
        and _entropy(value) >= LEAST_ENTROPY
    )


def spans_of(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base kinds in order, then of candidates beside them."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted(found)
    starts = [x[0] for x in base]
    reached = [0, *accumulate((x[2] for x in base), max)]  # end of the first n spans
    extra = [
        (m.start(), 3, m.end(), m[0])
        for m in CANDIDATE.finditer(text)
        if reached[bisect_left(starts, m.end())] <= m.start() and _random_looking(m[0])
    ]
    return base + extra


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


_SCANNED = (
    "row long, doc_id long, owner string, repository string, n_assign long, n_access long, "
    "n_hex long, base_sha256 string, "
    "found array<struct<kind:string,start:long,end:long,hash:string>>"
)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, owner, repository) with all its spans, in one pass."""

    def find(parts):
        for part in batches.slices(parts):
            out = []
            ids = (part.column(c).to_pylist() for c in ("row", "doc_id", "owner", "repository", "text"))
            for row, doc, owner, repository, text in zip(*ids):
                spans = spans_of(text or "")
                base = [x for x in spans if x[1] < 3]
                out.append(
                    {
                        "row": row,
                        "doc_id": doc,
                        "owner": owner,
                        "repository": repository,
                        "n_assign": sum(x[1] == 0 for x in base),
                        "n_access": sum(x[1] == 1 for x in base),
                        "n_hex": sum(x[1] == 2 for x in base),
                        "base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(),
                        "found": [
                            {"kind": KINDS[k], "start": s, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest()}
                            for s, k, e, v in spans
                        ],
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema)

    span = pa.struct(
        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string())]
    )
    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("owner", pa.string()), ("repository", pa.string())]
        + [(n, pa.int64()) for n in ("n_assign", "n_access", "n_hex")]
        + [("base_sha256", pa.string()), ("found", pa.list_(span))]
    )
    return docs.withColumn("row", F.monotonically_increasing_id()).select(
        "row", "doc_id", "owner", "repository", "text"
    ).mapInArrow(find, _SCANNED)


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners, repositories, places: distinct ones that hold each hash, and its spans.

    Null owners and repositories are not counted. Spark makes the pairs distinct before it counts
    them, so a hash that everyone holds is as many rows as it has owners, spread over tasks.
    """
    return found.groupBy("hash").agg(
        F.count_distinct("owner").alias("owners"),
        F.count_distinct("repository").alias("repositories"),
        F.count("*").alias("places"),
    )


def secrets(
    docs: DataFrame,
    text: str = "text",
    owner: str = "source",
    repository: str = "source",
    doc_id: str = "doc_id",
    copied_from: int = 2,
    copied_into: int = 5,
) -> DataFrame:
    """Per row of ``docs``: counts of the base kinds, digest of the base spans, and all spans.

    A value counts as copied when ``copied_from`` distinct owners or ``copied_into`` distinct
    repositories hold it anywhere in the corpus, else as live-looking. A candidate beyond the base
    becomes a span ``owned`` when it is live-looking. ``span_owners`` and ``span_repositories`` give
    both counts of each span in the order of ``spans``; ``live_looking`` and ``copied`` count the
    values of all spans, base ones and copied candidates too.

    Null texts count as empty; a null owner or repository counts as none; repeated rows stay rows
    of their own; other columns are not read, whatever their names; an empty table gives none.
    """
    scanned = written(
        scan(
            docs.select(
                F.col(doc_id).cast("long").alias("doc_id"),
                F.col(text).alias("text"),
                F.col(owner).cast("string").alias("owner"),
                F.col(repository).cast("string").alias("repository"),
            )
        ),
        "secrets",
    )
    found = scanned.where(F.size("found") > 0).select(
        "row", "owner", "repository", F.explode("found").alias("f")
    ).select("row", "owner", "repository", "f.*")
    held = written(ownership(found), "secret-owners")
    judged = join_heavy(found.drop("owner", "repository"), held, ["hash"], "places").withColumn(
        "live", (F.col("owners") < copied_from) & (F.col("repositories") < copied_into)
    )
    span = F.struct(
        "start", F.array_position(F.lit(list(KINDS)), F.col("kind")).alias("k"), "end", "kind", "owners", "repositories"
    )
    per_row = judged.groupBy("row").agg(
        F.sum(F.col("live").cast("long")).alias("live_looking"),
        F.sum((~F.col("live")).cast("long")).alias("copied"),
        F.array_sort(F.collect_list(F.when((F.col("kind") != "owned") | F.col("live"), span))).alias("shown"),
    )
    none = F.array().cast("array<long>")
    return scanned.join(per_row, "row", "left").select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.coalesce(
            F.concat_ws(",", F.transform("shown", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))),
            F.lit(""),
        ).alias("spans"),
        F.coalesce("live_looking", F.lit(0)).alias("live_looking"),
        F.coalesce("copied", F.lit(0)).alias("copied"),
        F.coalesce(F.col("shown.owners"), none).alias("span_owners"),
        F.coalesce(F.col("shown.repositories"), none).alias("span_repositories"),
    )
