"""Upkeep of tables that a stream writes batch by batch.

Every batch has a folder of its own. Sealing rewrites the closed days of complete batches as few,
clustered files and then publishes a manifest that says which files a day has. The manifest is swapped
by one rename and nothing that it replaced is deleted at once, so a reader sees each row of
a day once, before, during and after. With its files a sealed day gets two small tables:
counts that statistics add up, and the positions of its texts' trigrams by file, which tell a text
search the files it can skip.

    path/batch=N/day=D/       rows of batch N, complete once batch=N/_SUCCESS is there
    path/_sealed/seal=S/day=D/  rows of sealed days
    path/_counts/seal=S/      rows per day, container, stack and level
    path/_trigrams/seal=S/    trigram positions by file
    path/_manifest/v...       the manifest's versions
"""

import datetime as dt
import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir import schemas
from logweir.sources import versions

FILE_BYTES = 128 << 20  # of input, for each file of a sealed day
POSITIONS = 1 << 18  # a trigram has one of so many positions
KEPT = 2  # manifests whose files stay readable

SEAL = "seal"


@dataclass(frozen=True)
class Day:
    """A sealed day: its folder, and the last batch whose rows are in it."""

    seal: str
    through: int


@dataclass
class Live:
    """What a reader reads: sealed days, and folders of batches that are in none of them."""

    version: int
    days: dict[str, Day]
    open: list[tuple[int, str, str]] = field(default_factory=list)  # batch, day, folder


def has_batches(spark: SparkSession, path: str) -> bool:
    return bool(versions.listed(spark, f"{path}/{schemas.BATCH}=*"))


def _manifest(text: str | None) -> dict[str, Day]:
    return {d: Day(**v) for d, v in json.loads(text).items()} if text else {}


def _published(spark: SparkSession, path: str, version: int, days: dict[str, Day]) -> bool:
    text = json.dumps({d: vars(v) for d, v in sorted(days.items())})
    return versions.publish(spark, f"{path}/_manifest", version, text)


def _folders(spark: SparkSession, path: str) -> list[tuple[int, str, str]]:
    """(batch, day, folder) of every complete batch."""
    done = {int(p.split(f"{schemas.BATCH}=")[1].split("/")[0]) for p in versions.listed(spark, f"{path}/{schemas.BATCH}=*/_SUCCESS")}
    out = []
    for folder in versions.listed(spark, f"{path}/{schemas.BATCH}=*/{schemas.DAY}=*"):
        batch, day = re.search(rf"{schemas.BATCH}=(\d+)/{schemas.DAY}=([^/]+)$", folder).groups()
        if int(batch) in done:
            out.append((int(batch), day, folder))
    return out


def live(spark: SparkSession, path: str) -> Live:
    version, text = versions.latest(spark, f"{path}/_manifest")
    days = _manifest(text)
    waiting = [f for f in _folders(spark, path) if f[1] not in days or f[0] > days[f[1]].through]
    return Live(version, days, waiting)


def _stored(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(schemas.DAY, T.DateType())])


def _read(spark: SparkSession, base: str, folders: list[str], schema: T.StructType) -> DataFrame:
    reader = spark.read.schema(_stored(schema))
    if not folders:
        return spark.createDataFrame([], _stored(schema))
    return reader.option("basePath", base).parquet(*folders).select(*_stored(schema).fieldNames())


def _sealed_folder(path: str, day: str, seal: str) -> str:
    return f"{path}/_sealed/{SEAL}={seal}/{schemas.DAY}={day}"


def read_open(spark: SparkSession, path: str, schema: T.StructType, at: Live) -> DataFrame:
    """Rows that no sealed day holds yet."""
    return _read(spark, path, [f for _, _, f in at.open], schema)


def read_sealed(spark: SparkSession, path: str, schema: T.StructType, at: Live) -> DataFrame:
    folders = [_sealed_folder(path, d, v.seal) for d, v in sorted(at.days.items())]
    return _read(spark, f"{path}/_sealed", folders, schema)


def read(spark: SparkSession, path: str, schema: T.StructType, at: Live | None = None) -> DataFrame:
    """All rows of the table at one version of its manifest."""
    at = at or live(spark, path)
    parts = [f for known, f in ((at.open, read_open), (at.days, read_sealed)) if known]
    frames = [f(spark, path, schema, at) for f in parts] or [_read(spark, path, [], schema)]
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


# Sealing ------------------------------------------------------------------------------------


def _bytes(spark: SparkSession, folders: list[str]) -> int:
    return sum(s.getContentSummary(at(f)).getLength() for f in folders for s, at in [versions.files(spark, f)])


def seal(spark: SparkSession, path: str, schema: T.StructType, before: dt.date) -> list[dt.date]:
    """Rewrite the days before ``before`` of all batches but the newest, which may yet be repeated.

    Returns the days. A day that later batches add rows to is sealed again, together with them. Of two
    calls at a time one gives up its work. A call that is lost leaves the table as it was.
    """
    at = live(spark, path)
    through = max((b for b, _, _ in at.open), default=0) - 1
    ready = [f for f in at.open if f[0] <= through and f[1][:1].isdigit() and dt.date.fromisoformat(f[1]) < before]
    days = sorted({d for _, d, _ in ready})
    if not days:
        return []
    again = Live(at.version, {d: at.days[d] for d in days if d in at.days}, ready)
    name = uuid.uuid4().hex
    size = _bytes(spark, [f for _, _, f in ready] + [_sealed_folder(path, d, v.seal) for d, v in again.days.items()])
    ranges = max(len(days), -(-size // FILE_BYTES))
    keys = [schemas.DAY, "container_id", "timestamp"]
    rows = read(spark, path, schema, again).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    target = f"{path}/_sealed/{SEAL}={name}"
    rows.write.partitionBy(schemas.DAY).parquet(target)
    if "message" in schema.fieldNames():
        new = _read(spark, target, [f"{target}/{schemas.DAY}={d}" for d in days], schema)
        _counts(new).coalesce(1).write.parquet(f"{path}/_counts/{SEAL}={name}")
        _positions(new).repartitionByRange("position").sortWithinPartitions("position").write.parquet(
            f"{path}/_trigrams/{SEAL}={name}"
        )
    sealed = {d: Day(name, through) for d in days}
    while not _published(spark, path, at.version + 1, at.days | sealed):
        now = live(spark, path)
        if any(now.days.get(d) != at.days.get(d) for d in days):  # another call sealed or dropped one
            for folder in ("_sealed", "_counts", "_trigrams"):
                versions.delete(spark, f"{path}/{folder}/{SEAL}={name}")
            return []
        at = now
    return [dt.date.fromisoformat(d) for d in days]


def drop_days(spark: SparkSession, path: str, oldest_kept: dt.date) -> list[dt.date]:
    """Take the days before ``oldest_kept`` out of the table, sealed or not, and delete their rows."""

    def old(day: str) -> bool:
        return day[:1].isdigit() and dt.date.fromisoformat(day) < oldest_kept

    at = live(spark, path)
    while gone := [d for d in at.days if old(d)]:
        if _published(spark, path, at.version + 1, {d: v for d, v in at.days.items() if not old(d)}):
            break
        at = live(spark, path)
    for day in gone:
        versions.delete(spark, _sealed_folder(path, day, at.days[day].seal))
    folders = [(d, f) for _, d, f in _folders(spark, path) if old(d)]
    for _, folder in folders:
        versions.delete(spark, folder)
    return sorted({dt.date.fromisoformat(d) for d in [*gone, *(d for d, _ in folders)]})


def clean(spark: SparkSession, path: str, kept: int = KEPT) -> int:
    """Delete what the newest ``kept`` manifests do not read and older ones replaced; returns folders deleted.

    Readers that pinned an older manifest than those fail, so call this less often than the
    longest query takes.
    """
    manifests = f"{path}/_manifest"
    numbers = versions.numbers(spark, manifests)
    old, new = numbers[:-kept], [_manifest(versions.read(spark, manifests, n)) for n in numbers[-kept:]]
    gone = []
    for batch, day, folder in _folders(spark, path):
        if new and all(day in m and batch <= m[day].through for m in new):
            gone.append(folder)
    named = {v.seal for m in new for v in m.values()}
    before = {v.seal for n in old for v in _manifest(versions.read(spark, manifests, n)).values()}
    for name in before - named:
        gone += [f"{path}/{f}/{SEAL}={name}" for f in ("_sealed", "_counts", "_trigrams")]
    held = {(d, v.seal) for m in new for d, v in m.items()}
    for name in before & named:  # days of a seal that were sealed again
        for folder in versions.listed(spark, f"{path}/_sealed/{SEAL}={name}/{schemas.DAY}=*"):
            if (folder.rsplit("=", 1)[1], name) not in held:
                gone.append(folder)
    for folder in gone:
        versions.delete(spark, folder)
    for number in old:
        versions.forget(spark, manifests, number)
    return len(gone)


# Statistics ---------------------------------------------------------------------------------

_COUNT_KEYS = [schemas.DAY, "container_id", "container_name", "compose_project", "level"]


def _counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_COUNT_KEYS).agg(F.count("*").alias("rows"), F.max("timestamp").alias("newest"))


def counts(spark: SparkSession, path: str, at: Live | None = None) -> DataFrame:
    """Rows per day, container, stack and level: sealed days from their counts, only open ones from rows."""
    at = at or live(spark, path)
    out = _counts(read_open(spark, path, schemas.LOGS, at))
    if at.days:
        kinds = {f.name: f.dataType for f in _stored(schemas.LOGS).fields}
        columns = [T.StructField(k, kinds[k]) for k in _COUNT_KEYS]
        columns += [T.StructField("rows", T.LongType()), T.StructField("newest", T.TimestampType())]
        columns.append(T.StructField(SEAL, T.StringType()))
        folders = [f"{path}/_counts/{SEAL}={s}" for s in sorted({v.seal for v in at.days.values()})]
        kept = spark.read.schema(T.StructType(columns)).option("basePath", f"{path}/_counts").parquet(*folders)
        # Of a day that was sealed again only the last seal counts.
        pairs = [(dt.date.fromisoformat(d), v.seal) for d, v in at.days.items()]
        wanted = spark.createDataFrame(pairs, f"{schemas.DAY} date, {SEAL} string")
        kept = kept.join(F.broadcast(wanted), [schemas.DAY, SEAL], "left_semi")  # one row a day
        out = out.unionByName(kept.drop(SEAL))
    return out


# Text search --------------------------------------------------------------------------------


def _folded(text: str) -> str:
    """Lower case, so that one index serves searches of either kind; the two small sigmas are one."""
    return f"replace(lower({text}), 'ς', 'σ')"


def _trigrams(text: str) -> str:
    """Positions of all runs of three characters; none for shorter texts."""
    folded = _folded(text)
    places = f"CASE WHEN char_length({folded}) >= 3 THEN sequence(1, char_length({folded}) - 2) END"
    return f"transform({places}, i -> int(pmod(xxhash64(substring({folded}, i, 3)), {POSITIONS})))"


def _positions(rows: DataFrame) -> DataFrame:
    """(position, day, file), once each; a text that repeats in a file is taken apart once."""
    texts = rows.select(schemas.DAY, F.col("_metadata.file_name").alias("file"), "message").distinct()
    return texts.select(schemas.DAY, "file", F.explode(F.expr(_trigrams("message"))).alias("position")).distinct()


def files_with(spark: SparkSession, path: str, text: str, at: Live) -> list[str] | None:
    """Files of sealed days that may hold ``text``, in any case; None if any may, as for short texts."""
    row = spark.createDataFrame([(text,)], "text string").selectExpr(f"{_trigrams('text')} AS found").first()
    wanted = sorted(set(row.found or []))
    if not wanted or not at.days:
        return None
    seals = sorted({v.seal for v in at.days.values()})
    schema = f"position int, {schemas.DAY} date, file string, {SEAL} string"
    index = spark.read.schema(schema).option("basePath", f"{path}/_trigrams")
    found = index.parquet(*[f"{path}/_trigrams/{SEAL}={s}" for s in seals]).where(F.col("position").isin(wanted))
    hits = found.groupBy(SEAL, schemas.DAY, "file").count().where(F.col("count") == len(wanted))
    held = {(d, v.seal) for d, v in at.days.items()}
    return sorted(
        f"{_sealed_folder(path, r[schemas.DAY].isoformat(), r[SEAL])}/{r.file}"
        for r in hits.toLocalIterator()
        if (r[schemas.DAY].isoformat(), r[SEAL]) in held
    )


def read_with_text(spark: SparkSession, path: str, text: str, at: Live | None = None) -> DataFrame:
    """All log rows but those of sealed files that cannot hold ``text``; the caller filters rows.

    Open days are read whole.
    """
    at = at or live(spark, path)
    found = files_with(spark, path, text, at)
    if found is None:
        return read(spark, path, schemas.LOGS, at)
    opened = read_open(spark, path, schemas.LOGS, at)
    return opened.unionByName(_read(spark, f"{path}/_sealed", found, schemas.LOGS))
