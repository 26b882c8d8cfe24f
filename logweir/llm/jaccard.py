"""N-gram Jaccard join by R-trees over group counts.

The shingles of a document are hashed into groups; the numbers of its shingles per group are a point.
The overlap of two documents is at most the sum of the coordinate minima of their points, and of two
boxes of points at most the sum of the minima of their upper corners. A join of two R-trees drops
pairs of boxes and then of points whose bound is too low, and verifies the rest on the shingles.

One tree over all points would compare everything of similar size, because the slack that a
similarity of 0.9 leaves is larger than the spread of any coordinate. So there is a forest. Within a
class of sizes two linked documents differ in at most ``k`` shingles, so of ``k + 1 + spare`` groups
they agree in ``1 + spare`` or more. In any order of group contents that all documents share, each may
leave out its last ``spare`` and two linked ones still have one in common. The order is from rare to
frequent over the whole corpus, so passages that many documents share string no families together.
Documents that share a content that both keep are strung together, and each family that results
has trees of its own. No linked pair is split. Large families are dealt into tiles, a tree each,
and pairs of tiles are joined in separate tasks.

Equal sets are one point. Where components alone are asked for, two documents of a pair of tiles that
are already connected are not compared again. Where links are counted, every candidate pair is
verified, and a pair of tiles gives sums by document and the links that connect, never all pairs.
"""

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm import batches
from logweir.llm.linked import components, contract
from logweir.llm.shares import partitions, written
from logweir.session import broadcast_if_small

RATIO = 1.5  # of the largest to the smallest set in a size class
SPARE = 2  # least number of groups that must agree beyond the first
TILE = 2_048  # documents in a tree
TILE_SHINGLES = 2_000_000  # shingles of its documents, 8 bytes each
COORDINATES = 64
LEAF = 16  # points in a leaf box


def shingle_sets(w: batches.Words, size: int):
    """For each row the sorted distinct fingerprints of its shingles."""
    at, names = batches.windows(w, size)
    owner = w.row_of_word()[at]
    edges = np.searchsorted(owner, np.arange(len(w.first)))
    counts = np.diff(w.first)
    whole = batches.Rolling(w.names)
    for row in range(len(counts)):
        if counts[row] == 0:
            yield np.zeros(0, np.uint64)
        elif counts[row] < size:
            yield whole.of(w.first[row : row + 1], w.first[row + 1 : row + 2])
        else:
            yield np.unique(names[edges[row] : edges[row + 1]])


def identity(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit fingerprints of a set."""
    with np.errstate(over="ignore"):
        one = batches.mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
        two = batches.mix(shingles ^ np.uint64(batches._WORD_BASE)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


class Classes:
    """Size classes, and the number of groups in each, for links of at least ``share`` of the union."""

    def __init__(self, share: Fraction):
        self.share = share
        edge, self.edges = 1, [1]
        while edge < 1 << 40:
            edge = max(edge + 1, int(edge * RATIO))
            self.edges.append(edge)

    def of(self, n: int) -> list[int]:
        """The class of a set of ``n`` shingles, and the next one if a larger partner is in it."""
        own = int(np.searchsorted(self.edges, n, "right")) - 1
        return [own, own + 1] if Fraction(n) / self.share >= self.edges[own + 1] else [own]

    def groups(self, level: int) -> tuple[int, int]:
        """Number of groups of the class, and how many a set may leave out (``spare``).

        Two linked sets of the class differ in fewer groups than the first less the second.
        """
        largest = self.edges[level + 1] - 1
        differ = int((1 - self.share) / (1 + self.share) * 2 * largest)
        spare = max(SPARE, differ // 2)
        return differ + 1 + spare, spare


def signatures(shingles: np.ndarray, classes: Classes) -> list[tuple[int, np.ndarray]]:
    """For each class of a set: how many of its names may still be left out, and the names.

    A name stands for a group and its content. Empty groups count as the most frequent contents, the
    later the more frequent, so they are left out first and mostly need no name.
    """
    out = []
    for level in classes.of(len(shingles)):
        groups, spare = classes.groups(level)
        group = (batches.mix(shingles) >> np.uint64(20)) % np.uint64(groups)
        order = np.argsort(group, kind="stable")
        group, own = group[order], batches.mix(shingles[order] + np.uint64(7))
        starts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1))
        sums = np.add.reduceat(own, starts)
        head = np.uint64(((level + 1) << 40) % (1 << 64))
        names = batches.mix(sums ^ batches.mix(group[starts] + head))
        empty = groups - len(starts)
        if empty > spare:
            hollow = np.setdiff1d(np.arange(groups, dtype=np.uint64), group[starts])[: empty - spare]
            names = np.concatenate((names, batches.mix(batches.mix(hollow + head) + np.uint64(11))))
        out.append((max(spare - empty, 0), names))
    return out


def point(shingles: np.ndarray) -> np.ndarray:
    """Number of shingles per group."""
    group = (batches.mix(shingles) >> np.uint64(33)) % np.uint64(COORDINATES)
    return np.bincount(group.astype(np.int64), minlength=COORDINATES)


class Tree:
    """A packed R-tree: points in leaves of ``LEAF``, sorted by size and then by their counts."""

    def __init__(self, points: np.ndarray):
        self.points, self.sizes = points, points.sum(1)
        order = np.lexsort((points[:, 1], points[:, 0], self.sizes // 8))
        self.levels = []  # from the leaves up: (upper corners, least size, members)
        members = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
        upper = np.stack([points[m].max(0) for m in members])
        least = np.array([self.sizes[m].min() for m in members])
        most = np.array([self.sizes[m].max() for m in members])
        self.levels.append((upper, least, most, members))
        while len(members) > 1:
            members = [np.arange(i, min(i + LEAF, len(upper))) for i in range(0, len(upper), LEAF)]
            least = np.array([least[m].min() for m in members])
            most = np.array([most[m].max() for m in members])
            upper = np.stack([upper[m].max(0) for m in members])
            self.levels.append((upper, least, most, members))


def _needed(a, b, share: Fraction):
    """Least overlap of linked sets of sizes a and b: overlap >= share * (a + b - overlap)."""
    num, den = share.numerator, share.denominator
    return -(-num * (a + b) // (num + den))


def boxes(one: Tree, two: Tree, share: Fraction):
    """Pairs of points whose bound on the overlap reaches what a link needs, as two arrays a leaf pair."""
    depth_one, depth_two = len(one.levels) - 1, len(two.levels) - 1
    pairs = [(depth_one, 0, depth_two, 0)]
    while pairs:
        da, a, db, b = pairs.pop()
        upper_a, least_a, _, members_a = (x[a] if i < 3 else x for i, x in enumerate(one.levels[da]))
        upper_b, least_b, _, members_b = (x[b] if i < 3 else x for i, x in enumerate(two.levels[db]))
        if np.minimum(upper_a, upper_b).sum() < _needed(int(least_a), int(least_b), share):
            continue
        if da and (da >= db or not db):
            pairs += [(da - 1, int(m), db, b) for m in members_a[a]]
        elif db:
            pairs += [(da, a, db - 1, int(m)) for m in members_b[b]]
        else:
            x, y = members_a[a], members_b[b]
            bound = np.minimum(one.points[x][:, None], two.points[y][None]).sum(2)
            enough = bound >= _needed(one.sizes[x][:, None], two.sizes[y][None], share)
            i, j = np.nonzero(enough)
            if len(i):
                yield x[i], y[j]


def candidates(one: Tree, two: Tree, share: Fraction):
    """The same pairs one by one."""
    for x, y in boxes(one, two, share):
        yield from zip(x.tolist(), y.tolist())


def joined(docs_one, sets_one, docs_two, sets_two, share: Fraction) -> list[tuple[int, int]]:
    """Links that connect all documents of two tiles that links connect (one tile: pass it twice)."""
    same = docs_one is docs_two
    one = Tree(np.stack([point(s) for s in sets_one]))
    two = one if same else Tree(np.stack([point(s) for s in sets_two]))
    parent = list(range(len(docs_one) + (0 if same else len(docs_two))))
    shift = 0 if same else len(docs_one)

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in candidates(one, two, share):
        if same and i >= j:
            continue
        x, y = root(i), root(j + shift)
        if x == y:
            continue
        a, b = sets_one[i], sets_two[j]
        overlap = len(np.intersect1d(a, b, assume_unique=True))
        if overlap >= share * (len(a) + len(b) - overlap):
            parent[x] = y
            out.append((docs_one[i], docs_two[j]))
    return out


def counted(sets_one, copies_one, sets_two, copies_two, share: Fraction):
    """Numbers of linked rows by set, for both tiles, and (i, j) of links that connect what links connect.

    A partner counts as often as its set occurs. One tile: pass the same list of sets twice.
    """
    same = sets_one is sets_two
    one = Tree(np.stack([point(s) for s in sets_one]))
    two = one if same else Tree(np.stack([point(s) for s in sets_two]))
    found = list(boxes(one, two, share))
    n_one, n_two = np.zeros(len(sets_one), np.int64), np.zeros(len(sets_two), np.int64)
    edges: list[tuple[int, int]] = []
    if not found:
        return n_one, n_two, edges
    x, y = (np.concatenate([f[k] for f in found]) for k in range(2))
    if same:
        x, y = x[x < y], y[x < y]
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    cuts = np.searchsorted(x, np.arange(len(sets_one) + 1))
    # Shingles as places among those of the second tile, so a set is looked up by marks.
    sizes_one, sizes_two = (np.array([len(s) for s in sets]) for sets in (sets_one, sets_two))
    distinct, labels = np.unique(np.concatenate(sets_two), return_inverse=True)
    starts = np.cumsum(sizes_two) - sizes_two
    marks = np.zeros(len(distinct), np.int32)
    num, den = share.numerator, share.denominator
    group = np.arange(len(sets_one) + (0 if same else len(sets_two)))
    shift = 0 if same else len(sets_one)
    for i in np.flatnonzero(np.diff(cuts)):
        js = y[cuts[i] : cuts[i + 1]]
        at = np.searchsorted(distinct, sets_one[i])
        at = at[at < len(distinct)] if len(at) and at[-1] == len(distinct) else at
        at = at[distinct[at] == sets_one[i][: len(at)]]
        marks[at] = 1
        if 4 * len(js) > len(sets_two):
            overlap = np.add.reduceat(marks[labels], starts)[js]
        else:
            own = sizes_two[js]
            overlap = np.add.reduceat(marks[labels[batches.gather(starts[js], own)]], np.cumsum(own) - own)
        marks[at] = 0
        overlap = overlap.astype(np.int64)
        js = js[den * overlap >= num * (sizes_one[i] + sizes_two[js] - overlap)]
        n_one[i] += copies_two[js].sum()
        n_two[js] += copies_one[i]
        others, first = np.unique(group[js + shift], return_index=True)
        for other, k in zip(others.tolist(), first.tolist()):
            if other != group[i]:
                edges.append((int(i), int(js[k])))
                group[group == other] = group[i]
    return n_one, n_two, edges


def _described(docs: DataFrame, size: int, share: Fraction, groups: bool) -> DataFrame:
    """(doc, doc_id, n, one, two, classes): the size of each document's set, its fingerprints and its groups.

    Classes are null without ``groups``; they take more room than the texts, so they are made where
    they are shuffled and never stored. A task gives the groups of a set once, however often the
    set occurs.
    """
    shape = pa.list_(pa.struct([("spare", pa.int64()), ("names", pa.list_(pa.int64()))]))

    def describe(parts):
        classes, seen = Classes(share), set()
        for part in batches.slices(parts):
            w = batches.words(part.column("text"), lower=True)
            sets = list(shingle_sets(w, size))
            ids = [identity(s) for s in sets]
            found = []
            for own, one in zip(sets, ids):
                new = groups and len(own) > 0 and one not in seen
                seen.add(one)
                found.append(
                    [{"spare": n, "names": batches.signed(x)} for n, x in signatures(own, classes)] if new else None
                )
            yield pa.RecordBatch.from_pydict(
                {
                    "doc": part.column("doc"),
                    "doc_id": part.column("doc_id"),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "one": pa.array([x[0] for x in ids], pa.int64()),
                    "two": pa.array([x[1] for x in ids], pa.int64()),
                    "classes": pa.array(found, shape),
                }
            )

    return docs.mapInArrow(
        describe,
        "doc long, doc_id long, n long, one long, two long, classes array<struct<spare: long, names: array<long>>>",
    )


def _families(grouped: DataFrame, described: DataFrame, tasks: int) -> DataFrame:
    """(one, family): sets strung together by groups they share; sets that share none are left out.

    A set goes by the number of a row that has it, which takes less room in a shuffle than its
    fingerprint; a set that several tasks described has as many numbers and is tied to itself.
    """

    def stars(parts):
        """Rows come sorted by name and row number: each set is tied to the first of its group."""
        name = least = None
        for part in parts:
            if not part.num_rows:
                continue
            names, ones = part.column("name").to_numpy(), part.column("doc").to_numpy()
            starts = np.concatenate(([True], np.diff(names) != 0))
            first = ones[np.maximum.accumulate(np.where(starts, np.arange(len(ones)), 0))].copy()
            if names[0] == name:
                first[: int(np.searchsorted(names, name, "right"))] = least
            name, least = names[-1], first[-1]
            keep = first != ones
            yield pa.RecordBatch.from_pydict({"a": ones[keep], "b": first[keep]})

    # One row per set and group: a large family is spread over its many groups.
    shared = (
        grouped.where("classes is not null")
        .select("doc", F.posexplode("classes").alias("class", "c"))
        .select("doc", "class", "c.spare", F.explode(F.array_distinct("c.names")).alias("name"))
        .repartition(tasks, "name")
        .withColumn("holders", F.count("*").over(Window.partitionBy("name")))
        .where("holders > 1")
    )
    # A name held once ties nothing and is rarer than all others, so only shared names are ranked.
    frequent_first = Window.partitionBy("doc", "class").orderBy(F.desc("holders"), "name")
    kept = shared.withColumn("place", F.row_number().over(frequent_first)).where("place > spare")
    edges = (
        kept.select("doc", "name")
        .repartition(tasks, "name")
        .sortWithinPartitions("name", "doc")
        .mapInArrow(lambda parts: contract(stars(parts)), "a long, b long")
    )
    strung = components(edges, within=True).selectExpr("node AS doc", "component AS family")
    return described.select("doc", "one").join(strung, "doc").select("one", "family").distinct()


def _links(docs: DataFrame, chosen: DataFrame, size: int, share: Fraction, count: bool) -> DataFrame:
    """(a, b, n): links that connect every two documents of a family that links connect.

    With ``count`` also rows with a null ``b``: ``n`` linked rows of document ``a`` in a pair of tiles.
    ``chosen`` has (doc, family, n, copies), one document for each set. Sizes are cut into bands as wide as
    two linked sizes can lie apart, so a tile only meets tiles of its own band and the next.
    """
    width = math.log(1 / share) * 1.0001 if share < 1 else 1e-9
    banded = chosen.withColumn("band", F.floor(F.log("n") / F.lit(width)))
    counts = written(
        banded.groupBy("family", "band").agg(
            F.ceil(F.greatest(F.count("*") / F.lit(TILE), F.sum("n") / F.lit(TILE_SHINGLES)))
            .cast("int")
            .alias("tiles")
        ),
        "bands",
    )
    tiled = banded.join(counts, ["family", "band"])
    for name, step in (("below", 1), ("above", -1)):
        near = counts.select("family", (F.col("band") + step).alias("band"), F.col("tiles").alias(name))
        tiled = tiled.join(near, ["family", "band"], "left")
    others = ", ".join(
        f"if({n} IS NULL, array(), transform(sequence(0, {n} - 1), x -> (band + {step}) * {1 << 24}L + x))"
        for n, step in (("tiles", 0), ("below", -1), ("above", 1))
    )
    tiled = written(
        tiled.selectExpr(
            "doc",
            "family",
            "copies",
            f"band * {1 << 24}L + pmod(xxhash64(doc), tiles) AS tile",
            f"concat({others}) AS others",
        ),
        "tiles",
    )
    ids = broadcast_if_small(tiled.select("doc"))
    read = docs.join(ids, "doc", "left_semi").join(tiled, "doc")

    def sets(parts):
        for part in batches.slices(parts):
            w = batches.words(part.column("text"), lower=True)
            raw = [s.tobytes() for s in shingle_sets(w, size)]
            yield pa.RecordBatch.from_pydict(
                {**{c: part.column(c) for c in ("doc", "family", "copies", "tile", "others")}, "shingles": pa.array(raw, pa.binary())}
            )

    found = read.select("doc", "family", "copies", "tile", "others", "text").mapInArrow(
        sets, "doc long, family long, copies long, tile long, others array<long>, shingles binary"
    )
    # Each document goes to the pairs of its tile.
    dealt = found.withColumn("other", F.explode("others")).select(
        "family",
        F.least("tile", "other").alias("low"),
        F.greatest("tile", "other").alias("high"),
        "tile",
        "doc",
        "copies",
        "shingles",
    )

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc")
        own = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        tile, docs_ = group["tile"].to_numpy(), group["doc"].tolist()
        low, high = group["low"].iloc[0], group["high"].iloc[0]
        first = [i for i in range(len(own)) if tile[i] == low]
        second = first if low == high else [i for i in range(len(own)) if tile[i] == high]
        if not first or not second or (low == high and len(first) < 2):
            return _link_rows([], [], [])
        d1, s1 = [docs_[i] for i in first], [own[i] for i in first]
        d2, s2 = (d1, s1) if low == high else ([docs_[i] for i in second], [own[i] for i in second])
        if not count:
            links = joined(d1, s1, d2, s2, share)
            return _link_rows([a for a, _ in links], [b for _, b in links], [0] * len(links))
        copies = group["copies"].to_numpy()
        n_one, n_two, links = counted(s1, copies[first], s2, copies[second], share)
        none = [None] * (len(d1) + len(d2))
        return _link_rows(
            [d1[i] for i, _ in links] + d1 + d2,
            [d2[j] for _, j in links] + none,
            [0] * len(links) + n_one.tolist() + n_two.tolist(),
        )

    return dealt.groupBy("family", "low", "high").applyInPandas(join, "a long, b long, n long")


def _link_rows(a: list, b: list, n: list) -> pd.DataFrame:
    return pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64"), "n": pd.array(n, "Int64")})


def near_copies(
    docs: DataFrame,
    size: int = 3,
    share: Fraction = Fraction(9, 10),
    text: str = "text",
    doc_id: str = "doc_id",
    links: bool = False,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, and n_links if ``links``.

    Two documents link when their sets of ``size``-word shingles, after lower-casing A to Z, have a
    Jaccard similarity of ``share`` or more; the component is the smallest id reachable over links.
    With fewer words the whole text is one shingle; without words the set is empty and linked
    with nothing. Equal texts link. Rows are numbered once and written, and told apart by number, so
    ids may be null or repeat, with equal texts or different ones. A null id is never the smallest;
    a component of null ids alone is null. ``n_links`` is the number of other rows that a row links
    with, rows of equal sets included. Empty tables give no rows.
    """
    plain = written(
        docs.select(
            F.monotonically_increasing_id().alias("doc"),
            F.col(doc_id).cast("long").alias("doc_id"),
            F.col(text).alias("text"),
        ),
        "rows",
    )
    out = near_rows(plain, size, share, links, partitions(docs)).drop("doc", "group")
    return out if links else out.drop("n_links")


def near_rows(
    plain: DataFrame, size: int, share: Fraction, links: bool = False, tasks: int | None = None
) -> DataFrame:
    """:func:`near_copies` of written rows (doc, doc_id, text) that are numbered by ``doc``.

    Returns (doc, doc_id, n_shingles, component_id, n_links, group): ``group`` is a number that rows
    linked with one another share and no other row has.
    """
    described = written(_described(plain, size, share, False).drop("classes"), "sets")
    whole = described.where("n > 0").groupBy("one", "two").agg(
        F.min("doc").alias("doc"), F.min("doc_id").alias("least"), F.max("n").alias("n"), F.count("*").alias("copies")
    )
    families = _families(_described(plain, size, share, True), described, tasks or partitions(plain))
    chosen = whole.join(families, "one").select("doc", "family", "n", "copies")
    linking = written(_links(plain, written(chosen, "family-documents"), size, share, links), "links")
    edges = linking.where("b is not null").select("a", "b")
    found = written(components(edges).selectExpr("node AS doc", "component"), "components")
    # Numbers of rows string a component together; its name is the smallest id of its sets.
    least = found.join(whole, "doc").groupBy("component").agg(F.min("least").alias("smallest"))
    named = found.join(least, "component")
    if links:
        counts = linking.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
        named = named.join(counts.withColumnRenamed("a", "doc"), "doc")
    else:
        named = named.withColumn("others", F.lit(0))
    classes = whole.join(named, "doc", "left").select(
        "one",
        "two",
        F.coalesce("component", "doc").alias("group"),
        F.coalesce("smallest", "least").alias("component_id"),
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    linked = described.where("n > 0").join(classes, ["one", "two"]).select(
        "doc", "doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links", "group"
    )
    alone = described.where("n = 0").select(
        "doc",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("doc_id").alias("component_id"),
        F.lit(0).cast("long").alias("n_links"),
        F.col("doc").alias("group"),
    )
    return linked.unionByName(alone)
