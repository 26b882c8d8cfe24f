"""URL filter by rules, and by path templates learned from the pages that rules label.

Per host, path segments that are not frequent at their depth become wildcards by shape, so paths
become templates. Templates form a tree of nodes that hold enough of their host's pages. From the
root down, sibling branches whose continuations and labels cannot be told apart statistically are
merged. A branch is rejected if the smoothed share of blocked pages among its labelled ones is
high; without enough labels it is not. Pages that no rule fits get the verdict of their deepest node.
"""

import math
from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.heavy import join_heavy
from logweir.llm.shares import written

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """Pages of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Settings:
    repeats: int = 3  # pages of a host with a segment at its depth, from which it may be a literal
    support: int = 8  # pages from which a branch may be merged with another
    literals: int = 50  # a literal holds one in this many of its host's pages at its depth
    nodes: int = 2_000  # a node holds one in this many of its host's pages
    alpha: float = 0.05  # chance of keeping apart what is alike, per comparison
    prior: float = 2.0  # labelled pages, half of them blocked, that every branch is taken to have
    purity: float = 0.75  # smoothed share of blocked pages from which a branch is rejected


# Pages -----------------------------------------------------------------------------------------


def parsed(pages: DataFrame, rules: list[Rule], id: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, label) of every page; host and path are '' without ``://``."""
    rest = "CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) END"
    parts = pages.select(F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").alias("url")).selectExpr(
        "id",
        f"coalesce(regexp_extract({rest}, '^([^/?#]*)', 1), '') AS host",
        f"coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path",
    )
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    parts = parts.withColumn("host", F.translate("host", upper, upper.lower()))
    rule = label = None
    # Of the rules that fit the longest wins; of equally long ones the first in the list.
    for r in sorted(rules, key=lambda r: -len(r.name)):
        host = (F.col("host") == r.host) | F.col("host").endswith(F.lit(f".{r.host}"))
        fits = host & F.col("path").startswith(F.lit(r.path))
        rule = F.when(fits, r.name) if rule is None else rule.when(fits, r.name)
        label = F.when(fits, r.verdict) if label is None else label.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return parts.select(
        "id", "host", "path", (none if rule is None else rule).alias("rule"), (none if label is None else label).alias("label")
    )


# Segments between slashes; a path that ends in a slash ends in an empty one.
_SEGMENTS = "CASE WHEN path = '' THEN CAST(array() AS array<string>) ELSE split(substring(path, 2), '/', -1) END"

# The shape of a segment: its stem, and its extension if it has a short one.
_STEM = "regexp_extract({0}, '^(.*?)([.][A-Za-z0-9]{{1,5}})?$', 1)"
_EXTENSION = "regexp_extract({0}, '^(.*?)([.][A-Za-z0-9]{{1,5}})?$', 2)"


def _shape(segment: str) -> str:
    """SQL text for the wildcard of a segment; an empty segment is its own."""
    stem, extension = _STEM.format(segment), _EXTENSION.format(segment)
    return (
        f"CASE WHEN {segment} = '' THEN '' "
        f"WHEN {stem} RLIKE '^[0-9]+$' THEN concat('<number>', {extension}) "
        f"WHEN {stem} RLIKE '^[0-9A-Fa-f-]{{16,}}$' THEN concat('<code>', {extension}) "
        f"ELSE concat('<text>', {extension}) END"
    )


def _hosts(pages: DataFrame, settings: Settings) -> DataFrame:
    """(host, host_n, literals): pages of each host and its frequent segments as 'depth:segment'."""
    segments = pages.select("host", F.posexplode("segments").alias("depth", "segment"))
    counted = segments.groupBy("host", "depth", "segment").count()
    frequent = counted.where(f"count >= {settings.repeats} AND segment <> ''")
    at_depth = segments.groupBy("host", "depth").agg(F.count("*").alias("total"))
    # a host and depth is expected once for each of its frequent segments, at most
    weighed = at_depth.withColumn("weight", F.col("total"))
    literal = join_heavy(frequent, weighed, ["host", "depth"], "weight").where(
        f"count * {settings.literals} >= total"
    )
    own = literal.groupBy("host").agg(
        F.sort_array(F.collect_list(F.concat_ws(":", "depth", "segment"))).alias("literals")
    )
    hosts = pages.groupBy("host").agg(F.count("*").alias("host_n"))
    none = F.array().cast("array<string>")
    return hosts.join(own, "host", "left").withColumn("literals", F.coalesce("literals", none))


def templates(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Pages of :func:`parsed` with ``host_n`` and ``symbols``, the template of their path.

    A literal segment is a symbol that starts with '='; others are wildcards.
    """
    pages = pages.withColumn("segments", F.expr(_SEGMENTS))
    hosts = _hosts(pages, settings).withColumn("weight", F.col("host_n"))
    symbol = (
        f"CASE WHEN array_contains(literals, concat(i, ':', s)) THEN concat('=', s) ELSE {_shape('s')} END"
    )
    return join_heavy(pages, hosts, ["host"], "weight").select(
        "id", "host", "path", "rule", "label", "host_n", F.expr(f"transform(segments, (s, i) -> {symbol})").alias("symbols")
    )


# The tree --------------------------------------------------------------------------------------

# Ids of the nodes on a template's way, from its host's root down: digests, each of its parent's id
# and its own symbol. Symbols hold no slash.
_WAY = (
    "aggregate(symbols, array(sha2(host, 256)), "
    "(way, s) -> array_append(way, sha2(concat(element_at(way, -1), '/', s), 256)))"
)


def nodes(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Nodes of all hosts' trees: (host, id, parent, symbol, depth, n, allowed, blocked, templates).

    ``found`` has one row a template. A node is kept if it holds enough of its host's pages, so
    a host has a bounded number of nodes at each depth; a parent of a kept node is kept.
    """
    on_way = found.select(
        "host", "host_n", "n", "allowed", "blocked", "symbols", "way", F.posexplode("way").alias("depth", "id")
    )
    return (
        on_way.select(
            "host", "host_n", "id", "depth", "n", "allowed", "blocked",
            F.expr("CASE WHEN depth > 0 THEN way[depth - 1] END").alias("parent"),
            F.expr("CASE WHEN depth > 0 THEN symbols[depth - 1] ELSE '' END").alias("symbol"),
        )
        .groupBy("host", "host_n", "id", "parent", "symbol", "depth")
        .agg(
            F.sum("n").alias("n"),
            F.sum("allowed").alias("allowed"),
            F.sum("blocked").alias("blocked"),
            F.count("*").alias("templates"),
        )
        .where(f"n * {settings.nodes} >= host_n")
        .drop("host_n")
    )


@dataclass
class _Branch:
    """Nodes that were merged: their ids and symbols, pages, labels and what follows them."""

    ids: list
    symbols: list
    n: int
    allowed: int
    blocked: int
    follow: dict

    @property
    def labelled(self) -> int:
        return self.allowed + self.blocked

    def outcomes(self) -> dict:
        """Pages per continuation and per label."""
        known = {("next", s): n for s, n in self.follow.items()}
        known["end",] = self.n - sum(self.follow.values())
        known["allowed",] = self.allowed
        known["blocked",] = self.blocked
        return known

    def join(self, other: "_Branch") -> None:
        self.ids += other.ids
        self.symbols += other.symbols
        self.n += other.n
        self.allowed += other.allowed
        self.blocked += other.blocked
        for symbol, n in other.follow.items():
            self.follow[symbol] = self.follow.get(symbol, 0) + n


def alike(a: _Branch, b: _Branch, settings: Settings) -> bool:
    """Whether no share of an outcome differs by more than Hoeffding's bound allows.

    A branch without labels is never like one that has some, so it takes no verdict from it.
    """
    if min(a.n, b.n) < settings.support or bool(a.labelled) != bool(b.labelled):
        return False
    one, two = a.outcomes(), b.outcomes()
    slack = (0.5 * math.log(2 / settings.alpha)) ** 0.5 * (a.n**-0.5 + b.n**-0.5)
    return all(abs(one.get(k, 0) / a.n - two.get(k, 0) / b.n) <= slack for k in one.keys() | two.keys())


def merged(rows: list[dict], settings: Settings = Settings()) -> list[dict]:
    """Each node of one host's tree with its branch's template, purity and whether it is rejected.

    Branches are merged level by level: children of a branch that have the same symbol are one
    branch; then each, by falling number of pages, joins the first earlier one that it is like.
    """
    below, by_id = defaultdict(list), {}
    for r in rows:
        by_id[r["id"]] = r
        if r["parent"] is not None:
            below[r["parent"]].append(r)
    roots = [r for r in rows if r["parent"] is None]
    level = [("", _Branch([r["id"]], [], r["n"], r["allowed"], r["blocked"], {})) for r in roots]
    out = []
    while level:
        deeper = []
        for template, branch in level:
            purity = (branch.blocked + settings.prior / 2) / (branch.labelled + settings.prior)
            for id in branch.ids:
                out.append(
                    {
                        "id": id,
                        "template": template or "/",
                        "purity": purity,
                        "labelled": branch.labelled,
                        "rejected": purity >= settings.purity,
                    }
                )
            by_symbol = {}
            for child in sorted((c for id in branch.ids for c in below[id]), key=lambda c: c["id"]):
                follow = defaultdict(int)
                for c in below[child["id"]]:
                    follow[c["symbol"]] += c["n"]
                own = _Branch([child["id"]], [child["symbol"]], child["n"], child["allowed"], child["blocked"], dict(follow))
                if child["symbol"] in by_symbol:
                    own.symbols = []
                    by_symbol[child["symbol"]].join(own)
                else:
                    by_symbol[child["symbol"]] = own
            kept = []
            for own in sorted(by_symbol.values(), key=lambda b: (-b.n, b.symbols)):
                like = next((k for k in kept if alike(k, own, settings)), None)
                if like:
                    like.join(own)
                else:
                    kept.append(own)
            for own in kept:
                names = sorted(s.removeprefix("=") for s in own.symbols)
                name = names[0] if len(names) == 1 else f"({'|'.join(names)})"
                deeper.append((f"{template}/{name}", own))
        level = deeper
    return out


BRANCHES = "id string, template string, purity double, labelled long, rejected boolean"


def judge(
    pages: DataFrame, rules: list[Rule], settings: Settings = Settings(), id: str = "page_id", url: str = "url"
) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) of every page.

    A rule's verdict stands. Other pages get their branch's: block if it is rejected, else allow; a
    branch that no rule labels is never rejected. Null urls and urls without ``://`` have
    the host '' and the path ''. Ids may be null or repeat, each row is judged; other columns
    are ignored; an empty table gives no rows. Labels are those of the rules.
    """
    found = written(templates(parsed(pages, rules, id, url), settings).withColumn("way", F.expr(_WAY)), "url-pages")
    leaf = F.expr("element_at(way, -1)").alias("leaf")
    by_template = written(
        found.select("*", leaf)
        .groupBy("leaf")
        .agg(
            F.first("host").alias("host"),
            F.first("host_n").alias("host_n"),
            F.first("symbols").alias("symbols"),
            F.first("way").alias("way"),
            F.count("*").alias("n"),
            F.count_if(F.col("label") == ALLOW).alias("allowed"),
            F.count_if(F.col("label") == BLOCK).alias("blocked"),
        ),
        "url-templates",
    )
    tree = written(nodes(by_template, settings), "url-nodes")

    def merge(host: pd.DataFrame) -> pd.DataFrame:
        rows = host.astype(object).where(host.notna(), None).to_dict("records")
        return pd.DataFrame(merged(rows, settings), columns=[c.split()[0] for c in BRANCHES.split(", ")])

    branches = written(tree.groupBy("host").applyInPandas(merge, BRANCHES), "url-branches")
    weighed = branches.join(tree.select("id", "depth", "templates"), "id")
    ways = by_template.select("leaf", F.explode("way").alias("id"))
    verdicts = (
        join_heavy(ways, weighed, ["id"], "templates")
        .where("depth IS NOT NULL")
        .groupBy("leaf")
        .agg(F.max_by(F.struct("template", "purity", "rejected"), "depth").alias("branch"))
        .join(by_template.select("leaf", "n"), "leaf")
        .select("leaf", "n", "branch.*")
    )
    verdicts = written(verdicts, "url-verdicts")
    judged = join_heavy(found.select("id", "host", "path", "rule", "label", leaf), verdicts, ["leaf"], "n")
    verdict = F.coalesce("label", F.when(F.col("rejected"), BLOCK).otherwise(ALLOW))
    return judged.select(F.col("id").alias(id), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
