"""Plain single-process versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def crc_fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds if doc_id is not None else None


def token_files(rows, library, end_id):
    out, start = [], 0
    for doc, text in sorted(rows):
        ids = library.encode(text or "", add_special_tokens=False).ids + [end_id]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        out.append((doc, start, len(ids), zlib.crc32(raw)))
        start += len(ids)
    return out


def near_copies(rows, size, num, den):
    sets = {}
    for doc, text in rows:
        w = words(text)
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}
        sets[doc] = grams if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(d for d in sets if sets[d])
    docs.sort(key=lambda d: len(sets[d]))
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            if len(sets[a]) * den < num * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), root(d)) for d in sets)


def exact_copies(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[(text or "").translate(LOWER)].append(doc)
    return sorted(
        (d, max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest())
        for t, g in groups.items()
        for d in g
    )


def without_repeats(rows, window):
    texts = {d: words(t, lower=False) for d, t in rows}
    seen = Counter(tuple(w[i : i + window]) for w in texts.values() for i in range(len(w) - window + 1))
    out = []
    for d, w in texts.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def base_secrets(text):
    text = text or ""
    assign = re.compile(
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
        r"[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    )
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ("assign", "access", "hex")
    shown = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(found))
    count = Counter(k for _, k, _ in found)
    return count[0], count[1], count[2], hashlib.sha256(shown.encode()).hexdigest()


def all_secrets(rows, copied_from=2):
    """(doc_id, spans, live, copied) of (doc_id, text, owner) rows, comparing every pair of spans."""
    found, owners = [], {}
    for d, text, owner in rows:
        text = text or ""
        pattern = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
        own = [(m.start(), 0, m.end(), m[1]) for m in re.finditer(pattern, text) if len(m[1]) >= 6]
        own += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        own += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        more = []
        for m in re.finditer(r"[A-Za-z0-9+/_-]{24,}={0,2}", text):
            v, (s, e) = m[0], m.span()
            mixed = all(re.search(c, v) for c in ("[0-9]", "[a-z]", "[A-Z]"))
            bits = -sum(n / len(v) * math.log2(n / len(v)) for n in Counter(v).values())
            if mixed and bits >= 3.5 and not any(x[0] < e and s < x[2] for x in own):
                more.append((s, 3, e, v))
        found.append((d, sorted(own + more)))
        for x in own + more:
            owners.setdefault(x[3], set()).update(set() if owner is None else {owner})
    kinds = ("assign", "access", "hex", "owned")
    for d, spans in found:
        live = [len(owners[x[3]]) < copied_from for x in spans]
        shown = ",".join(f"{kinds[k]}:{s}:{e}" for (s, k, e, _), l in zip(spans, live) if k < 3 or l)
        yield d, shown, sum(live), len(live) - sum(live)


def unigram(rows):
    train = [(d, t) for d, t in rows if crc_fold(d, 5) != 1]
    count = Counter()
    for _, t in train:
        count.update(words(t))
        count["\0end"] += 1
    total = sum(count.values())
    below = total + 0.5 * (len(count) + 1)
    out = []
    for d, t in rows:
        own = [*words(t), "\0end"]
        base = sum(math.log10((count[w] + 0.5) / below) for w in own)
        out.append((d, crc_fold(d, 5) == 1, len(own), sum(count[w] > 0 for w in own), total, base))
    return sorted(out)


def tree_score(train, texts, depth=2):
    """Context-tree weighting with exact recursion over dictionaries of counts."""
    counts = defaultdict(lambda: [0, 0])
    for text in train:
        past = b"\0" * depth
        for byte in text:
            for d in range(depth + 1):
                node = 1
                for k in range(7, -1, -1):
                    bit = byte >> k & 1
                    counts[past[len(past) - d :], node][bit] += 1
                    node = node * 2 + bit
            past = (past + bytes([byte]))[-depth:]

    def kt(c):
        lg = math.lgamma
        return lg(c[0] + 0.5) + lg(c[1] + 0.5) - lg(c[0] + c[1] + 1) - math.log(math.pi)

    children = defaultdict(set)
    for context, node in counts:
        if context:
            children[context[1:], node].add(context)
    weighted = {}

    def weight(context, node):
        if (context, node) not in weighted:
            own = kt(counts[context, node])
            if len(context) == depth:
                weighted[context, node] = own
            else:
                below = sum(weight(c, node) for c in children[context, node])
                top = max(own, below)
                weighted[context, node] = top + math.log(
                    0.5 * math.exp(own - top) + 0.5 * math.exp(below - top)
                )
        return weighted[context, node]

    def one(past, node, d=0):
        context = past[len(past) - d :]
        c = counts[context, node] if (context, node) in counts else [0, 0]
        p = (c[1] + 0.5) / (c[0] + c[1] + 1)
        if d == depth:
            return p
        if (context, node) in counts:
            stay = 0.5 * math.exp(kt(c) - weight(context, node))
        else:
            stay = 0.5
        return stay * p + (1 - stay) * one(past, node, d + 1)

    out = []
    for text in texts:
        past, total = b"\0" * depth, 0.0
        for byte in text:
            node = 1
            for k in range(7, -1, -1):
                bit = byte >> k & 1
                p = one(past, node)
                total += math.log10(p if bit else 1 - p)
                node = node * 2 + bit
            past = (past + bytes([byte]))[-depth:]
        out.append(total)
    return out


def best_documents(items, rows, most=50):
    """(item, rank, document, score) from the formula, every document scored for every item."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(d, Counter(term.findall((t or "").translate(LOWER)))) for d, t in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    held = Counter(t for _, c, _ in docs for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        if text is not None:
            wanted[item].update(term.findall(text.translate(LOWER)))
    out = []
    for item, own in wanted.items():
        scored = []
        for doc, counts, n in docs:
            m = 100 - 50 + (50 * n * n_docs) // total
            score = 0
            for t in own & counts.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1)))
                score += w * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:most])]
    return out


def url_parts(url):
    """Host and path of a url."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :]).group()


def url_rule(host, path, rules):
    """The longest (verdict, host, path) that fits."""
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def judged_urls(rows, rules, repeats=3, support=8, literals=50, nodes=2000, alpha=0.05, prior=2.0, purity=0.75):
    """(id, host, path, rule, verdict), the tree of each host built from its pages in memory."""
    pages = []
    for id, url in rows:
        host, path = url_parts(url)
        rule = url_rule(host, path, rules)
        pages.append((id, host, path, rule, path[1:].split("/") if path else []))
    by_host = defaultdict(list)
    for page in pages:
        by_host[page[1]].append(page)
    verdicts = {}
    for host, own in by_host.items():
        at = Counter((k, s) for p in own for k, s in enumerate(p[4]))
        depth = Counter(k for p in own for k, _ in enumerate(p[4]))

        def symbol(k, s):
            if s and at[k, s] >= repeats and at[k, s] * literals >= depth[k]:
                return "=" + s
            stem, extension = re.fullmatch(r"(.*?)(\.[A-Za-z0-9]{1,5})?", s, re.S).groups()
            if not s:
                return ""
            kind = "number" if re.fullmatch("[0-9]+", stem) else "code" if re.fullmatch("[0-9A-Fa-f-]{16,}", stem) else "text"
            return f"<{kind}>{extension or ''}"

        ways = [(p, tuple(symbol(k, s) for k, s in enumerate(p[4]))) for p in own]
        count, good, bad = Counter(), Counter(), Counter()
        for p, way in ways:
            for k in range(len(way) + 1):
                count[way[:k]] += 1
                good[way[:k]] += bool(p[3]) and p[3][0] == "allow"
                bad[way[:k]] += bool(p[3]) and p[3][0] == "block"
        kept = {w for w in count if count[w] * nodes >= len(own)}
        rejected = {}

        def shares(group):
            n = sum(count[w] for w in group)
            next_ = Counter()
            for w in group:
                for c in kept:
                    if len(c) == len(w) + 1 and c[:-1] == w:
                        next_[c[-1]] += count[c]
            out = {("next", s): x / n for s, x in next_.items()}
            out["end"] = (n - sum(next_.values())) / n
            out["good"], out["bad"] = sum(good[w] for w in group) / n, sum(bad[w] for w in group) / n
            return n, out

        def grow(group):
            b, g = sum(bad[w] for w in group), sum(good[w] for w in group)
            for w in group:
                rejected[w] = (b + prior / 2) / (b + g + prior) >= purity
            children = defaultdict(list)
            for c in kept:
                if c and c[:-1] in group:
                    children[c[-1]].append(c)
            merged = []
            for s in sorted(children, key=lambda s: (-sum(count[c] for c in children[s]), s)):
                n, mine = shares(children[s])
                for other in merged:
                    m, theirs = shares(other)
                    slack = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
                    near = all(abs(mine.get(k, 0) - theirs.get(k, 0)) <= slack for k in mine.keys() | theirs.keys())
                    told = [any(good[w] + bad[w] for w in g) for g in (children[s], other)]
                    if min(n, m) >= support and near and told[0] == told[1]:
                        other += children[s]
                        break
                else:
                    merged.append(list(children[s]))
            for group in merged:
                grow(group)

        grow([()])
        for p, way in ways:
            deepest = max(k for k in range(len(way) + 1) if way[:k] in kept)
            verdicts[p[2], host] = "block" if rejected[way[:deepest]] else "allow"
    return [
        (id, host, path, rule and rule[1] + rule[2], rule[0] if rule else verdicts[path, host])
        for id, host, path, rule, _ in pages
    ]


def whitened(rows, most=8):
    """(ids, n, deviations, |whitened|, explained) of (id, vector) rows, from numpy's double solver."""
    import numpy as np

    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = np.array(x, float) - np.array(sums, float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = centred @ vectors[:, :most] / np.sqrt(values[:most])
    return [i for i, _ in rows], n, deviations, out, values[:most] / values.sum()
