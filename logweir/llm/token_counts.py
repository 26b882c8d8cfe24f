"""Token counts under a sentencepiece BPE model, by merging in numpy, without making ids.

A text is cut into pre-tokens that no merge can cross. The symbols of all new pre-tokens stand in
arrays, one row per pre-token, grouped by length. In every round each row merges its own
best-ranked pair, leftmost first among equals, all rows at once; a row without a pair is done and
its surviving symbols are counted, a character outside the vocabulary as its bytes. Counts of
pre-tokens seen before come from a cache inside the worker.
"""

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm import batches

CACHED = 1_500_000
WIDTHS = (4, 8, 16, 32, 64, 128)  # longer pre-tokens are merged one at a time with a heap
MARK = "▁"
_NONE = np.iinfo(np.int32).max


class Merger:
    """Pieces, ranks and pairs of a model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        scores = {
            model.id_to_piece(i): model.get_score(i)
            for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        }
        rank = {s: n for n, s in enumerate(sorted(set(scores.values()), reverse=True))}
        long = [p for p in scores if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in long):
            raise ValueError("pieces that hold a space after other characters are not supported")
        symbols = {s: n for n, s in enumerate(sorted({c for p in scores for c in p} | set(scores)))}
        self.characters = np.array(sorted(ord(s) for s in symbols if len(s) == 1), np.int64)
        self.symbol_of = np.array([symbols[chr(c)] for c in self.characters], np.int32)
        self.weight = np.ones(len(symbols) + 1, np.int64)  # tokens of a symbol that survives
        for s, n in symbols.items():
            if s not in scores:
                self.weight[n] = len(s.encode())
        pairs = [
            (symbols[p[:i]], symbols[p[i:]], rank[scores[p]], symbols[p])
            for p in long
            for i in range(1, len(p))
            if p[:i] in symbols and p[i:] in symbols
        ]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 4)
        self.keys = (table[:, 0] << 32) | table[:, 1]
        self.ranks = np.append(table[:, 2], _NONE).astype(np.int32)
        self.merged = np.append(table[:, 3], -1).astype(np.int32)
        used = {c for p in long for c in p}
        # ASCII characters in no longer piece stand alone; a space starts a pre-token
        self.alone = np.array([b < 128 and b != 0x20 and chr(b) not in used for b in range(256)])
        self.longest_mark = max(len(p) for p in scores if not p.strip(MARK))
        self.names = np.zeros(0, np.uint64)
        self.known = np.zeros(0, np.int64)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the table, the last for none."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = np.searchsorted(self.keys, keys)
        found = (left >= 0) & (right >= 0)
        found[found] = self.keys[np.minimum(at[found], len(self.keys) - 1)] == keys[found]
        return np.where(found, at, len(self.keys))

    def _merge_rows(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols (-1 pads a row, -2 is a character outside) merged to the end, in place."""
        rows, width = symbols.shape
        if width < 2:
            return symbols
        pair = self._lookup(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(rows, width - 1)
        live, columns = np.arange(rows), np.arange(width)
        now, pair = symbols.copy(), pair
        while len(live):
            rank = self.ranks[pair]
            best = rank.argmin(1)
            row = np.arange(len(live))
            going = rank[row, best] != _NONE
            if not going.all():
                symbols[live[~going]] = now[~going]
                live, now, pair, best = live[going], now[going], pair[going], best[going]
                row = np.arange(len(live))
                if not len(live):
                    break
            made = self.merged[pair[row, best]]
            after = columns[None, :] > best[:, None]
            shifted = np.concatenate((now[:, 1:], np.full((len(live), 1), -1, np.int32)), 1)
            now = np.where(after, shifted, now)
            now[row, best] = made
            none = np.full((len(live), 1), len(self.keys))
            pair = np.where(after[:, :-1], np.concatenate((pair[:, 1:], none), 1), pair)
            follow = np.where(best + 1 < width, now[row, np.minimum(best + 1, width - 1)], -1)
            pair_at = np.minimum(best, width - 2)
            inside = best < width - 1
            pair[row[inside], pair_at[inside]] = self._lookup(made[inside], follow[inside])
            left = best > 0
            pair[row[left], best[left] - 1] = self._lookup(now[row[left], best[left] - 1], made[left])
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same for one long row, with a heap of (rank, place)."""
        n = len(symbols)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(i, j):
            if 0 <= i and j < n:
                at = self._lookup(np.array([symbols[i]]), np.array([symbols[j]]))[0]
                if at < len(self.keys):
                    heapq.heappush(heap, (int(self.ranks[at]), i, symbols[i], symbols[j]))

        whole = np.array(symbols)
        at = self._lookup(whole[:-1], whole[1:])
        heap = [
            (int(self.ranks[at[i]]), int(i), symbols[i], symbols[i + 1])
            for i in np.flatnonzero(at < len(self.keys))
        ]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if gone[i] or j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i] = int(self.merged[self._lookup(np.array([a]), np.array([b]))[0]])
            gone[j] = True
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            push(prv[i], i)
            push(i, nxt[i])
        return [s for s, g in zip(symbols, gone) if not g]

    def _count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of pre-tokens given as byte ranges."""
        own = data[batches.gather(starts, ends - starts)]
        codes = np.frombuffer(own.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        first_byte = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))
        edges = first_byte[np.concatenate(([0], np.cumsum(ends - starts)))]
        codes[codes == 0x20] = ord(MARK)
        at = np.minimum(np.searchsorted(self.characters, codes), len(self.characters) - 1)
        inside = self.characters[at] == codes
        symbols = np.where(inside, self.symbol_of[at], -2).astype(np.int32)
        outside = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
        lost = np.concatenate(([0], np.cumsum(np.where(inside, 0, outside))))
        counts = lost[edges[1:]] - lost[edges[:-1]]
        sizes, low = np.diff(edges), 0
        for width in WIDTHS:
            here = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for part in np.array_split(here, max(1, len(here) * width // 1_000_000)):
                if not len(part):
                    continue
                rows = np.full((len(part), width), -1, np.int32)
                which = np.repeat(np.arange(len(part)), sizes[part])
                place = batches.gather(np.zeros(len(part), np.int64), sizes[part])
                rows[which, place] = symbols[batches.gather(edges[:-1][part], sizes[part])]
                rows = self._merge_rows(rows)
                counts[part] += np.where(rows >= 0, self.weight[rows], 0).sum(1)
        for i in np.flatnonzero(sizes > low):
            counts[i] += self._count_long(symbols[edges[i] : edges[i + 1]])
        return counts

    def _count_long(self, symbols: np.ndarray) -> int:
        """Runs of spaces are merged from the left into longest pieces, so whole ones are taken off."""
        mark = self.symbol_of[np.searchsorted(self.characters, ord(MARK))]
        other = np.flatnonzero(symbols != mark)
        spaces = int(other[0]) if len(other) else len(symbols)
        whole = max(0, spaces // self.longest_mark - 4)
        left = self._merge_long(symbols[whole * self.longest_mark :].tolist())
        return whole + int(sum(self.weight[s] for s in left if s >= 0))

    def counts(self, column) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and tokens of each row of a column of texts."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        n_bytes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        filled = pc.replace_substring(column, MARK, " ")  # the mark itself reads as a space
        space = pa.scalar(" ", pa.large_string())
        nothing = pa.scalar("", pa.large_string())
        prefixed = pc.binary_join_element_wise(pc.if_else(n_bytes > 0, space, nothing), filled, nothing)
        data, rows = batches.text_bytes(prefixed)
        if not len(data):
            return n_bytes, np.zeros(len(rows) - 1, np.int64)
        space, alone = data == 0x20, self.alone[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        cut[rows] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        names = batches.byte_ranges_named(data, starts, ends)
        distinct, first, inverse = np.unique(names, return_index=True, return_inverse=True)
        if len(self.names) > CACHED:
            self.names, self.known = self.names[:0], self.known[:0]
        at = np.searchsorted(self.names, distinct)
        have = np.zeros(len(distinct), bool)
        inside = at < len(self.names)
        have[inside] = self.names[at[inside]] == distinct[inside]
        if not have.all():
            new = first[~have]
            fresh = self._count(data, starts[new], ends[new])
            names = np.concatenate((self.names, distinct[~have]))
            known = np.concatenate((self.known, fresh))
            order = np.argsort(names, kind="stable")
            self.names, self.known = names[order], known[order]
            at = np.searchsorted(self.names, distinct)
        total = np.concatenate(([0], np.cumsum(self.known[at][inverse])))
        return n_bytes, np.diff(total[np.searchsorted(starts, rows)])


_mergers: dict[str, Merger] = {}


def token_counts(docs: DataFrame, model: str, limit: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Tokens are those that sentencepiece gives without begin and end. Null counts as empty and has
    none; repeated rows and null ids stay as they are; an empty table gives none. One pass, no
    shuffle. ``model`` is a path that every executor can open.
    """

    def count(parts):
        if model not in _mergers:
            _mergers[model] = Merger(model)
        for part in batches.slices(parts):
            n_bytes, n_tokens = _mergers[model].counts(part.column("text"))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "n_bytes": n_bytes,
                    "n_tokens": n_tokens,
                    "over_limit": n_tokens > limit,
                }
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
