"""Ids of whole texts by the tokenizers library, each distinct chunk of text encoded once.

A chunk starts at an ASCII space that is followed by something other than white space, at ASCII
punctuation after a letter, or after a lone line feed between two characters that are no white
space. The tokenizer's own rule always splits there, so the ids of a text are those of its chunks in
order. Chunks seen before come from a cache inside the worker; new ones go to the library together.
"""

import os

import numpy as np

from logweir.llm import batches

CACHED_CHUNKS = 1_000_000

# Bytes that a chunk's space may not be followed by: white space, control characters, and first
# bytes of white space beyond ASCII.
_NO_CHUNK = np.zeros(256, bool)
_NO_CHUNK[:0x21] = True
_NO_CHUNK[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_PUNCTUATION = np.zeros(256, bool)
for _low, _high in ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)):
    _PUNCTUATION[_low : _high + 1] = True
_VISIBLE = np.zeros(256, bool)  # ASCII
_VISIBLE[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)  # ASCII
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LATIN = 0xC3  # first byte of U+00C0 to U+00FF, all letters but two signs
_SIGNS = (0x97, 0xB7)
SPECIAL = "<|endoftext|>"


def _letters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the characters that end at these places are letters, as far as U+00FF."""
    last = data[at]
    latin = (at > 0) & (data[at - 1] == _LATIN) & (last != _SIGNS[0]) & (last != _SIGNS[1])
    return _LETTER[last] | latin


def _cuts(data: np.ndarray) -> np.ndarray:
    """The places that chunks start at by what is around them."""
    cut = np.zeros(len(data) + 1, bool)
    at = np.flatnonzero(data[:-1] == 0x20)
    cut[at[~_NO_CHUNK[data[at + 1]]]] = True
    at = np.flatnonzero(_PUNCTUATION[data[1:]]) + 1
    cut[at[_letters(data, at - 1)]] = True
    at = np.flatnonzero(data[1:-1] == 0x0A) + 1
    seen = _VISIBLE[data[at - 1]] | _letters(data, at - 1)
    cut[at[seen & (_VISIBLE[data[at + 1]] | (data[at + 1] == _LATIN))] + 1] = True
    return cut


def _worded(chunk: bytes) -> bool:
    """Whether a chunk starts with a letter and ends with a character that is no white space."""
    starts = _LETTER[chunk[0]] or (chunk[0] == _LATIN and chunk[1] not in _SIGNS)
    return starts and (_VISIBLE[chunk[-1]] or (chunk[-2:-1] == b"\xc3" and chunk[-1] not in _SIGNS))


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # one character stands for one byte
            self.lengths[i] = len(token)
        self.forget()

    def forget(self, room: int = 0) -> None:
        """An empty cache for ``CACHED_CHUNKS``, or ``room`` if that is more."""
        size = 1 << (2 * max(room, CACHED_CHUNKS) - 1).bit_length()
        self.names = np.zeros(size, np.uint64)  # open addressing, 0 for a free place
        self.slots = np.zeros(size, np.int32)
        self.firsts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _places(self, names: np.ndarray) -> np.ndarray:
        return (names & np.uint64(len(self.names) - 1)).astype(np.int64)

    def _find(self, names: np.ndarray) -> np.ndarray:
        """The slot of each name, or -1."""
        found = np.full(len(names), -1, np.int32)
        left, at = np.arange(len(names)), self._places(names)
        while len(left):
            held = self.names[at]
            hit = held == names[left]
            found[left[hit]] = self.slots[at[hit]]
            on = ~hit & (held != 0)
            left, at = left[on], (at[on] + 1) & (len(self.names) - 1)
        return found

    def _keep(self, names: np.ndarray, slots: np.ndarray) -> None:
        """Add names that are distinct and not held."""
        at = self._places(names)
        while len(names):
            free = self.names[at] == 0
            self.names[at[free]] = names[free]  # of several for a place one stays
            mine = self.names[at] == names
            self.slots[at[mine]] = slots[mine]
            names, slots, at = names[~mine], slots[~mine], (at[~mine] + 1) & (len(self.names) - 1)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        encoded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in encoded]

    def _learn(self, names: np.ndarray, chunks: list[bytes]) -> None:
        """Encode chunks that start with a space after one another, words with a line feed before
        each, which is an id of its own there, and the others one by one."""
        joined = [i for i, c in enumerate(chunks) if c[0] == 0x20 and len(c) > 1 and not _NO_CHUNK[c[1]]]
        worded = [i for i, c in enumerate(chunks) if c[0] != 0x20 and _worded(c)]
        rest = sorted(set(range(len(chunks))) - set(joined) - set(worded))
        ids, counts = [], np.zeros(len(chunks), np.int64)
        for some, feed in ((joined, b""), (worded, b"\n")):
            for at in range(0, len(some), 5_000):
                part = some[at : at + 5_000]
                got = self._whole([(feed + feed.join(chunks[i] for i in part)).decode()])[0]
                ends = np.cumsum([len(chunks[i]) + len(feed) for i in part])
                marks = np.searchsorted(np.cumsum(self.lengths[got]), ends, "left") + 1
                counts[part] = np.diff(marks, prepend=0) - len(feed)
                ids.append(np.delete(got, np.concatenate(([0], marks[:-1]))) if feed else got)
        for i, got in zip(rest, self._whole([chunks[i].decode() for i in rest])):
            counts[i] = len(got)
            ids.append(got)
        order = joined + worded + rest
        firsts = np.zeros(len(chunks), np.int64)
        ordered = counts[order]
        firsts[order] = len(self.ids) + np.cumsum(ordered) - ordered
        self._keep(names, np.arange(len(self.firsts), len(self.firsts) + len(chunks), dtype=np.int32))
        self.firsts = np.concatenate((self.firsts, firsts))
        self.counts = np.concatenate((self.counts, counts.astype(np.int32)))
        self.ids = np.concatenate((self.ids, *ids))

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows after one another, and the number of ids of each row."""
        data, rows = batches.text_bytes(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(rows) - 1, np.int64)
        cut = _cuts(data)
        cut[rows] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        names = np.maximum(batches.short_ranges_named(data, starts, ends), np.uint64(1))
        raw = data.tobytes()
        slot = self._find(names)
        unknown = np.flatnonzero(slot < 0)
        if len(unknown):
            distinct, first = np.unique(names[unknown], return_index=True)
            if len(self.firsts) + len(distinct) > CACHED_CHUNKS:
                unknown = np.arange(len(names))
                distinct, first = np.unique(names, return_index=True)
                self.forget(len(distinct))
            new = unknown[first]
            self._learn(distinct, [raw[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist())])
            slot[unknown] = self._find(names[unknown])
        counts = self.counts[slot].astype(np.int64)
        ids = self.ids[batches.gather(self.firsts[slot], counts)]
        total = np.concatenate(([0], np.cumsum(counts)))
        per_row = np.diff(total[np.searchsorted(starts, rows)])
        special = SPECIAL.encode()
        texts = []
        if special in raw:
            texts = [i for i, (s, e) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist())) if special in raw[s:e]]
        return self._replace(ids, per_row, column, texts) if texts else (ids, per_row)

    def _replace(self, ids, per_row, column, texts):
        """A special token's text inside a document: the library takes the document whole."""
        parts = np.split(ids, np.cumsum(per_row)[:-1])
        for i, got in zip(texts, self._whole([column[i].as_py() for i in texts])):
            parts[i] = got
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
