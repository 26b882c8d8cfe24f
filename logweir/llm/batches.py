"""Arrow batches in and out of tasks, and words of whole texts as numpy arrays.

A word is a maximal run of bytes other than ASCII white space. Words and word windows are
named by 64-bit polynomial fingerprints computed over a whole slice of documents at once, so no
Python code runs per word.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text handled at a time inside a task; a longer document is handled alone.
SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_FULL = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 2), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


# A polynomial modulo 2^64 takes the same value for some different texts whatever its base, as for
# a, b and the texts that doubling makes of them; one modulo a prime does not.
_PRIME = (1 << 31) - 1
_PRIME_BASE = 1_187_654_321

_prime_powers: dict[int, np.ndarray] = {}


def prime_powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo the prime."""
    have = _prime_powers.get(base)
    if have is None or len(have) < n:
        size, have = max(n, SLICE_BYTES + 2), np.ones(1, np.uint64)
        while len(have) < size:
            have = np.concatenate((have, have * _U(pow(base, len(have), _PRIME)) % _U(_PRIME)))
        have = _prime_powers[base] = have[:size].astype(np.uint32)
    return have[:n]


class Rolling:
    """Fingerprints of any ranges of a sequence of 64-bit values that are mixed.

    Two polynomials, one modulo 2^64 and one modulo a prime, are mixed into one.
    """

    def __init__(self, values: np.ndarray, base: int = _WORD_BASE):
        n = len(values)
        self.back = powers(_inverse(base), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(base, n), out=self.sums[1:])
        self.prime_back = prime_powers(pow(_PRIME_BASE, -1, _PRIME), n + 1)
        self.prime_sums = np.zeros(n + 1, np.uint64)
        small = (values >> _U(33)) * prime_powers(_PRIME_BASE, n)
        small %= _U(_PRIME)
        np.cumsum(small, out=self.prime_sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        span = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        other = (self.prime_sums[ends] - self.prime_sums[starts]) % _U(_PRIME)
        other = other * self.prime_back[starts] % _U(_PRIME)
        return mix(mix(span + (ends - starts).astype(np.uint64) * _U(_BASE)) ^ other)


def slices(batches, column: str = "text", most: int = SLICE_BYTES):
    """Batches cut so that each holds about ``most`` bytes of ``column``, or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(int(np.searchsorted(ends, before + most, "right")), at + 1)
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows after one another, and where each row starts; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    data: np.ndarray  # bytes of the slice, lower-cased on request
    rows: np.ndarray  # byte offset of each row
    starts: np.ndarray  # byte range of each word
    ends: np.ndarray
    first: np.ndarray  # first word of each row, and the number of words
    names: np.ndarray  # fingerprint of each word

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def ranges(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words of all rows."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[rows] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(column, lower: bool = False) -> Words:
    """All words of a column of texts."""
    data, rows = text_bytes(column)
    if lower:
        data = _LOWER[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, rows, none, none, np.zeros(len(rows), np.int64), none.astype(np.uint64))
    starts, ends = ranges(data, rows)
    rolling = Rolling(_BYTE_VALUES[data], _BASE)
    return Words(
        data, rows, starts, ends, np.searchsorted(starts, rows), rolling.of(starts, ends)
    )


def byte_ranges_named(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of byte ranges."""
    if not len(data):
        return np.zeros(0, np.uint64)
    return Rolling(_BYTE_VALUES[data], _BASE).of(starts, ends)


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def short_ranges_named(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of byte ranges most of which have at most 16 bytes: those are read as two numbers."""
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    read = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))  # the eight bytes from each place
    lengths = ends - starts
    first = read[starts] & _MASKS[np.minimum(lengths, 8)]
    second = read[np.minimum(starts + 8, len(data))] & _MASKS[np.clip(lengths - 8, 0, 8)]
    names = mix(mix(first ^ (lengths.astype(np.uint64) * _U(_BASE))) + second)
    long = np.flatnonzero(lengths > 16)
    if len(long):
        sizes = lengths[long]
        to = np.cumsum(sizes)
        names[long] = byte_ranges_named(data[gather(starts[long], sizes)], to - sizes, to)
    return names


def windows(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (as word numbers) and fingerprints of all windows of ``length`` words in a row."""
    if len(w.names) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(w.names) - length + 1)
    row = w.row_of_word()
    at = at[row[at] == row[at + length - 1]]
    return at, Rolling(w.names).of(at, at + length)


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit fingerprints as Spark's long."""
    return values.view(np.int64)


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of ragged ranges after one another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - begin, counts)
