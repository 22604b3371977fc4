"""Vectorised text helpers shared by the operators of this subpackage.

All work on the UTF-8 bytes of an Arrow string column: word edges come from a table
of 256 bytes (every class used here is closed under UTF-8: bytes of non-ASCII code
points are all >= 0x80), and word and window hashes from prefix sums modulo 2**64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
# Any odd bases and a splitmix finaliser.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Table of 256 flags that are True outside the inclusive ranges."""
    table = np.ones(256, bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z became a-z.
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Words of `[^\x20\x09-\x0D]+`.
NONSPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser; 0 stays 0."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, U64), np.full(size, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        held = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        if size <= 1 << 22:
            _POWERS[base] = held
    return held


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each span; equal contents have equal hashes."""
    up, down = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    out = (sums[ends] - sums[starts]) * down[starts]
    return mix(out ^ ((ends - starts).astype(U64) * U64(0x2545F4914F6CDD1D)))


def window_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (over document borders as well)."""
    if len(words) < k:
        return np.empty(0, U64)
    starts = np.arange(len(words) - k + 1)
    return spans_hash(words, starts, starts + k, WORD_BASE)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32) if len(column) else np.zeros(1, np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else offsets
    buffer = column.buffers()[2] if len(column) else None
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of a block of documents.

    `starts`/`ends` are byte positions in `data`, `hashes` one uint64 a word, and
    document d has the words `first[d]` up to `first[d + 1]`.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, flags: np.ndarray, lower: bool, hashed: bool = True):
        self.data = LOWER[data] if lower else data
        inside = flags[self.data]
        before = np.empty(len(inside), bool)
        if len(inside):
            before[0] = False
            before[1:] = inside[:-1]
            edges = offsets[:-1]
            before[edges[edges < len(inside)]] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty(len(inside), bool)
        if len(inside):
            after[-1] = False
            after[:-1] = inside[1:] & before[1:]
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = long_spans_hash(self.data, self.starts, self.ends) if hashed else None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def documents(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def blocks(column: pa.Array, limit: int):
    """Slices (begin, end) of rows with at most `limit` bytes, or one row if it is longer."""
    _, offsets = column_bytes(column)
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), n)
        yield begin, end
        begin = end


def gathered(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in parts of up to `limit` bytes of text each (or one row)."""
    held, total = [], 0
    for batch in batches:
        _, offsets = column_bytes(batch.column(text))
        for begin, end in blocks(batch.column(text), limit):
            size = int(offsets[end] - offsets[begin])
            if held and total + size > limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, total = [], 0
            held.append(batch.slice(begin, end - begin))
            total += size
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for counts[i] values each, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.repeat(np.asarray(starts, np.int64) - before, counts) + np.arange(total)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags of the positions below n that lie in any span."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Flags of the keys that occur at least twice."""
    n = len(keys)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    bits = np.uint64(max(n - 1, 1).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = np.sort((keys & ~low) | np.arange(n, dtype=np.uint64))
    same = (packed[1:] ^ packed[:-1]) <= low
    near = np.zeros(n, bool)
    near[1:] = same
    near[:-1] |= same
    at = (packed[near] & low).astype(np.int64)  # equal in their high bits: few
    _, inverse, counts = np.unique(keys[at], return_inverse=True, return_counts=True)
    out[at] = counts[inverse] > 1
    return out


def keyed(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that also tell the owner (a document) apart."""
    return mix(values ^ mix(owner.astype(np.uint64) + np.uint64(1)))


def long_spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """spans_hash of bytes for sorted spans that don't overlap, in steps of bounded memory."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, side="right")))
        a = starts[i]
        out[i:j] = spans_hash(_BYTE_CODES[data[a : ends[j - 1]]], starts[i:j] - a, ends[i:j] - a, BYTE_BASE)
        i = j
    return out


def give_back() -> None:
    """Return freed memory to the system: idle Python workers stay alive between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
