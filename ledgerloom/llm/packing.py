"""Packing documents into training sequences by minimum bin slack.

Each task encodes its documents, cuts off whole sequences of `capacity` tokens, and
holds the remaining pieces of up to `HELD_TOKENS` tokens. Then it fills sequences: the
longest held piece begins, and a subset-sum over the held multiset of lengths finds
the fill closest to the rest of the window. The reachable sums are the bits of one
number, shifted by each length with its count; walking back through them gives how
many pieces of each length are taken, and the same choice is repeated while the counts
last. A window that can't be filled to `slack` tokens takes the first tokens of one
more piece, whose rest is held again. What is left at the end of a task (fewer tokens
than a window) goes into sequences whose capacities are powers of two, so nothing is
padded with slack 0.

No shuffle, and no state outside the task: what a task holds is bounded by HELD_TOKENS,
one block of texts and one longest document. A task that runs again on the same rows
gives the same rows; sequence ids begin with the number of the task's partition, so
give a table that is read, not the unwritten result of a shuffle.

Defined results: null and empty texts have only the closing token; repeated rows are
packed each for itself; of equal lengths the piece held last is taken first; an empty
table gives no rows; a column to keep must not have the name of a result column
(ValueError), whatever its case.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.spelling import Remembered, Spelled, json_tokenizer
from ledgerloom.llm.textarrays import LOWER, NONSPACE, Words, column_bytes, gathered, give_back

CAPACITY = 2048
CLOSING = 1
BLOCK_BYTES = 4 << 20
HELD_TOKENS = 1 << 21
# Normalizers and pattern of tokenizers whose texts may be cut into pieces.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that these normalizers leave as they are and the pattern takes whole.
PLAIN_WORD = re.compile("[a-zß-öø-ÿ]+")
LETTER, DIGIT, OTHER, APOSTROPHE = 1, 2, 3, ord("'")
KINDS = np.zeros(256, np.uint8)  # of visible ASCII
KINDS[33:127] = OTHER
KINDS[48:58] = DIGIT
KINDS[65:91] = KINDS[97:123] = LETTER
RESULT = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def closest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, count) pairs of the multiset whose sum is closest to room from below."""
    mask = (2 << room) - 1
    reach, steps = 1, []  # bit s: a sum of s can be had
    for length in sorted((n for n in counts if n <= room), reverse=True):
        steps.append((length, reach))
        left, some = min(counts[length], room // length), 1
        while left:
            some = min(some, left)
            reach |= reach << some * length & mask
            left, some = left - some, 2 * some
        if reach >> room & 1:
            break
    at, picked = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        count = 0
        while not before >> at & 1:
            at, count = at - length, count + 1
        if count:
            picked.append((length, count))
    return picked


class Held:
    """Pieces (row, start) by length, waiting for a sequence."""

    def __init__(self):
        self.pieces: dict[int, list[tuple[int, int]]] = {}
        self.total = 0

    def add(self, length: int, row: int, start: int) -> None:
        self.pieces.setdefault(length, []).append((row, start))
        self.total += length

    def _take(self, length: int) -> tuple[int, int, int]:
        same = self.pieces[length]
        row, start = same.pop()
        if not same:
            del self.pieces[length]
        self.total -= length
        return row, start, length

    def _cut(self, size: int) -> tuple[int, int, int]:
        """The first tokens of the longest piece; its rest stays."""
        row, start, length = self._take(max(self.pieces))
        self.add(length - size, row, start + size)
        return row, start, size

    def fill(self, capacity: int, slack: int = 0) -> Iterator[list[tuple[int, int, int]]]:
        """Full sequences, as pieces (row, start, length), while tokens suffice."""
        while self.total >= capacity:
            longest = max(self.pieces)
            if longest > capacity:
                yield [self._cut(capacity)]
                continue
            counts = {n: len(p) for n, p in self.pieces.items()}
            counts[longest] -= 1
            choice = [(longest, 1), *closest({n: c for n, c in counts.items() if c}, capacity - longest)]
            wanted: dict[int, int] = {}
            for length, count in choice:
                wanted[length] = wanted.get(length, 0) + count
            missing = capacity - sum(n * c for n, c in wanted.items())
            repeats = 1 if missing > slack else min(len(self.pieces[n]) // c for n, c in wanted.items())
            for _ in range(repeats):
                window = [self._take(n) for n, c in wanted.items() for _ in range(c)]
                if missing > slack:
                    window.append(self._cut(missing))
                yield window

    def rest(self) -> Iterator[list[tuple[int, int, int]]]:
        """What is left, in sequences whose lengths are powers of two."""
        while self.total:
            yield next(self.fill(1 << self.total.bit_length() - 1))


class _Packer:
    """Sequences of one task: rows wait with their ids until their last piece is placed."""

    def __init__(self, first_sequence: int, capacity: int, schema: pa.Schema, slack: int):
        self.sequence, self.capacity, self.schema = first_sequence, capacity, schema
        self.held, self.slack = Held(), slack
        self.rows: list[pa.RecordBatch] = []
        self.ids: list[np.ndarray] = []  # of each row, from `cut` on
        self.cut: list[int] = []
        self.out: list[list] = [[] for _ in range(7)]

    def add(self, rows: pa.RecordBatch, lists: list[np.ndarray]) -> None:
        self.rows.append(rows)
        for ids in lists:
            row, whole = len(self.ids), len(ids) - len(ids) % self.capacity
            self.cut.append(whole)
            for start in range(0, whole, self.capacity):
                self._place([(row, start, self.capacity)], ids, len(ids))
            if whole < len(ids):
                self.held.add(len(ids) - whole, row, whole)
            self.ids.append(ids[whole:].copy())

    def _place(self, window, ids=None, n: int = 0) -> None:
        offset = 0
        for row, start, length in window:
            own = ids[start : start + length] if ids is not None else self.ids[row][start - self.cut[row] : start - self.cut[row] + length]
            tokens = n or self.cut[row] + len(self.ids[row])
            for column, value in zip(self.out, (row, start, length, tokens, self.sequence, offset, own.astype("<u4").tobytes()), strict=True):
                column.append(value)
            offset += length
        self.sequence += 1

    def flush(self, last: bool) -> Iterator[pa.RecordBatch]:
        for window in self.held.fill(self.capacity, self.slack):
            self._place(window)
        if last:
            for window in self.held.rest():
                self._place(window)
        rows = pa.Table.from_batches(self.rows) if self.rows else None
        if self.out[0]:
            chosen = rows.take(pa.array(self.out[0], pa.int64())).combine_chunks()
            columns = [c.combine_chunks() for c in chosen.columns]
            numbers = [pa.array(c, pa.int64()) for c in self.out[1:6]]
            yield pa.RecordBatch.from_arrays([*columns, *numbers, pa.array(self.out[6], pa.binary())], schema=self.schema)
        self.out = [[] for _ in range(7)]
        kept = sorted({row for pieces in self.held.pieces.values() for row, _ in pieces})
        place = {row: k for k, row in enumerate(kept)}
        self.rows = rows.take(pa.array(kept, pa.int64())).combine_chunks().to_batches() if kept else []
        self.ids, self.cut = [self.ids[r] for r in kept], [self.cut[r] for r in kept]
        self.held.pieces = {n: [(place[row], start) for row, start in pieces] for n, pieces in self.held.pieces.items()}


def by_pieces(tokenizer: str) -> bool:
    """Whether a tokenizer's file says that it parts texts as `piece_edges` does."""
    said = json.loads(tokenizer)
    normalizers = [n["type"] for n in (said.get("normalizer") or {}).get("normalizers", [])]
    patterns = [p["pattern"].get("Regex") for p in (said.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
    return normalizers == NORMALIZERS and patterns == [PATTERN]


class PieceEncoder:
    """Ids of pieces. Plain words go through the merges all at once, as one text parted by spaces:
    a word's last token is marked as an end of a word, and no other one of it."""

    def __init__(self, content: str):
        self.tokenizer = json_tokenizer(content)
        said = json.loads(content)
        said |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        self.merges = json_tokenizer(json.dumps(said))
        mark = said["model"].get("end_of_word_suffix")
        self.is_end = np.zeros(max(said["model"]["vocab"].values()) + 1, bool)
        self.is_end[[i for t, i in said["model"]["vocab"].items() if mark and t.endswith(mark)]] = True

    def each(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        whole = PLAIN_WORD.fullmatch
        plain = [k for k, t in enumerate(texts) if whole(t)]
        ids = self.merges.encode_batch_fast([" ".join([texts[k] for k in plain])], add_special_tokens=False)[0].ids
        ends = (np.flatnonzero(self.is_end[np.array(ids, np.int64)]) + 1).tolist()
        if len(ends) != len(plain):  # a vocabulary without such marks
            return self.each(texts)
        out: list = [None] * len(texts)
        begin = 0
        for k, end in zip(plain, ends, strict=True):
            out[k] = ids[begin:end]
            begin = end
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(rest, self.each([texts[k] for k in rest]), strict=True):
            out[k] = ids
        return out


@lru_cache(2)
def piece_encoder(content: str) -> Remembered:
    return Remembered(PieceEncoder(content))


def piece_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first piece of each text): at white space, and where letters, digits and
    other signs meet in ASCII. After an apostrophe there is no cut: it may begin a contraction."""
    words = Words(data, offsets, NONSPACE, lower=False, hashed=False)
    kind = KINDS[data]
    left, right = kind[:-1], kind[1:]
    cut = (left > 0) & (right > 0) & ((left != right) | (left == DIGIT)) & ((data[:-1] != APOSTROPHE) | (right != LETTER))
    edges = offsets[1:-1]
    cut[edges[(edges > 0) & (edges < len(data))] - 1] = False  # texts begin anew in any case
    inside = np.flatnonzero(cut) + 1
    starts, ends = np.sort(np.concatenate([words.starts, inside])), np.sort(np.concatenate([words.ends, inside]))
    return starts, ends, np.searchsorted(starts, offsets)


def id_lists(column: pa.Array, encode: Callable, closing: int | None, pieces: bool) -> list[np.ndarray]:
    """Token ids of each text."""
    end = np.array([] if closing is None else [closing], np.int32)
    if not pieces:
        texts = [t or "" for t in column.to_pylist()]
        return [np.concatenate([np.array(ids, np.int32), end]) for ids in encode.encode.each(texts)]
    data, offsets = column_bytes(column)
    data = LOWER[data]  # as the tokenizer itself does
    starts, ends, first = piece_edges(data, offsets)
    spelled = Spelled(data, starts, ends, encode)
    flat = spelled.ids()
    steps = np.concatenate([[0], np.cumsum(spelled.sizes)])[first]
    return [np.concatenate([flat[a:b], end]) for a, b in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True)]


def pack(docs: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None, capacity: int = CAPACITY,
         closing: int | None = CLOSING, slack: int = 0, held_tokens: int = HELD_TOKENS) -> DataFrame:
    """One row a piece: the columns `keep` (default: all but the text) of its document, its
    start and length there, doc_tokens, its sequence_id and offset, and its ids as
    little-endian 32-bit numbers. `tokenizer` is the content of a file of the library
    `tokenizers`, as large as its vocabulary and no larger; if it isn't known to treat
    pieces of a text independently, whole texts are encoded.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if capacity < 1 or capacity & capacity - 1:
        raise ValueError("the capacity must be a power of two")
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    result = T._parse_datatype_string(RESULT)
    clash = {c.lower() for c in keep} & {f.name.lower() for f in result}
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    schema = T.StructType([*(docs.schema[c] for c in keep), *result])
    arrow = to_arrow_schema(schema)
    content = docs.sparkSession.sparkContext.broadcast(tokenizer)
    pieces = by_pieces(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = piece_encoder(content.value)
        packer = _Packer(TaskContext.get().partitionId() << 40, capacity, arrow, slack)
        for part in gathered(batches, "_text", BLOCK_BYTES):
            packer.add(part.select(list(range(part.num_columns - 1))), id_lists(part.column("_text"), encode, closing, pieces))
            if packer.held.total >= held_tokens or len(packer.out[0]) * capacity >= held_tokens:
                yield from packer.flush(last=False)
        yield from packer.flush(last=True)
        give_back()

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)


def op13_pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's row for each piece."""
    pieces = pack(docs.select("doc_id", "text"), tokenizer)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
