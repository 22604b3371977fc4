"""Alignment of two tokenizers' ids over the same bytes.

Both tokenizations of a text tile the same bytes, so each is a sorted list of the byte
positions where its tokens end. The lists are intersected by galloping: the shorter
one drives, and each of its ends is searched in the longer one from the place of the
last one found, by steps that double and then by halving what they left. The common
ends cut both lists into groups; the differences between their ranks are the sizes of
the groups.

Links, the pairs of tokens that end together, are counted over the whole corpus:

1. One pass over blocks of texts writes each document's digests and its links as
   places in the block's list of distinct id pairs, and that list with its counts.
2. The lists are summed by pair, and the highest count of each B id is marked.
3. The counts are joined back to the blocks' lists, and lists and documents meet by
   block. What is shuffled are distinct pairs of blocks, not links; a pair occurs once a
   block at most, and a block's group is bounded by its bytes of text (or one text).

A text has no tokens if it is null, empty, or not the same as either tokenizer's joined
bytes; tokens are never empty. Repeated rows count each for itself; ties for the highest
count are all highest; an empty table gives no rows; a long text is a block of its own;
a column to keep must not have the name of a result column (ValueError), whatever its
case.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.bpe import piece_spans
from ledgerloom.llm.spelling import Remembered, Spelled, json_tokenizer, piece_tokenizer
from ledgerloom.llm.tables import written
from ledgerloom.llm.textarrays import column_bytes, gathered, give_back, ranges

BLOCK_BYTES = 3 << 20
KNOWN_PIECES = 150_000  # of each tokenizer, twice
LANE = 64  # consecutive ends that one gallop runs through
SPACE = 0x20
MARK = "▁"  # stands for a space in pieces
DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
GROUPS = "a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"


# -- galloping intersection ----------------------------------------------------------------


def gallop(x: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each x the first place in y[low:high] with y >= x (high if there is none).

    x ascends, and so do the bounds. Lanes of LANE neighbours are searched side by side,
    each from the place that its last search found.
    """
    n = len(x)
    found = np.empty(n, np.int64)
    lanes = np.arange(0, n, LANE)
    at = low[lanes].copy() if n else low
    for step in range(min(LANE, n)):
        own = lanes + step
        own = own[own < n]
        at = at[: len(own)]
        want, top = x[own], high[own]
        left = np.maximum(at, low[own])  # y before left is less than want
        right = left.copy()
        reach = np.ones(len(own), np.int64)
        open_ = np.flatnonzero(right < top)
        while len(open_):  # doubling steps until y[right] >= want
            open_ = open_[y[right[open_]] < want[open_]]
            left[open_] = right[open_] + 1
            right[open_] = np.minimum(right[open_] + reach[open_], top[open_])
            reach[open_] *= 2
            open_ = open_[right[open_] < top[open_]]
        open_ = np.flatnonzero(left < right)
        while len(open_):  # halving
            middle = (left[open_] + right[open_]) // 2
            less = y[middle] < want[open_]
            left[open_[less]] = middle[less] + 1
            right[open_[~less]] = middle[~less]
            open_ = open_[left[open_] < right[open_]]
        found[own] = at = left
    return found


def common(a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in a and b of the ends that both have, document by document.

    Document d has the ends a[a_first[d]:a_first[d + 1]], likewise b; the ends of later
    documents are greater.
    """
    shorter = np.diff(a_first) <= np.diff(b_first)  # documents that a drives
    parts = []
    for drives, x, y, x_first, y_first in ((shorter, a, b, a_first, b_first), (~shorter, b, a, b_first, a_first)):
        doc = np.flatnonzero(drives)
        sizes = np.diff(x_first)[doc]
        rank = ranges(x_first[doc], sizes)
        low, high = np.repeat(y_first[doc], sizes), np.repeat(y_first[doc + 1], sizes)
        place = gallop(x[rank], y, low, high)
        hit = place < high
        hit[hit] = y[place[hit]] == x[rank[hit]]
        parts.append((rank[hit], place[hit]))
    (a1, b1), (b2, a2) = parts
    ranks_a, ranks_b = np.concatenate([a1, a2]), np.concatenate([b1, b2])
    order = np.argsort(ranks_a, kind="stable")
    return ranks_a[order], ranks_b[order]


# -- two tokenizers over a block -----------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: visible ones as
    themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(MARK, " ").encode()


def unit_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of spaces with what follows up to the next space. Every text begins with a space."""
    space = data == SPACE
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    edges = offsets[:-1]
    begins[edges[edges < len(data)]] = True
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], len(data))


class Spelling:
    """One tokenizer over a block: ids, the bytes of each id, and which texts are spelled wholly."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], tokens: list[bytes], by_units: bool | None):
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.by_units = by_units  # None: pieces of a byte-level pattern
        self.names = np.array([b"%d" % i for i in range(len(tokens))], object)
        self.plain = encode
        self.encode = Remembered(self._whole, KNOWN_PIECES)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        """Ids of each piece; none if their bytes are not the piece's."""
        lists, table = self.plain(texts), self.tokens
        return [ids if b"".join([table[i] for i in ids]) == t.encode() else [] for t, ids in zip(texts, lists, strict=True)]

    def over(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids of each text, whether its tokens' bytes are the text)."""
        if self.by_units is None:
            starts, ends = piece_spans(data, offsets)
        elif self.by_units:
            starts, ends = unit_spans(data, offsets)
        else:
            full = offsets[1:] > offsets[:-1]
            starts, ends = offsets[:-1][full], offsets[1:][full]
        spelled = Spelled(data, starts, ends, self.encode)
        first = np.searchsorted(starts, offsets)  # pieces of the texts; every piece has a token
        upto = np.concatenate([[0], np.cumsum(spelled.sizes)])
        none = np.concatenate([[0], np.cumsum(spelled.sizes == 0)])
        return spelled.ids(), np.diff(upto[first]), np.diff(none[first]) == 0


@lru_cache(2)
def byte_level(content: str) -> Spelling:
    """A byte-level BPE file of the library `tokenizers`."""
    tokenizer = json_tokenizer(content)
    alphabet = byte_alphabet()
    tokens = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        tokens[i] = bytes(alphabet[c] for c in token)
    said = json.loads(content)
    pattern = (said.get("pre_tokenizer") or {}) | {"normalizer": said.get("normalizer")}
    plain = pattern.get("type") == "ByteLevel" and pattern.get("use_regex") and not pattern.get("add_prefix_space") and pattern["normalizer"] is None
    return Spelling(lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], tokens, None if plain else False)


@lru_cache(2)
def piece_level(content: bytes) -> Spelling:
    """A model of the library `sentencepiece` that writes spaces as marks and adds one."""
    model = piece_tokenizer(content)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    lone = model.piece_to_id(MARK)
    # No piece goes on behind a word into the next space: then units are independent.
    apart = lone != model.unk_id() and not any(MARK in p.lstrip(MARK) for p in pieces)

    def encode(texts: list[str]) -> list[list[int]]:
        found = model.encode([t[1:] for t in texts], num_threads=1)  # the model adds the first space
        return [ids if len(t) > 1 else [lone] for t, ids in zip(texts, found, strict=True)]

    return Spelling(encode, [piece_bytes(p) for p in pieces], apart)


class Aligned:
    """The groups of a block of texts: ids of each side, ranks of group ends, all in order."""

    def __init__(self, column: pa.Array, a: Spelling, b: Spelling):
        data, offsets = column_bytes(column)
        self.n = n = len(offsets) - 1
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes > 0)
        data = np.insert(data, offsets[:-1][full], SPACE)
        offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, sizes + 1, 0))])
        sides = [s.over(data, offsets) for s in (a, b)]
        good = sides[0][2] & sides[1][2] & (sizes > 0)
        self.ids, self.first, ends = [], [], []
        for spelling, (ids, count, _) in zip((a, b), sides, strict=True):
            ids = ids[np.repeat(good, count)]
            self.ids.append(ids)
            self.first.append(np.concatenate([[0], np.cumsum(np.where(good, count, 0))]))
            ends.append(np.cumsum(spelling.lengths[ids]))
        #: ranks of the tokens at common ends, on each side
        self.at = common(ends[0], ends[1], *self.first)
        #: groups of document d are group_first[d] to group_first[d + 1]
        self.group_first = np.searchsorted(self.at[0], self.first[0])


def group_texts(aligned: Aligned, names: tuple[np.ndarray, np.ndarray]) -> Iterator[bytes]:
    """The ids of each document as `a1,a2|b1;a3|b2,b3`."""
    a, b = aligned.ids
    sizes = [np.diff(at, prepend=-1) for at in aligned.at]  # of each group; documents end with one
    before = [np.cumsum(n) - n for n in sizes]
    both = np.empty(2 * (len(a) + len(b)), object)
    # a group's A ids follow the B ids of all groups before it, its B ids its own A ids as well
    place_a = np.arange(len(a)) + np.repeat(before[1], sizes[0])
    place_b = np.arange(len(b)) + np.repeat(before[0] + sizes[0], sizes[1])
    signs = [np.full(len(ids), b",", object) for ids in (a, b)]
    signs[0][aligned.at[0]] = b"|"
    signs[1][aligned.at[1]] = b";"
    for ids, place, sign, name in zip((a, b), (place_a, place_b), signs, names, strict=True):
        both[2 * place] = name[ids]
        both[2 * place + 1] = sign
    steps = 2 * (aligned.first[0] + aligned.first[1])
    for begin, end in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
        yield b"".join(both[begin : end - 1].tolist()) if end > begin else b""


# -- general interface ---------------------------------------------------------------------


def align(docs: DataFrame, a: str, b: bytes, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all but the text), the ids of both sides and, group by
    group, how many ids of each side there are up to its end."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = [c for c in docs.columns if c != text] if keep is None else keep
    result = T._parse_datatype_string(GROUPS)
    clash = {c.lower() for c in keep} & set(result.names)
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    schema = T.StructType([*(docs.schema[c] for c in keep), *result])
    arrow = to_arrow_schema(schema)
    files = docs.sparkSession.sparkContext.broadcast((a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = byte_level(files.value[0]), piece_level(files.value[1])
        for part in gathered(batches, "_text", BLOCK_BYTES):
            found = Aligned(part.column("_text"), one, two)
            lists = []
            for side in (0, 1):
                lists.append(pa.ListArray.from_arrays(pa.array(found.first[side], pa.int32()), pa.array(found.ids[side], pa.int32())))
            for side in (0, 1):
                ranks = found.at[side] + 1 - np.repeat(found.first[side][:-1], np.diff(found.group_first))
                lists.append(pa.ListArray.from_arrays(pa.array(found.group_first, pa.int32()), pa.array(ranks, pa.int32())))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *lists], schema=arrow)
        give_back()

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)


# -- the contract's rows -------------------------------------------------------------------

STAGED = f"block long, {DIGESTS}, places array<int>, uses array<int>, pairs array<long>, totals array<long>"


def _digested(files):
    """Rows of documents (places in the block's list of pairs), and one row a block with that list."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T._parse_datatype_string(STAGED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = byte_level(files.value[0]), piece_level(files.value[1])
        block = TaskContext.get().partitionId() << 32
        for part in gathered(batches, "text", BLOCK_BYTES):
            found = Aligned(part.column("text"), one, two)
            n = len(part)
            links = found.ids[0][found.at[0]].astype(np.int64) << 32 | found.ids[1][found.at[1]]
            pairs, place, totals = np.unique(links, return_inverse=True, return_counts=True)
            groups = np.diff(found.group_first)
            # distinct places of each document, with their counts
            own, uses = np.unique(np.repeat(np.arange(n), groups) << 32 | place, return_counts=True)
            edges = np.searchsorted(own, np.arange(n + 1) << 32)
            hashes = [hashlib.sha256(t).hexdigest() if t else "" for t in group_texts(found, (one.names, two.names))]
            counted = [np.diff(found.first[0]), np.diff(found.first[1]), groups, groups]

            def column(values, kind, lists=None, head=n, tail=1):
                """Values for the documents, and null for the block's own row; or the other way about."""
                if lists is None:
                    array = pa.array(values, kind)
                else:
                    array = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(values, kind))
                empty = pa.nulls(tail if head else n, array.type)
                return pa.concat_arrays([array, empty] if head else [empty, array])

            yield pa.RecordBatch.from_arrays([
                pa.array([block] * (n + 1), pa.int64()),
                pa.concat_arrays([part.column("doc_id").cast(pa.int64()), pa.nulls(1, pa.int64())]),
                *(column(c, pa.int64()) for c in counted), column(hashes, pa.string()),
                column(own & 0xFFFFFFFF, pa.int32(), edges), column(uses, pa.int32(), edges),
                column(pairs, pa.int64(), [0, len(pairs)], head=0), column(totals, pa.int64(), [0, len(pairs)], head=0),
            ], schema=schema)
            block += 1
        give_back()

    return run


def _weighed(schema: pa.Schema):
    """Joins the corpus-wide counts of a block's pairs to its documents."""

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        size = docs.num_rows
        place = counts.column("place").to_numpy()
        n = np.zeros(len(place), np.int64)
        best = np.zeros(len(place), np.int64)
        n[place] = counts.column("n").to_numpy()
        best[place] = counts.column("best").to_numpy()
        lists = docs.column("places").combine_chunks()
        places, uses = lists.flatten().to_numpy(), docs.column("uses").combine_chunks().flatten().to_numpy().astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        sums = [np.concatenate([[0], np.cumsum(uses * x[places])]) for x in (best, n)]
        columns = [docs.column(c) for c in schema.names[:-3]]
        weighed = [pa.array(s[edges[1:]] - s[edges[:-1]], pa.int64()) for s in sums]
        return pa.Table.from_arrays([*columns, *weighed, docs.column("groups_sha256")], schema=schema) if size else schema.empty_table()

    return run


def op12_align(docs: DataFrame, a: str, b: bytes) -> DataFrame:
    """The contract's row for each document. a: content of a byte-level BPE file; b: of a piece model."""
    from pyspark.sql.pandas.types import to_arrow_schema

    files = docs.sparkSession.sparkContext.broadcast((a, b))  # as large as the vocabularies
    staged = written(docs.select("doc_id", "text").mapInArrow(_digested(files), STAGED), "links")
    listed = staged.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "totals")).alias("place", "pair"))
    listed = listed.select("block", "place", F.col("pair.pairs").alias("pair"), F.col("pair.totals").alias("total"))
    counts = listed.groupBy("pair").agg(F.sum("total").alias("n"))
    # a B id has at most as many pairs as A has ids
    same_b = Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))
    counts = counts.select("pair", "n", (F.col("n") == F.max("n").over(same_b)).cast("long").alias("best"))
    weights = listed.select("block", "place", "pair").join(counts, "pair").select(F.col("block").alias("of"), "place", "n", "best")
    schema = T._parse_datatype_string("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    documents = staged.where("pairs IS NULL").select("block", *(f.name for f in T._parse_datatype_string(DIGESTS)), "places", "uses")
    return documents.groupBy("block").cogroup(weights.groupBy("of")).applyInArrow(_weighed(to_arrow_schema(schema)), schema)
