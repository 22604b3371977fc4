"""Byte-level BPE encoding and decoding over a global shuffle of distinct words.

Texts are cut into pre-tokens with positions in blocks of at most `BLOCK_BYTES`. Each
block sends its distinct pre-tokens once to the bucket of their hash; a bucket merges
each distinct word once and answers every block that asked; token ids are joined
back to the block, and documents are reassembled by position. Positions travel as
places in the block's word list, byte plane by byte plane, so that the shuffles stay
below the size of the compressed input. Decoding joins the token-byte table, which
is as large as the vocabulary file and no larger.

A block is named by the hash of its texts and of the borders between them. Both passes over the input must cut the
same blocks: give a table that is read (its scan is split when the query starts) and
not the unwritten result of a shuffle. The last step checks that a block's word list
is complete and raises otherwise, so another order of rows never gives wrong ids.

Defined results: null texts count as empty; an empty text has no ids; repeated rows
and equal blocks get equal ids; columns to keep may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.textarrays import NONSPACE, Words, column_bytes, gathered, give_back, long_spans_hash, ranges

BLOCK_BYTES = 5 << 20
OUT_BYTES = 8 << 20
WORDS_CACHED = 300_000
SHORT_WORD = 64
# White space as the pattern's \s has it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces at whose edges every pattern with ` ?` before a word and `\s+(?!\S)|\s+` cuts too.
PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: merge the adjacent pair of lowest rank, leftmost first.

    The ranks of a short word's pairs are a list; a long word's wait in a heap, so
    that n bytes take O(n log n).
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    if n <= SHORT_WORD:
        get, none = ranks.get, 1 << 60
        cuts = list(range(n + 1))
        pairs = [get(word[i : i + 2], none) for i in range(n - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            del cuts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(word[cuts[i - 1] : cuts[i + 1]], none)
            if i < len(pairs):
                pairs[i] = get(word[cuts[i] : cuts[i + 2]], none)
        return [ranks[word[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]
    ends = list(range(1, n + 1))  # a part is word[start:ends[start]]
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, end = heapq.heappop(heap)
        if ends[i] != j or j >= n or ends[j] != end:
            continue  # one of the parts has grown meanwhile
        ends[i], ends[j] = end, -1
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, end, ends[end]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k:end])) is not None:
            heapq.heappush(heap, (r, k, i, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


def piece_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions (starts, ends) of the pieces of all texts of a block, in order."""
    words = Words(data, offsets, NONSPACE, lower=False, hashed=False)
    doc = words.documents()
    # white space before each word, and behind the last word of each text
    before = offsets[:-1][doc]
    follows = np.zeros(len(doc), bool)
    follows[1:] = doc[1:] == doc[:-1]
    before[follows] = words.ends[:-1][follows[1:]]
    gap = words.starts - before
    spaced = (gap > 0) & (data[words.starts - 1] == 32) if len(doc) else np.empty(0, bool)
    word_starts = words.starts - spaced
    run_end = words.starts - (gap > 0)  # all but the last white space, if not empty
    lone = (gap > 0) & ~spaced
    last = words.first[1:] - 1
    tail = offsets[:-1].copy()
    full = words.counts > 0
    tail[full] = words.ends[last[full]]
    starts = np.concatenate([word_starts, before[run_end > before], run_end[lone], tail[tail < offsets[1:]]])
    ends = np.concatenate([words.ends, run_end[run_end > before], words.starts[lone], offsets[1:][tail < offsets[1:]]])
    odd = _odd_texts(data, offsets)
    if len(odd):  # other white space than ASCII: cut these texts by the pattern
        keep = ~np.isin(np.searchsorted(offsets, starts, side="right") - 1, odd)
        parts = [(starts[keep], ends[keep])]
        for d in odd:
            text = data[offsets[d] : offsets[d + 1]].tobytes().decode()
            sizes = np.fromiter((len(p.encode()) for p in PIECES.findall(text)), np.int64)
            stop = offsets[d] + np.cumsum(sizes)
            parts.append((stop - sizes, stop))
        starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def _odd_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    at = np.fromiter((m.start() for m in ODD_SPACE.finditer(data.tobytes())), np.int64)
    return np.unique(np.searchsorted(offsets, at, side="right") - 1)


class Block:
    """Pre-tokens of a block of texts. words: the distinct ones, the most frequent first."""

    def __init__(self, column: pa.Array, pattern: str, positions: bool):
        data, offsets = column_bytes(column)
        raw = data.tobytes()
        # equal bytes with other borders between texts hold other words
        self.name = xxhash.xxh64_intdigest(offsets.astype("<i8").tobytes(), seed=xxhash.xxh64_intdigest(raw)) - (1 << 63)
        starts, ends = piece_spans(data, offsets)
        hashes = long_spans_hash(data, starts, ends)
        _, first, which, uses = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        words: defaultdict[str, int] = defaultdict(count().__next__)
        del hashes
        split, place = regex.compile(pattern).findall, words.__getitem__
        parts = []
        for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True):
            piece = raw[a:b].decode()
            # a space and letters, or letters alone, are one pre-token
            parts.append((place(piece),) if piece.isalpha() or (piece[0] == " " and piece[1:].isalpha()) else tuple(map(place, split(piece))))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter(chain.from_iterable(parts), np.int64, int(sizes.sum()))
        order = np.argsort(-np.bincount(flat, np.repeat(uses, sizes), len(words)), kind="stable")
        del parts
        names = list(words)
        words.clear()
        self.words = [names[i] for i in order.tolist()]
        self.positions = []
        if positions:
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            flat = rank[flat]
            begins = np.cumsum(sizes) - sizes
            edges = np.searchsorted(starts, offsets)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = which[a:b]
                self.positions.append(flat[ranges(begins[own], sizes[own])])


def _pack(places: np.ndarray, n_words: int, zip_: zstandard.ZstdCompressor) -> bytes:
    """Places in the word list, one byte plane after the other."""
    planes = places.astype("<u4").view(np.uint8).reshape(-1, 4).T if len(places) else np.empty((4, 0), np.uint8)
    return np.array([n_words], "<u4").tobytes() + zip_.compress(planes.tobytes())


def _unpack(payload: bytes, unzip: zstandard.ZstdDecompressor) -> tuple[np.ndarray, int]:
    planes = np.frombuffer(unzip.decompress(payload[4:]), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64), int(np.frombuffer(payload[:4], "<u4")[0])


def _ask(pattern: str, text: str, buckets: int):
    """(bucket, block, payload): the distinct words of each block, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for part in gathered(batches, text, BLOCK_BYTES):
            block = Block(part.column(text), pattern, positions=False)
            if not block.words:
                continue
            raw = [w.encode() for w in block.words]
            lengths = np.fromiter(map(len, raw), np.int64, len(raw))
            ends = np.cumsum(lengths)
            hashes = long_spans_hash(np.frombuffer(b"".join(raw), np.uint8), ends - lengths, ends)
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(edges)):
                own = order[edges[b] : edges[b + 1]]
                head = np.array([len(own)], "<u4").tobytes() + np.diff(own, prepend=0).astype("<u4").tobytes() + lengths[own].astype("<u4").tobytes()
                rows.append((int(b), zip_.compress(head + b"".join([raw[i] for i in own.tolist()]))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([block.name] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                names=["bucket", "block", "payload"],
            )
            del block, raw, rows
        give_back()

    return run


def _answer(ranks):
    """(block, payload): ids of the words that were asked for, each distinct word merged once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_, unzip = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        table, known = ranks.value, {}
        for batch in batches:
            for k in range(len(batch)):
                blob = unzip.decompress(batch.column("payload")[k].as_py())
                n = int(np.frombuffer(blob, "<u4", 1)[0])
                lengths = np.frombuffer(blob, "<u4", n, 4 + 4 * n)
                ends = (np.cumsum(lengths.astype(np.int64)) + 4 + 8 * n).tolist()
                out, begin = [], 4 + 8 * n
                for end in ends:
                    word = blob[begin:end]
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= WORDS_CACHED:
                            known.clear()
                        ids = known[word] = merge(word, table)
                    out.append(ids)
                    begin = end
                sizes = np.fromiter(map(len, out), "<u4", n)
                ids = np.fromiter((i for x in out for i in x), "<u4", int(sizes.sum()))
                payload = zip_.compress(blob[: 4 + 4 * n] + sizes.tobytes() + np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("block").slice(k, 1), pa.array([payload], pa.binary())], names=["block", "payload"]
                )
        known.clear()
        give_back()

    return run


def _place(pattern: str, text: str, keep: list[str], row_type: pa.DataType):
    """(block, row, payload): the places of each document's pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for part in gathered(batches, text, BLOCK_BYTES):
            block = Block(part.column(text), pattern, positions=True)
            row = pa.StructArray.from_arrays([part.column(c) for c in keep], fields=list(row_type))
            payload = [_pack(p, len(block.words), zip_) for p in block.positions]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.name] * len(part), pa.int64()), row, pa.array(payload, pa.binary())], names=["block", "row", "payload"]
            )
            del block, payload
        give_back()

    return run


class _Dictionary:
    """Ids of the words of one block, as its answers come in."""

    def __init__(self):
        self.name, self.parts, self.table = None, [], None

    def start(self, name: int) -> None:
        if name != self.name:
            self.name, self.parts, self.table = name, [], None

    def add(self, blob: bytes) -> None:
        n = int(np.frombuffer(blob, "<u4", 1)[0])
        places = np.cumsum(np.frombuffer(blob, "<u4", n, 4).astype(np.int64))
        sizes = np.frombuffer(blob, "<u4", n, 4 + 4 * n).astype(np.int64)
        ids = np.frombuffer(blob, np.uint8, offset=4 + 8 * n).reshape(4, -1)
        self.parts.append((places, sizes, np.ascontiguousarray(ids.T).view("<u4").ravel().astype(np.int32)))

    def ids(self, places: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places, and how many each word has."""
        if self.table is None:
            sizes, starts = np.full(n_words, -1, np.int64), np.zeros(n_words, np.int64)
            base = 0
            for at, size, ids in self.parts:
                sizes[at], starts[at] = size, base + np.cumsum(size) - size
                base += len(ids)
            if (sizes < 0).any():
                raise RuntimeError("The input was split in another way meanwhile: run the query again")
            flat = np.concatenate([p[2] for p in self.parts]) if self.parts else np.empty(0, np.int32)
            self.table, self.parts = (sizes, starts, flat), []
        sizes, starts, flat = self.table
        return flat[ranges(starts[places], sizes[places])], sizes[places]


def _assemble(schema: pa.Schema, then):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, words = zstandard.ZstdDecompressor(), _Dictionary()

        def rows(batch: pa.RecordBatch, begin: int, ids: list[np.ndarray]) -> pa.RecordBatch:
            part = batch.column("row").slice(begin, len(ids))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate(ids), pa.int32())
            found = pa.RecordBatch.from_arrays([*part.flatten(), pa.ListArray.from_arrays(pa.array(offsets), flat)], schema=schema)
            return then(found) if then else found

        for batch in batches:
            kinds, blocks_ = batch.column("kind").to_pylist(), batch.column("block").to_pylist()
            begin, out, size = 0, [], 0
            for k, kind in enumerate(kinds):
                words.start(blocks_[k])
                payload = batch.column("payload")[k].as_py()
                if kind == 0:
                    if out:
                        yield rows(batch, begin, out)
                        out, size = [], 0
                    words.add(unzip.decompress(payload))
                    continue
                if not out:
                    begin = k
                out.append(words.ids(*_unpack(payload, unzip))[0])
                size += 4 * len(out[-1])
                if size >= OUT_BYTES:
                    yield rows(batch, begin, out)
                    out, size = [], 0
            if out:
                yield rows(batch, begin, out)
        give_back()

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: list[str] | None = None, out: str = "ids",
           then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, then_schema: T.StructType | None = None) -> DataFrame:
    """The columns `keep` (default: all but the text) and `out`, the token ids of each text.

    `then` may turn each batch of them into rows of `then_schema` where it is made.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    fields = [docs.schema[c] for c in keep] or [T.StructField("none", T.BooleanType())]
    if out in keep:
        raise ValueError(f"choose another name than {out} for the ids")
    row = T.StructType(fields)
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    table = spark.sparkContext.broadcast(ranks)  # as large as the vocabulary file
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(*keep, text) if text not in keep else docs.select(*keep)
    if not keep:
        source = docs.select(F.lit(None).cast("boolean").alias("none"), text)
        keep = ["none"]
    answers = (
        source.mapInArrow(_ask(pattern, text, buckets), "bucket int, block long, payload binary")
        .repartition("bucket").select("block", "payload")
        .mapInArrow(_answer(table), "block long, payload binary")
        .select("block", F.lit(0).alias("kind"), F.lit(None).cast(row).alias("row"), "payload")
    )
    places = (
        source.mapInArrow(_place(pattern, text, keep, to_arrow_schema(row)), T.StructType([T.StructField("block", T.LongType()), T.StructField("row", row), T.StructField("payload", T.BinaryType())]))
        .select("block", F.lit(1).alias("kind"), "row", "payload")
    )
    result = (
        answers.unionByName(places).repartition("block").sortWithinPartitions("block", "kind")
        .mapInArrow(_assemble(to_arrow_schema(schema), then), then_schema or schema)
    )
    return result.drop("none") if keep == ["none"] and not then else result


class TokenTable:
    """A byte string for each id; joins many ids at once."""

    def __init__(self, entries: dict[int, bytes]):
        top = max(entries, default=-1) + 1
        self.sizes = np.full(top, -1, np.int64)
        for i, b in entries.items():
            self.sizes[i] = len(b)
        self.starts = np.zeros(top, np.int64)
        at, parts = 0, []
        for i in sorted(entries):
            self.starts[i] = at
            parts.append(entries[i])
            at += len(entries[i])
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids] if len(ids) else np.empty(0, np.int64)
        if (sizes < 0).any():
            raise ValueError("an id is not in the token table")
        return self.data[ranges(self.starts[ids], sizes)].tobytes() if len(ids) else b""


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    for k in range(len(column)):
        yield values[offsets[k] : offsets[k + 1]]


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with `out`, the bytes of its ids (null ids: no bytes)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])
    arrow = to_arrow_schema(schema)
    table = df.sparkSession.sparkContext.broadcast(TokenTable({i: b for b, i in ranks.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [table.value.join(x) for x in _lists(batch.column(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], schema=arrow)

    return df.mapInArrow(run, schema)


def digests(ranks: dict[bytes, int], spark: SparkSession) -> tuple[Callable[[pa.RecordBatch], pa.RecordBatch], T.StructType]:
    """(doc_id, ids) to the contract's row: hashes of the ids' decimals and of the decoded bytes."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    decimals = spark.sparkContext.broadcast(TokenTable({i: b"%d," % i for i in ranks.values()}))
    tokens = spark.sparkContext.broadcast(TokenTable({i: b for b, i in ranks.items()}))

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = list(_lists(batch.column("ids")))
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([len(x) for x in lists], pa.int64()),
            pa.array([hashlib.sha256(decimals.value.join(x)[:-1]).hexdigest() for x in lists], pa.string()),
            pa.array([hashlib.sha256(tokens.value.join(x)).hexdigest() for x in lists], pa.string()),
        ], names=schema.names)

    return digest, schema


def op9_bpe(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """The contract's row for each document."""
    then, schema = digests(ranks, docs.sparkSession)
    return encode(docs.select("doc_id", "text"), ranks, pattern, then=then, then_schema=schema)
