"""Benchmark decontamination with sharded suffix arrays of the training text.

Every shard (a block of at most `SHARD_BYTES` of training text, or one longer
document) gets a suffix array over word codes, sorted to the depth of a window by
prefix doubling. Every test suffix is binary-searched in it. Matches are checked on
64-bit hashes of each word, and are extended to the longest verbatim match. Shards
never cross a document, so no shuffle is needed: the test set, read in blocks of at
most `BLOCK_BYTES`, visits the shards.

A query's places in a shard are looked at in steps of `PAIRS` pairs, and only matches
that begin there are kept: texts of one word said many times take time, not memory.

Defined results: null or empty texts have no words and no match; an empty table gives no
rows, and empty items no matches; an item without words occurs nowhere; an item of fewer
than `window` words is one window; repeated rows get equal results; items whose item_id is
null count as one item, without a place in item lists; of equally long matches the first
is the longest. Columns of the input other than `text` pass through unread; the names of
the results must not be among them, whatever their case (ValueError).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.tables import written
from ledgerloom.llm.textarrays import ALNUM, Words, blocks, column_bytes, give_back, ranges

WINDOW = 10
SHARD_BYTES = 3 << 20
BLOCK_BYTES = 32 << 20
CODE_BITS = 14
PAIRS = 1 << 19

MATCHES = T.ArrayType(T.StructType([
    T.StructField("item_id", T.StringType()),
    T.StructField("item_start", T.IntegerType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("n_words", T.IntegerType()),
]))


def _codes(hashes: np.ndarray) -> np.ndarray:
    """Word codes 1 .. 2**14 - 2; 0 ends a document. Equal words have equal codes."""
    return (hashes % np.uint64((1 << CODE_BITS) - 2)).astype(np.int64) + 1


def _triples(codes: np.ndarray) -> np.ndarray:
    """Codes of positions i, i + 1, i + 2 in one number; zeros beyond the end."""
    padded = np.concatenate([codes, np.zeros(2, np.int64)])
    return padded[:-2] << (2 * CODE_BITS) | padded[1:-1] << CODE_BITS | padded[2:]


class SuffixArray:
    """Suffixes of a shard in order of their first 12 word codes."""

    DEPTH = 12

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        counts = np.diff(first)
        n = len(hashes) + len(counts)
        #: Place of document d's first word in the text with ends of documents.
        self.base = first[:-1] + np.arange(len(counts))
        self.hashes = np.zeros(n, np.uint64)
        self.hashes[ranges(self.base, counts)] = hashes
        codes = np.zeros(n, np.int64)
        codes[ranges(self.base, counts)] = _codes(hashes)
        self.triples = np.concatenate([_triples(codes), np.zeros(self.DEPTH, np.int64)])
        self.order = self._sort(n)

    def _sort(self, n: int) -> np.ndarray:
        bits = max(n, 2).bit_length()
        place = np.arange(n)
        if 3 * CODE_BITS + bits > 63:  # one very long document
            order = np.argsort(self.triples[:n], kind="stable")
            key = self.triples[order]
        else:
            packed = np.sort(self.triples[:n] << bits | place)
            order, key = packed & ((1 << bits) - 1), packed >> bits
        depth = 3
        while True:
            new = np.empty(n, bool)
            new[:1] = False
            np.not_equal(key[1:], key[:-1], out=new[1:])
            if depth >= self.DEPTH or n == 0:
                return order
            rank = np.zeros(n + depth, np.int64)
            rank[order] = np.cumsum(new) + 1
            if 3 * bits > 63:
                order = np.lexsort((rank[depth:], rank[:n]))
                key = rank[order] * (n + 2) + rank[order + depth]
            else:
                packed = np.sort((rank[:n] << bits | rank[depth:]) << bits | place)
                order, key = packed & ((1 << bits) - 1), packed >> bits
            depth *= 2

    def bounds(self, keys: np.ndarray, masks: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Range of the suffixes that begin with each query.

        keys has a row of triples for each query; masks tell how much of each counts.
        """
        q = len(keys)
        out = []
        for right in (False, True):
            low, high = np.zeros(q, np.int64), np.full(q, len(self.order), np.int64)
            while (open_ := low < high).any():
                mid = (low + high) // 2
                at = self.order[np.minimum(mid, len(self.order) - 1)]
                less, same = np.zeros(q, bool), np.ones(q, bool)
                for j, mask in enumerate(masks):
                    there = self.triples[at + 3 * j] & mask
                    less |= same & (there < keys[:, j])
                    same &= there == keys[:, j]
                step = (less | same) if right else less
                low = np.where(open_ & step, mid + 1, low)
                high = np.where(open_ & ~step, mid, high)
            out.append(low)
        return out[0], out[1]

    def narrowed(self, queries: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries (rows of word codes) found in the array, with their ranges."""
        keys, masks = [], []
        for j in range(0, length, 3):
            width = min(3, length - j)
            part = np.zeros((len(queries), 3), np.int64)
            part[:, :width] = queries[:, j : j + width]
            keys.append(part[:, 0] << (2 * CODE_BITS) | part[:, 1] << CODE_BITS | part[:, 2])
            masks.append((1 << (3 * CODE_BITS)) - (1 << ((3 - width) * CODE_BITS)))
        keys = np.stack(keys, axis=1)
        alive = np.arange(len(queries))
        for j in {1, len(masks)}:  # most queries end at the first triple
            low, high = self.bounds(keys[alive, :j], masks[:j])
            hit = low < high
            alive, low, high = alive[hit], low[hit], high[hit]
        return alive, low, high


class TestSet:
    """Word hashes of a block of test items, and its suffixes by window length."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int):
        self.ids, self.window = ids, window
        words = Words(*column_bytes(pa.array(texts, pa.string())), ALNUM, lower=True)
        counts = words.counts
        self.base = words.first[:-1] + np.arange(len(ids)) + 1
        self.hashes = np.zeros(len(words.hashes) + len(ids) + 2, np.uint64)
        self.hashes[ranges(self.base, counts)] = words.hashes
        self.item = np.zeros(len(self.hashes), np.int64)
        for k, (b, n) in enumerate(zip(self.base, counts, strict=True)):
            self.item[b : b + n] = k
        #: Window length -> the places in `hashes` where such windows start.
        self.suffixes = {}
        for length in np.unique(np.minimum(counts[counts > 0], window)):
            own = np.minimum(counts, window) == length
            self.suffixes[int(length)] = ranges(self.base[own], counts[own] - length + 1)

    def _begun(self, shard: SuffixArray, places: np.ndarray, low: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in the shard, place in the items) of the matches of length words that begin there."""
        upto, found = np.cumsum(counts), []
        for begin in range(0, int(upto[-1]), PAIRS):
            pair = np.arange(begin, min(begin + PAIRS, int(upto[-1])))
            query = np.searchsorted(upto, pair, side="right")
            at, test = shard.order[low[query] + pair - (upto[query] - counts[query])], places[query]
            if length == self.window:  # a match that also holds one word earlier is part of a longer one
                new = (at == 0) | (shard.hashes[at - 1] != self.hashes[test - 1]) | (self.hashes[test - 1] == 0)
                at, test = at[new], test[new]
            same = (shard.hashes[at[:, None] + np.arange(length)] == self.hashes[test[:, None] + np.arange(length)]).all(axis=1)
            found.append((at[same], test[same]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def search(self, hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Longest matches in a shard: (document, start, item, item start, words), one row each."""
        shard = SuffixArray(hashes, first)
        found = []
        for length, places in self.suffixes.items():
            queries = _codes(self.hashes[places[:, None] + np.arange(length)])
            alive, low, high = shard.narrowed(queries, length)
            if not len(alive):
                continue
            at, test = self._begun(shard, places[alive], low, high - low, length)
            size = np.full(len(at), length)
            going = np.arange(len(at)) if length == self.window else np.empty(0, np.int64)
            while len(going):
                a, t = at[going] + size[going], test[going] + size[going]
                a_in = np.minimum(a, len(shard.hashes) - 1)
                more = (a < len(shard.hashes)) & (self.hashes[t] != 0) & (shard.hashes[a_in] == self.hashes[t])
                going = going[more]
                size[going] += 1
            doc = np.searchsorted(shard.base, at, side="right") - 1
            item = self.item[test]
            found.append(np.stack([doc, at - shard.base[doc], item, test - self.base[item], size], axis=1))
        if not found:
            return np.empty((0, 5), np.int64)
        rows = np.concatenate(found)
        return rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]


def _search(test: TestSet, text: str, out: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in blocks(batch.column(text), SHARD_BYTES):
                part = batch.slice(begin, end - begin)
                words = Words(*column_bytes(part.column(text)), ALNUM, lower=True)
                rows = test.search(words.hashes, words.first)
                lists = [[] for _ in range(len(part))]
                for doc, start, item, item_start, size in rows.tolist():
                    lists[doc].append({"item_id": test.ids[item], "item_start": item_start, "start": start, "n_words": size})
                if out in part.schema.names:  # a later block of the test set
                    k = part.schema.get_field_index(out)
                    lists = [(a or []) + b for a, b in zip(part.column(k).to_pylist(), lists, strict=True)]
                    part = part.drop_columns([out, f"{out}_words"])
                columns = [*part.columns, pa.array(lists, schema.field(out).type), pa.array(words.counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        give_back()

    return run


def test_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list]:
    """The test set in blocks of at most BLOCK_BYTES of text each (or one item)."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 16
    total = items.agg(F.sum(size)).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    rows = items.select(F.col(item_id).cast("string"), F.col(text))
    if n <= 1:
        yield rows.collect()
        return
    # Twice as many parts as needed, dealt by content, keep each part under the bound.
    part = F.pmod(F.xxhash64(item_id, text), F.lit(2 * n))
    for k in range(2 * n):
        yield rows.where(part == k).collect()


def find_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", out: str = "matches") -> DataFrame:
    """docs with `out`, its longest verbatim matches, and `<out>_words`, its number of words.

    A match is a run of at least `window` words that document and item have in
    common and that goes on on neither side, or a whole shorter item.
    """
    if not 1 <= window <= SuffixArray.DEPTH:
        raise ValueError(f"window must be from 1 to {SuffixArray.DEPTH}")
    taken = {c.lower() for c in docs.columns}
    if out.lower() in taken or f"{out}_words".lower() in taken:
        raise ValueError(f"choose another name than {out} for the matches")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, MATCHES), T.StructField(f"{out}_words", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    result = docs
    for k, rows in enumerate(test_blocks(items, item_id, item_text)):
        test = TestSet([r[0] for r in rows], [r[1] for r in rows], window)
        if k:
            result = written(result, "matches")
        result = result.mapInArrow(_search(test, text, out, arrow), schema)
    return result


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the affected ones; columns as they were."""
    name = "matches__"
    while name in docs.columns:
        name += "_"
    found = find_matches(docs, items, out=name, **options)
    return found.where(F.size(name) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def _digest(matches: list[dict]) -> tuple[int, int, str]:
    hit, reach = 0, 0
    for m in sorted(matches, key=lambda m: m["start"]):
        end = m["start"] + m["n_words"]
        hit += max(0, end - max(reach, m["start"]))
        reach = max(reach, end)
    found = {m["item_id"] for m in matches}
    ids = sorted(found - {None})
    return hit, len(found), hashlib.sha256(",".join(ids).encode()).hexdigest()


def op4_decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    found = find_matches(docs.select("doc_id", "text"), items)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matches = batch.column("matches").to_pylist()
            rows = [_digest(m) for m in matches]
            best = [max(m, key=lambda x: (x["n_words"], -x["start"]), default={}) for m in matches]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_words": batch.column("matches_words"),
                "n_hit": pa.array([r[0] for r in rows], pa.int64()),
                "n_items": pa.array([r[1] for r in rows], pa.int64()),
                "items_sha256": pa.array([r[2] for r in rows], pa.string()),
                "contaminated": pa.array([r[0] > 0 for r in rows], pa.bool_()),
                "longest_words": pa.array([b.get("n_words", 0) for b in best], pa.int64()),
                "longest_start": pa.array([b.get("start") for b in best], pa.int64()),
                "longest_item": pa.array([b.get("item_id") for b in best], pa.string()),
            })

    columns = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_words long, longest_start long, longest_item string"
    return found.select("doc_id", "matches", "matches_words").mapInArrow(digest, columns)
