"""Substring deduplication with repeated-phrase automata.

A passage is a window of 50 consecutive words that also starts in a document with a
smaller doc_id.

1. Confirm recurring passages. Each window is represented by the least hash among its
   25-word phrases, so equal windows have equal representatives and a document has
   few. Representatives that occur in two documents are kept; windows that have one
   are counted exactly, and (document, first document with the window) pairs remain.
2. Compile sharded automata. First documents are dealt to shards of bounded size; a
   shard compiles the consecutive 25-word tiles of its documents with pyahocorasick,
   over word numbers. Any window holds a whole tile.
3. Stream documents. A document visits the shards of its pairs only. The automaton
   locates every occurrence of a tile; windows around it are compared word by word
   with the first document's, and the words they cover go.

Aggregates by hash are partial before the shuffle, and a shard visited by very many
documents is copied (salted), so a passage in a third of all rows stays spread out.

Defined results: null texts have no words; texts of fewer than 50 words lose none;
rows with a null doc_id have no order, lose nothing and take nothing away; rows with
equal doc_id don't dedupe each other, but each counts for greater ids; other columns
are kept whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.tables import written
from ledgerloom.llm.textarrays import NONSPACE, WORD_BASE, Words, blocks, column_bytes, covered, keyed, spans_hash, window_hash

WINDOW = 50
PHRASE = 25
BLOCK_BYTES = 2 << 20
SHARD_BYTES = 1 << 20  # text of the first documents in one automaton
VISIT_BYTES = 8 << 20  # text that one copy of an automaton reads
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPANS = "array<struct<start:int,end:int>>"


def row_key(doc_id: str, text: str) -> Column:
    """Tells rows apart by content; equal rows have equal results."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def window_marks(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the windows inside documents, their documents, their representatives)."""
    doc = words.documents()
    n = len(doc) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    least, width = window_hash(words.hashes, PHRASE), 1
    span = WINDOW - PHRASE + 1
    while 2 * width <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width : span - width + n])
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    return at, doc[at], least[at]


def _representatives(id_name: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in blocks(batch.column(text), BLOCK_BYTES):
                part = batch.slice(begin, end - begin)
                words = Words(*column_bytes(part.column(text)), NONSPACE, lower=False)
                _, doc, marks = window_marks(words)
                _, once = np.unique(keyed(marks, doc), return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks[once].view(np.int64)), part.column(id_name).take(pa.array(doc[once]))], names=["mark", id_name]
                )

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct windows of each document whose representative recurs."""
    for batch in batches:
        for begin, end in blocks(batch.column("text"), BLOCK_BYTES):
            part = batch.slice(begin, end - begin)
            words = Words(*column_bytes(part.column("text")), NONSPACE, lower=False)
            at, doc, marks = window_marks(words)
            lists = part.column("marks")
            wanted = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            owner = np.repeat(np.arange(len(part)), np.asarray(lists.value_lengths()))
            found = np.isin(keyed(marks, doc), keyed(wanted, owner))
            at, doc = at[found], doc[found]
            hashes = spans_hash(words.hashes, at, at + WINDOW, WORD_BASE) if len(at) else np.empty(0, np.uint64)
            _, once = np.unique(keyed(hashes, doc), return_index=True)
            take = pa.array(doc[once])
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[once].view(np.int64)), part.column("id").take(take)], names=["window", "id"]
            )


class Automaton:
    """Tiles and windows of a shard's first documents, over word numbers."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.numbers: dict[str, int] = {}
        number = self.numbers
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        parts, owners, places, at = [], [], [], 0
        for doc_id, text in zip(ids, texts, strict=True):
            own = [number.setdefault(w, len(number) + 1) for w in WORD.findall(text)]
            for i in range(0, len(own) - PHRASE + 1, PHRASE):
                self.machine.add_word(tuple(own[i : i + PHRASE]), 1)
            n = max(0, len(own) - WINDOW + 1)
            owners.append(np.full(n, doc_id, np.int64))
            places.append(at + np.arange(n))
            parts.append(np.array(own, np.uint64))
            at += len(own)
        self.machine.make_automaton()
        self.words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        places = np.concatenate(places) if places else np.empty(0, np.int64)
        owners = np.concatenate(owners) if owners else np.empty(0, np.int64)
        hashes = window_hash(self.words, WINDOW)[places] if len(places) else np.empty(0, np.uint64)
        order = np.lexsort((owners, hashes))
        keep = np.ones(len(order), bool)
        keep[1:] = hashes[order][1:] != hashes[order][:-1]  # the smallest doc_id of each window
        order = order[keep]
        self.hashes, self.owners, self.places = hashes[order], owners[order], places[order]

    def locate(self, doc_id: int, text: str) -> list[tuple[int, int]]:
        """Spans of the words of text in windows that start in a document below doc_id."""
        get = self.numbers.get
        own = tuple(get(w, 0) for w in WORD.findall(text))
        if len(own) < WINDOW or not len(self.hashes):
            return []
        ends = np.fromiter((e for e, _ in self.machine.iter(own)), np.int64)
        if not len(ends):
            return []
        n = len(own) - WINDOW + 1
        begins = ends - PHRASE + 1
        near = covered(n, np.clip(begins - (WINDOW - PHRASE), 0, n), np.clip(begins + 1, 0, n))
        words = np.array(own, np.uint64)
        at = np.flatnonzero(near)
        hashes = window_hash(words, WINDOW)[at]
        found = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        good = (self.hashes[found] == hashes) & (self.owners[found] < doc_id)
        at, found = at[good], found[good]
        sure = np.zeros(len(at), bool)
        offsets = np.arange(WINDOW)
        for i in range(0, len(at), 4096):
            a, b = at[i : i + 4096, None] + offsets, self.places[found[i : i + 4096], None] + offsets
            sure[i : i + 4096] = (words[a] == self.words[b]).all(axis=1)
        gone = covered(len(own), at[sure], at[sure] + WINDOW)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard and copy, the first documents (kind 0) before the visitors."""
    now, ids, texts, machine = None, [], [], None
    for batch in batches:
        rows, spans = [], []
        for shard, copy, kind, doc_id, row, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "copy", "kind", "id", "row", "text")), strict=True):
            if (shard, copy) != now:
                now, ids, texts, machine = (shard, copy), [], [], None
            if kind == 0:
                ids.append(doc_id)
                texts.append(text)
                continue
            if machine is None:
                machine = Automaton(ids, texts)
                ids, texts = [], []
            if found := machine.locate(doc_id, text):
                rows.append(row)
                spans.append([{"start": a, "end": b} for a, b in found])
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["row", "spans"]
        )


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(row, spans), the word spans to remove for each row_key that has any, and (row, text) of all such rows and others."""
    source = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).cast("long").alias("id"), row_key(doc_id, text).alias("row"), F.col(text).alias("text")
    )
    # 1. representatives in two documents
    marks = lambda c: source.select(c, "text").mapInArrow(_representatives(c, "text"), f"mark long, {c} long")
    recurring = written(
        marks("id").groupBy("mark").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("mark"), "marks"
    )
    rows = marks("row").join(recurring, "mark").groupBy("row").agg(F.collect_set("mark").alias("marks"))
    suspects = written(source.join(rows, "row").dropDuplicates(["row"]), "suspects")
    windows = suspects.mapInArrow(_windows, "window long, id long")
    first = windows.groupBy("window").agg(F.min("id").alias("home"))
    pairs = written(windows.join(first, "window").where("home < id").select("id", "home").distinct(), "pairs")

    # 2. first documents by shard, visitors by shard and copy: ids only
    sizes = suspects.groupBy("id").agg(F.sum(F.octet_length("text")).alias("size"))
    homes = pairs.select("home").distinct()
    total = homes.join(sizes, F.col("id") == F.col("home")).agg(F.sum("size")).first()[0] or 0
    shard = F.pmod(F.xxhash64("home"), F.lit(max(1, -(-total // SHARD_BYTES)))).cast("int").alias("shard")
    visits = pairs.select("id", shard).distinct()
    copies = visits.join(sizes, "id").groupBy("shard").agg(F.ceil(F.sum("size") / VISIT_BYTES).cast("int").alias("copies"))
    dealt = visits.join(copies, "shard").select("id", "shard", F.pmod(F.xxhash64("id"), "copies").cast("int").alias("copy"), F.lit(1).alias("kind"))
    compiled = homes.select(F.col("home").alias("id"), shard).join(copies, "shard").select(
        "id", "shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind")
    )
    # 3. the texts go where their ids go
    tasks = written(dealt.unionByName(compiled), "tasks").join(suspects.select("id", "row", "text"), "id")
    found = tasks.select("shard", "copy", "kind", "id", "row", "text").repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind", "id", "row").mapInArrow(_stream, f"row long, spans {SPANS}")
    spans = written(found.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    return spans, suspects.select("row", "text")


def remaining(text: str | None, spans: list[dict] | None) -> tuple[int, int, str]:
    """(words, removed words, text of the rest: kept words joined by one space)."""
    words = WORD.findall(text or "")
    if not spans:
        return len(words), 0, " ".join(words)
    gone = covered(len(words), np.array([s["start"] for s in spans]), np.array([s["end"] for s in spans]))
    return len(words), int(gone.sum()), " ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def _rest(keep: list[str], text: str, schema: pa.Schema, summary: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text)
            found = batch.column("spans__") if "spans__" in batch.schema.names else None
            for begin, end in blocks(texts, BLOCK_BYTES):
                out = [remaining(texts[k].as_py(), found[k].as_py() if found is not None else None) for k in range(begin, end)]
                kept = [hashlib.sha256(x[2].encode()).hexdigest() for x in out] if summary else [x[2] for x in out]
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(begin, end - begin) for c in keep),
                    pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array(kept, pa.string()),
                ], schema=schema)

    return run


def _summed(df: DataFrame, keep: list[str], text: str, summary: bool) -> DataFrame:
    """keep, n_words__, n_removed__ and kept__: the words that stay (or, for a summary, their hash)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_words__", T.LongType()), T.StructField("n_removed__", T.LongType()), T.StructField("kept__", T.StringType())])
    return df.mapInArrow(_rest(keep, text, to_arrow_schema(schema), summary), schema)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_words__, n_removed__ and kept__, the words that stay joined by one space."""
    spans, _ = repeated_spans(docs, doc_id, text)
    spans = spans.withColumnsRenamed({"row": "row__", "spans": "spans__"})
    joined = docs.withColumn("row__", row_key(doc_id, text)).join(spans, "row__", "left").drop("row__")
    return _summed(joined, docs.columns, text, summary=False)


def op10_repeats(docs: DataFrame) -> DataFrame:
    """The contract's row for each document.

    Only texts with something to remove move; all others are hashed where they are read.
    """
    docs = docs.select("doc_id", "text")
    spans, texts = repeated_spans(docs)
    changed = _summed(texts.join(spans.withColumnRenamed("spans", "spans__"), "row"), ["row"], "text", summary=True)
    changed = changed.select("row", F.col("n_removed__").alias("n_removed"), F.col("kept__").alias("changed_sha256"))
    whole = _summed(docs.withColumn("row", row_key("doc_id", "text")), ["doc_id", "row"], "text", summary=True)
    return whole.join(changed, "row", "left").select(
        "doc_id", F.col("n_words__").alias("n_words"), F.coalesce("n_removed", "n_removed__").alias("n_removed"), F.coalesce("changed_sha256", "kept__").alias("kept_sha256")
    )
