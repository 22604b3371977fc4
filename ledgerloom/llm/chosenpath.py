"""N-gram Jaccard join by chosen paths.

A record is a distinct set of five-word shingles; texts with equal sets are copies of
one record. Each run samples tokens of every set with probability 1/(LAMBDA size), by
a hash of the run and the token, so similar sets choose shared tokens; a chosen token
is a path. Paths of at most `LIMIT` records are brute-forced. Larger ones are split
again on tokens chosen by a hash of the path, unless a pivot record shows that most
of the path is similar anyway; what stays large is brute-forced too, in pairs of
blocks. For sets of sizes in any ratio that allows a Jaccard similarity of
LAMBDA, a run finds a pair with probability 1 - 1/e at least, so `RUNS` follows from
the target recall. Each pair is verified exactly on whole sets, and is counted in
the first bucket that both records share. No pair is written: buckets return the
number of links of each record and a spanning forest.

Defined results: texts without a word (null, empty) have no links and are a class of
their own row; texts of one to four words have one shingle, all their words; rows
with equal sets are one class whatever their ids; null ids are never the class id of
a class with another id. Other columns are kept whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.tables import written
from ledgerloom.llm.textarrays import ALNUM, WORD_BASE, Words, blocks, column_bytes, give_back, keyed, mix, spans_hash

SHINGLE = 5
LAMBDA = 0.8
RECALL = 0.9995
RUNS = math.ceil(-math.log(1 - RECALL))
LIMIT = 400
LEVELS = 4
SAMPLE = 32
DENSE = 0.5  # share of a path that is similar to its pivot
BLOCK_BYTES = 2 << 20
TOP = float(1 << 64)
RARE = 8  # tokens of so few records are counted pair by pair, others by a product of matrices


def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, their documents, first token of each document): distinct shingles of each text."""
    words = Words(*column_bytes(column), ALNUM, lower=True)
    counts = words.counts
    sizes = np.minimum(counts, SHINGLE)
    doc = words.documents()
    n = len(doc)
    left = words.first[1:][doc] - np.arange(n) if n else np.empty(0, np.int64)
    at = np.flatnonzero((left >= SHINGLE) | ((counts[doc] < SHINGLE) & (left == counts[doc]))) if n else np.empty(0, np.int64)
    doc = doc[at]
    tokens = spans_hash(words.hashes, at, at + sizes[doc], WORD_BASE) if len(at) else np.empty(0, np.uint64)
    _, once = np.unique(keyed(tokens, doc), return_index=True)
    once = np.sort(once)
    tokens, doc = tokens[once], doc[once]
    return tokens, doc, np.searchsorted(doc, np.arange(len(counts) + 1))


def _below(sizes: np.ndarray, factor: float) -> np.ndarray:
    """Hash limits that a token passes with probability factor / size."""
    return np.minimum(factor * TOP / np.maximum(sizes, 1), TOP * (1 - 2**-53)).astype(np.uint64)


def _lists(values: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    order = np.argsort(doc, kind="stable")
    offsets = np.searchsorted(doc[order], np.arange(n + 1)).astype(np.int32)
    values = values[order]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id, set, size, paths of the first level, sample of the tokens)."""
    for batch in batches:
        for begin, end in blocks(batch.column("text"), BLOCK_BYTES):
            part = batch.slice(begin, end - begin)
            tokens, doc, first = shingle_sets(part.column("text"))
            size = np.diff(first)
            n = len(part)
            sums = np.zeros(len(tokens) + 1, np.uint64)
            np.cumsum(mix(tokens), out=sums[1:])
            key = mix((sums[first[1:]] - sums[first[:-1]]) ^ size.astype(np.uint64))
            limit = _below(size, 1 / LAMBDA)[doc]
            paths, owners = [], []
            for run in range(RUNS):
                chance = mix(tokens ^ mix(np.array([run + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                chosen = chance <= limit
                paths.append(chance[chosen])
                owners.append(doc[chosen])
            shared = mix(tokens ^ np.uint64(0x5851F42D4C957F2D)) <= _below(size, SAMPLE)[doc]
            yield pa.RecordBatch.from_arrays([
                part.column("row"), part.column("id"),
                pa.array(key.view(np.int64), mask=size == 0), pa.array(size, pa.int32()),
                _lists(np.concatenate(paths), np.concatenate(owners), n),
                _lists(mix(tokens[shared]).astype(np.uint32).view(np.int32), doc[shared], n),
            ], names=["row", "id", "set", "size", "paths", "sample"])
    give_back()


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Children of (path, set, sample): tokens chosen by a hash of the path."""
    for batch in batches:
        lists = batch.column("sample")
        counts = np.asarray(lists.value_lengths(), np.int64)
        tokens = mix(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32))
        owner = np.repeat(np.arange(len(batch)), counts)
        path = batch.column("path").to_numpy().view(np.uint64)
        chance = mix(tokens ^ mix(path)[owner])
        chosen = chance <= _below(counts, 1 / LAMBDA)[owner]
        yield pa.RecordBatch.from_arrays(
            [pa.array(chance[chosen].view(np.int64)), batch.column("set").take(pa.array(owner[chosen]))], names=["path", "set"]
        )


def _buckets(records: DataFrame) -> DataFrame:
    """(path, set, size of the path): the buckets to brute-force, after splitting."""
    spark = records.sparkSession
    level = written(records.select("set", F.explode("paths").alias("path")).select("path", "set"), "paths")
    done = []
    for depth in range(LEVELS):
        sizes = level.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        counted = written(level.join(sizes, "path"), "counted") if depth else level.join(sizes, "path")
        if depth == LEVELS - 1:
            done.append(counted)
            break
        done.append(counted.where(F.col("n") <= LIMIT))
        large = written(counted.where(F.col("n") > LIMIT).join(records.select("set", "sample"), "set"), "large")
        if large.isEmpty():
            break
        pivots = large.groupBy("path").agg(F.min_by("sample", F.xxhash64("path", "set")).alias("pivot"))
        near = F.size(F.array_intersect("sample", "pivot")) >= DENSE * F.greatest(F.size("sample"), F.size("pivot"))
        dense = large.join(pivots, "path").groupBy("path").agg(F.avg(near.cast("double")).alias("near")).where(F.col("near") >= DENSE).select("path")
        done.append(large.join(dense, "path", "left_semi").select("path", "set", "n"))
        level = written(large.join(dense, "path", "left_anti").select("path", "set", "sample").mapInArrow(_split, "path long, set long"), "paths")
    found = done[0].select("path", "set", "n")
    for more in done[1:]:
        found = found.unionByName(more.select("path", "set", "n"))
    found = written(found, "buckets")
    # buckets of the same records, found by several runs, are one
    same = found.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.xxhash64("set").cast("decimal(20,0)")).alias("sum"), F.min("set").alias("least"))
    return found.join(same.groupBy("n", "sum", "least").agg(F.min("path").alias("path")).select("path"), "path", "left_semi")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, visits, tokens): whole sets, each token as 6 bytes of its hash."""
    for batch in batches:
        for begin, end in blocks(batch.column("text"), BLOCK_BYTES):
            part = batch.slice(begin, end - begin)
            tokens, _, first = shingle_sets(part.column("text"))
            short = tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            own = [np.ascontiguousarray(short[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("set"), part.column("visits"), pa.array(own, pa.binary())], names=["set", "visits", "tokens"])


def _unpack(tokens: bytes) -> np.ndarray:
    short = np.frombuffer(tokens, np.uint8).reshape(-1, 6)
    out = np.zeros((len(short), 8), np.uint8)
    out[:, :6] = short
    return out.view("<u8").ravel()


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets."""
    n = len(sets)
    if n == 2:
        out = np.diag([len(s) for s in sets])
        out[0, 1] = out[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        return out
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(tokens)]]))
    out = np.zeros((n, n), np.int64)
    flat = out.ravel()
    for c in range(2, min(RARE, n) + 1):  # rare tokens, by the number of their records
        who = owner[starts[counts == c][:, None] + np.arange(c)]
        for a in range(c):
            for b in range(a + 1, c):
                flat += np.bincount(who[:, a] * n + who[:, b], minlength=n * n) + np.bincount(who[:, b] * n + who[:, a], minlength=n * n) if len(who) > n else 0
                if len(who) <= n:
                    np.add.at(flat, who[:, a] * n + who[:, b], 1)
                    np.add.at(flat, who[:, b] * n + who[:, a], 1)
    common = np.flatnonzero(counts > RARE)
    for k in range(0, len(common), 2048):
        part = common[k : k + 2048]
        grid = np.zeros((n, len(part)), np.float32)
        columns = np.repeat(np.arange(len(part)), counts[part])
        grid[owner[np.concatenate([np.arange(s, s + c) for s, c in zip(starts[part], counts[part], strict=True)])], columns] = 1
        out += (grid @ grid.T).astype(np.int64)
    return out


def _earlier(paths: list[np.ndarray], path: int) -> np.ndarray:
    """Flags of the pairs that also meet in a bucket with a smaller path."""
    n = len(paths)
    mine = [p[p < path] for p in paths]
    names, where = np.unique(np.concatenate(mine), return_inverse=True)
    if not len(names):
        return np.zeros((n, n), bool)
    grid = np.zeros((n, len(names)), np.float32)
    grid[np.repeat(np.arange(n), [len(m) for m in mine]), where] = 1
    return grid @ grid.T > 0


def brute_force(path: int, i: int, j: int, block: np.ndarray, keys: np.ndarray, paths: list, sets: list) -> list[tuple[int, int | None, int]]:
    """(record, None, links) and edges (record, record, 0) of one bucket or pair of blocks."""
    sizes = np.array([len(s) for s in sets])
    inter = _shared(sets)
    # Jaccard >= 4/5 in whole numbers
    near = 5 * inter >= 4 * (sizes[:, None] + sizes - inter)
    np.fill_diagonal(near, False)
    if i != j:
        near &= block[:, None] != block
    if not near.any():
        return []
    links = (near & ~_earlier(paths, path)).sum(axis=1)
    out = [(int(keys[k]), None, int(links[k])) for k in np.flatnonzero(links)]
    seen = np.zeros(len(keys), bool)
    for start in np.argsort(keys, kind="stable"):
        if seen[start] or not near[start].any():
            continue
        seen[start] = True
        frontier = np.array([start])
        while len(frontier):
            more = near[frontier].any(axis=0) & ~seen
            seen |= more
            frontier = np.flatnonzero(more)
            out += [(int(keys[k]), int(keys[start]), 0) for k in frontier]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by path and pair of blocks."""
    now, held = None, {}

    def finish() -> list:
        if now is None or len(held) < 2:
            return []
        rows = list(held.values())
        return brute_force(*now, np.array([r[0] for r in rows]), np.array(list(held)), [np.array(r[1], np.int64) for r in rows], [_unpack(r[2]) for r in rows])

    def table(rows: list) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["u", "v", "links"])

    for batch in batches:
        out = []
        heads = [batch.column(c).to_pylist() for c in ("path", "i", "j", "b", "set")]
        for k, (path, i, j, b, key) in enumerate(zip(*heads, strict=True)):
            if (path, i, j) != now:
                out += finish()
                now, held = (path, i, j), {}
            held[key] = (b, batch.column("paths")[k].as_py(), batch.column("tokens")[k].as_py())
        yield table(out)
    yield table(finish())
    give_back()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, set, component, links), one for each row of docs.

    `row` is its row_key, `set` its record, `component` the connected component
    of its record (null: no words) and `links` the number of other records
    with a similarity of 0.8 or more.
    """
    source = docs.select(row_key(doc_id, text).alias("row"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    signed = written(source.mapInArrow(_sign, "row long, id long, set long, size int, paths array<long>, sample array<int>"), "signed")
    records = written(
        signed.where("set IS NOT NULL").groupBy("set").agg(F.min("row").alias("row"), F.first("paths").alias("paths"), F.first("sample").alias("sample")), "records"
    )
    buckets = _buckets(records).withColumn("blocks", F.ceil(F.col("n") / LIMIT).cast("int")).withColumn("b", F.pmod(F.xxhash64("set"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    visits = (
        buckets.select("path", "set", "b", "blocks", other)
        .select("set", F.struct("path", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b").alias("visit"))
        .groupBy("set").agg(F.collect_list("visit").alias("visits"))
    )
    wanted = visits.join(records.select("set", "row"), "set")
    kind = wanted.schema["visits"].dataType.simpleString()
    sets = written(
        source.select("row", "text").join(wanted, "row").select("set", "visits", "text").mapInArrow(_sets, f"set long, visits {kind}, tokens binary"), "sets"
    )
    shipped = sets.select("set", F.expr("array_sort(array_distinct(transform(visits, v -> v.path)))").alias("paths"), "tokens", F.explode("visits").alias("v")).select("v.*", "set", "paths", "tokens")
    compared = written(
        shipped.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j").mapInArrow(_compare, "u long, v long, links long"), "compared"
    )
    links = compared.where("v IS NULL").groupBy(F.col("u").alias("set")).agg(F.sum("links").alias("links"))
    parts = components(compared.where("v IS NOT NULL").select("u", "v")).withColumnRenamed("node", "set")
    labelled = links.join(parts, "set", "full_outer")
    return signed.select("row", "id", "set").join(labelled, "set", "left").select(
        "row", "id", "set", F.coalesce("component", "set").alias("component"), F.coalesce("links", F.lit(0)).alias("links")
    )


def op7_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, class_id, copy_id, n_links, n_copies.

    class_id is the smallest doc_id of its component of links, copy_id the smallest
    with an equal set of shingles, n_links counts other sets with a similarity of 0.8
    or more, n_copies other documents with an equal set.
    """
    found = written(near_duplicates(docs.select("doc_id", "text")), "found")
    classes = found.where("set IS NOT NULL").groupBy("component").agg(F.min("id").alias("class_id"))
    copies = found.where("set IS NOT NULL").groupBy("set").agg(F.min("id").alias("copy_id"), (F.count("*") - 1).alias("n_copies"))
    return found.join(copies, "set", "left").join(classes, "component", "left").select(
        F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copy_id", "id").alias("copy_id"),
        F.col("links").alias("n_links"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"),
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class: the one of the smallest doc_id; columns as they were.

    Rows without a word all stay. Ties within a doc_id fall to the smallest row_key,
    and of rows equal in id and text one stays.
    """
    found = written(near_duplicates(docs, doc_id, text), "found")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    best = found.where("set IS NOT NULL").groupBy("component").agg(F.min(order).alias("best")).select(F.col("best.row").alias("row__"))
    whole = found.where("set IS NULL").select(F.col("row").alias("row__")).distinct()
    twice = found.where("set IS NOT NULL").groupBy("row").count().where("count > 1").select(F.col("row").alias("row__"))
    keyed_docs = docs.withColumn("row__", row_key(doc_id, text))
    kept = keyed_docs.join(best.union(whole), "row__", "left_semi")
    if not (repeats := written(best.join(twice, "row__", "left_semi"), "twice")).isEmpty():
        again = kept.join(repeats, "row__", "left_semi").dropDuplicates(["row__"])
        kept = kept.join(repeats, "row__", "left_anti").unionByName(again)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
