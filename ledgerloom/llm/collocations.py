"""Phrase collocations by SON partitioning: mine shards, unite, count exactly.

A phrase with f >= SUPPORT in the corpus has f >= ceil(SUPPORT / SHARDS) in at least one
of SHARDS shards, whatever the shards hold. So:

1. Mine. Blocks of texts are dealt to the shards in turn, a shard being spread over
   many tasks. Each block sends how often each of its phrases occurs, as counts by
   hash bucket; the counts of a shard are summed, and a bucket that reaches the lowered
   support in any shard is marked. Words and word pairs go first; then phrases of three
   and four words, of which all pairs are marked. (A phrase is at least as rare as its
   parts.)
2. Unite. The marks of all shards are one bitmap of `BITS` bits for each of the two
   rounds: of fixed size, whatever the input. Phrases that share a bucket with a frequent
   one are marked too; that costs time, never a result, as marks only choose what is
   counted. For larger corpora take more bits: a full bitmap chooses everything.
3. Count. All marked phrases are counted over the whole corpus, exactly, keyed by
   language and text; blocks add up their own first, comparing equal hashes byte by byte.

Scores, cuts and what longer phrases displace are joins over the frequent phrases.

Defined results: null texts count as empty and have no words; a null language counts as
`und`, together with rows that say so; repeated rows count each for itself; an empty
table gives no rows; a long text is a block of its own; ties of scores go to the smallest
cut, ties of rank to the phrase that is less in byte order; other columns don't matter,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.spelling import distinct_spans
from ledgerloom.llm.tables import written
from ledgerloom.llm.textarrays import Words, byte_class, column_bytes, gathered, give_back, keyed, ranges, window_hash

SUPPORT = 30
SHARDS = 8
LONGEST = 4
TOP = 2000
BITS = 27
RANGES = 256  # parts of the bitmap, each summed in one place
BLOCK_BYTES = 4 << 20
UNKNOWN = "und"
# What ends a piece, and what parts its words.
PIECE_ENDS = ".,;:!?\n\v\f\r"
WORD_ENDS = " \t"
BETWEEN = byte_class([(ord(c), ord(c)) for c in PIECE_ENDS + WORD_ENDS])
ENDS = ~byte_class([(ord(c), ord(c)) for c in PIECE_ENDS])


class Phrases:
    """Words of a block of texts, and its phrases as runs of words inside one piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, offsets = column_bytes(texts)
        words = Words(data, offsets, BETWEEN, lower=True)
        doc = words.documents()
        self.hashes = words.hashes
        coded = (langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs).fill_null(UNKNOWN).dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy(zero_copy_only=False)[doc]
        marks = np.array([xxhash.xxh64_intdigest(name) for name in self.langs], np.uint64)
        self.owner = marks[self.lang] if len(doc) else np.empty(0, np.uint64)
        piece = np.concatenate([[0], np.cumsum(ENDS[words.data])])[words.starts]
        #: whether a word and the next one are in the same piece
        self.joined = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
        self.words = words

    def starts(self, n: int) -> np.ndarray:
        """First words of the phrases of n words."""
        inside = np.ones(max(len(self.hashes) - n + 1, 0), bool)
        for k in range(n - 1):
            inside &= self.joined[k : k + len(inside)]
        return np.flatnonzero(inside)

    def keys(self, n: int) -> np.ndarray:
        """A hash for each run of n words, over the borders of pieces as well."""
        found = window_hash(self.hashes, n)
        return keyed(found, self.owner[: len(found)])

    def marked(self, marks: dict[int, np.ndarray], n: int, bits: int) -> np.ndarray:
        """First words of the phrases of n words whose pairs, and which themselves, are marked."""
        at = self.starts(n)
        if n > 2 and 2 in marks:
            pairs = _is_marked(marks[2], self.keys(2), bits)
            for k in range(n - 1):
                at = at[pairs[at + k]]
        if n in marks:
            at = at[_is_marked(marks[n], self.keys(n)[at], bits)]
        return at

    def spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the words with one space behind each, and where each begins and ends."""
        w = self.words
        sizes = w.ends - w.starts
        ends = np.cumsum(sizes + 1) - 1
        data = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
        data[ranges(ends - sizes, sizes)] = w.data[ranges(w.starts, sizes)]
        return data, ends - sizes, ends


def _buckets(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _is_marked(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    at = _buckets(keys, bits)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


# -- mine and unite ------------------------------------------------------------------------

COUNTED = "part int, shard int, steps array<int>, counts array<tinyint>"


def _mine(sizes: tuple[int, ...], marks, bits: int, local: int):
    """Counts by bucket of each block, in steps from bucket to bucket, part by part of the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        known = marks.value
        for block in gathered(batches, "text", BLOCK_BYTES):
            phrases = Phrases(block.column("text"), block.column("lang"))
            keys = [phrases.keys(n)[phrases.marked(known, n, bits)] for n in sizes]
            buckets, counts = np.unique(_buckets(np.concatenate(keys), bits), return_counts=True)
            edges = np.searchsorted(buckets, np.arange(RANGES + 1) << bits >> RANGES.bit_length() - 1)
            full = np.flatnonzero(np.diff(edges))
            steps = np.diff(buckets, prepend=0)
            begins = edges[full]
            steps[begins] = buckets[begins] - (full << bits >> RANGES.bit_length() - 1)
            lists = pa.array(np.append(begins, len(buckets)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(full, pa.int32()), pa.array(np.full(len(full), shard % SHARDS), pa.int32()),
                pa.ListArray.from_arrays(lists, pa.array(steps, pa.int32())),
                pa.ListArray.from_arrays(lists, pa.array(np.minimum(counts, local), pa.int8())),
            ], names=["part", "shard", "steps", "counts"])
            shard += 1
        give_back()

    return run


def _unite(bits: int, local: int):
    """Marks of each part of the bitmap: buckets that reach the lowered support in any shard."""
    size = 1 << bits - (RANGES.bit_length() - 1)

    def marks(part: int, counters: np.ndarray) -> pa.RecordBatch:
        found = np.packbits((counters >= local).any(axis=0)).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([found], pa.binary())], names=["part", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counters = None, np.zeros((SHARDS, size), np.uint8)
        for batch in batches:
            parts, shards = batch.column("part").to_pylist(), batch.column("shard").to_pylist()
            steps, counts = batch.column("steps"), batch.column("counts")
            for k, own in enumerate(parts):
                if own != part:
                    if part is not None:
                        yield marks(part, counters)
                    part = own
                    counters[:] = 0
                at = np.cumsum(steps[k].values.to_numpy().astype(np.int64))
                row = counters[shards[k]]
                row[at] = np.minimum(row[at] + counts[k].values.to_numpy().astype(np.uint8), local)
        if part is not None:
            yield marks(part, counters)
        give_back()

    return run


def mined(docs: DataFrame, sizes: tuple[int, ...], known: dict[int, np.ndarray], support: int, bits: int) -> np.ndarray:
    """The bitmap of candidates of these sizes, given that of shorter ones. 2**bits bits come to the driver."""
    local = -(-support // SHARDS)
    if not 0 < local < 128:
        raise ValueError("support must be positive, and below 128 a shard")
    spark = docs.sparkSession
    marks = spark.sparkContext.broadcast(known)
    counted = docs.mapInArrow(_mine(sizes, marks, bits, local), COUNTED)
    parts = counted.repartition("part").sortWithinPartitions("part").mapInArrow(_unite(bits, local), "part int, marks binary")
    size = (1 << bits) // RANGES // 8
    bitmap = np.zeros(RANGES * size, np.uint8)
    for row in parts.collect():
        bitmap[row.part * size : (row.part + 1) * size] = np.frombuffer(row.marks, np.uint8)
    return bitmap


# -- count ---------------------------------------------------------------------------------


def _count(marks, bits: int):
    """(lang, words, phrase, f) of each block: marked phrases, and as words = 0 all word occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = marks.value
        for block in gathered(batches, "text", BLOCK_BYTES):
            phrases = Phrases(block.column("text"), block.column("lang"))
            data, begins, ends = phrases.spelled()
            totals = np.bincount(phrases.lang, minlength=len(phrases.langs))
            names = [pa.array([name for name, t in zip(phrases.langs, totals, strict=True) if t], pa.string())]
            words, texts, counts = [np.zeros(len(names[0]), np.int64)], [pa.array([""] * len(names[0]), pa.string())], [totals[totals > 0]]
            for n in range(1, LONGEST + 1):
                at = phrases.marked(known, n, bits)
                keys, lang = phrases.keys(n)[at], phrases.lang[at]
                for code in np.unique(lang).tolist():
                    own = at[lang == code]
                    first, which = distinct_spans(data, begins[own], ends[own + n - 1], keys[lang == code])
                    counts.append(np.bincount(which, minlength=len(first)))
                    words.append(np.full(len(first), n))
                    own = own[first]
                    sizes = ends[own + n - 1] - begins[own]
                    offsets = np.concatenate([[0], np.cumsum(sizes)])
                    texts.append(pa.StringArray.from_buffers(len(own), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[ranges(begins[own], sizes)].tobytes())))
                    names.append(pa.array([phrases.langs[code]] * len(own), pa.string()))
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays(names), pa.array(np.concatenate(words), pa.int32()), pa.concat_arrays(texts), pa.array(np.concatenate(counts), pa.int64()),
            ], names=["lang", "words", "phrase", "f"])
        give_back()

    return run


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, bits: int = BITS) -> DataFrame:
    """(lang, words, phrase, f): all phrases of up to LONGEST words with f >= support, exactly
    counted; and for each language, with words = 0, all its word occurrences."""
    docs = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    low = mined(docs, (1, 2), {}, support, bits)
    high = mined(docs, (3, 4), {1: low, 2: low}, support, bits)
    marks = docs.sparkSession.sparkContext.broadcast({1: low, 2: low, 3: high, 4: high})
    counted = docs.mapInArrow(_count(marks, bits), "lang string, words int, phrase string, f long")
    return counted.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("words") == 0) | (F.col("f") >= support))


# -- scores --------------------------------------------------------------------------------


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, words, phrase, a, l, r, score) of every candidate: its lowest-scoring cut."""
    f = frequent.where("words > 0").select("lang", "phrase", "f")
    cuts = (
        frequent.where("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        .withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
        .withColumn("rest", F.expr("substr(phrase, length(first) + 2)"))
    )
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # Decimals hold the product; the quotient is 1,000,000 at most.
    score = F.expr("(cast(f as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    found = cuts.groupBy("lang", "words", "phrase", F.col("f").alias("a")).agg(lowest)
    return found.select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def not_displaced(candidates: DataFrame, percent: int = 80) -> DataFrame:
    """Candidates without those that a longer candidate holds and nearly equals in count."""
    parts = F.expr(
        "flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), "
        "i -> array_join(slice(split(phrase, ' '), i, n), ' '))))"
    )
    inner = candidates.where("words > 2").select("lang", F.explode(parts).alias("phrase"), "a")
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    near = F.expr(f"cast(longer as decimal(20,0)) * 100 >= cast(a as decimal(20,0)) * {percent}")
    return candidates.join(most, ["lang", "phrase"], "left").where(~F.coalesce(near, F.lit(False))).drop("longer")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, support: int = SUPPORT, bits: int = BITS) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    frequent = written(frequent_phrases(docs, text, lang, support, bits), "phrases")
    candidates = not_displaced(scored(frequent))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = frequent.where("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    return collocations(docs)


SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, doc, unnest(parts) as piece, generate_subscripts(parts, 1) as at from (
    select lang, row_number() over () as doc, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as parts from documents)),
lists as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as w from pieces),
grams as (
  select lang, 1 as words, unnest(w) as phrase from lists
  union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from lists
  union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from lists
  union all select lang, 4, unnest(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) from lists),
totals as (select lang, count(*) as n from grams where words = 1 group by lang),
f as (select lang, words, phrase, count(*) as f from grams group by all having count(*) >= 30),
cuts as (
  select c.lang, c.words, c.phrase, c.f as a, k, array_to_string(string_split(c.phrase, ' ')[:k], ' ') as first, array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ') as rest
  from f c, (select unnest([1, 2, 3]) as k) where k < c.words),
parted as (
  select t.lang, t.words, t.phrase, t.a, k, x.f as l, y.f as r, (2000000::hugeint * t.a) // (x.f + y.f) as score
  from cuts t join f x on x.lang = t.lang and x.phrase = t.first join f y on y.lang = t.lang and y.phrase = t.rest),
candidates as (select * from parted qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_parts as (
  select lang, a, array_to_string(string_split(phrase, ' ')[i:i + n - 1], ' ') as phrase
  from candidates, (select unnest([2, 3]) as n), (select unnest([1, 2, 3]) as i) where n < words and i + n - 1 <= words),
longer as (select lang, phrase, max(a) as a from inner_parts group by all),
kept as (select c.* from candidates c left join longer g on g.lang = c.lang and g.phrase = c.phrase where g.a is null or 100 * g.a < 80 * c.a)
select lang, rank, phrase, a, l, r, n, score::bigint as score from (
  select k.lang, row_number() over (partition by k.lang order by k.score desc, k.a desc, k.phrase) as rank, k.phrase, k.a, k.l, k.r, n, k.score
  from kept k join totals t on t.lang = k.lang) where rank <= 2000
"""
