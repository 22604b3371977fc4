"""Quality rules with adaptive thresholds from mergeable quantile sketches.

A sketch is a histogram with 64 buckets for each power of two (exact below 128), so
merging is adding counts, in any order, and the result never depends on the order.
Sketches are kept for each (lang, source) and merged upwards, to languages and to all
rows. The fence of a sketch is q75 + 3 (q75 - q25). A group's fence is drawn towards that
of its language, and a language's towards that of all rows, with a weight of `WEIGHT`
rows: a group of few rows follows its parent, a large one itself, and no number of rows
switches from one to the other. A threshold is the group's fence or the `TAIL` quantile
of all rows, whichever is greater: it lets no rule fire for a text that is ordinary for
its group, or for the whole corpus. All of these come from the sketches.

Defined results: null or empty texts have no words and fail the base rule; null
lang or source is a group of its own; repeated rows count and are judged each for itself;
an empty table gives no rows; long texts are blocks of their own; a value equal to its
threshold passes; of several failed rules the first is named; other columns don't matter,
but those to keep must not have the name of a count (ValueError), whatever its case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.tables import written
from ledgerloom.llm.textarrays import _BYTE_CODES, BYTE_BASE, NONSPACE, Words, blocks, column_bytes, covered, keyed, repeated, spans_hash, window_hash

BLOCK_BYTES = 2 << 20
REPEAT_WINDOW = 8
WEIGHT = 100  # rows of a parent that a group's fence is drawn towards
TAIL = 0.98
# Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def _per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def count_block(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of a block."""
    data, offsets = column_bytes(column)
    words = Words(data, offsets, NONSPACE, lower=False)
    n_docs = len(offsets) - 1
    letters = NONSPACE[data] & ((data & 0xC0) != 0x80)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = {
        "n_words": words.counts,
        "word_chars": _per_document(letters, offsets),
        "n_symbols": _per_document(symbol[data], offsets),
        "n_upper": _per_document((data >= 65) & (data <= 90), offsets),
    }
    breaks = np.flatnonzero(data == 10)
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    starts = np.sort(np.concatenate([breaks + 1, offsets[:-1]]), kind="stable")
    full = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[full], ends[full]
    owner = np.searchsorted(offsets, starts, side="right") - 1
    lines = keyed(spans_hash(_BYTE_CODES[data], starts, ends, BYTE_BASE), owner)
    _, first = np.unique(lines, return_index=True)
    out["n_lines"] = np.bincount(owner, minlength=n_docs)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(owner[first], minlength=n_docs)
    windows = window_hash(words.hashes, REPEAT_WINDOW)
    doc = words.documents()
    inside = doc[: len(windows)] == doc[REPEAT_WINDOW - 1 :] if len(windows) else np.empty(0, bool)
    at = np.flatnonzero(inside)
    at = at[repeated(keyed(windows[at], doc[at]))]
    hit = covered(len(doc), at, at + REPEAT_WINDOW) if len(doc) else np.empty(0, bool)
    out["n_repeat_words"] = _per_document(hit, words.first)
    return out


def document_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns `keep` and the counts of each text."""
    clash = {c.lower() for c in keep} & set(COUNTS)
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in blocks(batch.column(text), BLOCK_BYTES):
                part = batch.slice(begin, end - begin)
                found = count_block(part.column(text))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), *(pa.array(found[c], pa.int64()) for c in COUNTS)],
                    names=[*keep, *COUNTS],
                )

    return docs.select(*keep, text).mapInArrow(count, schema)


def _metrics() -> dict[str, Column]:
    share = lambda a, b: F.expr(f"(1000 * {a}) div greatest(1, {b})")
    return {
        "symbol_permille": share("n_symbols", "word_chars"),
        "dup_line_permille": share("n_dup_lines", "n_lines"),
        "repeat_permille": share("n_repeat_words", "n_words"),
        "upper_permille": share("n_upper", "word_chars"),
        "word_length_tenths": F.expr("(10 * word_chars) div greatest(1, n_words)"),
    }


# Buckets of a whole number v >= 0 and the least value of a bucket.
BUCKET = "CASE WHEN v < 128 THEN v ELSE 128 + (length(bin(v)) - 8) * 64 + shiftright(v, length(bin(v)) - 7) - 64 END"
LEAST = "CASE WHEN bucket < 128 THEN bucket ELSE shiftleft(64 + (bucket - 128) % 64, CAST(1 + (bucket - 128) div 64 AS INT)) END"


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): one sketch for each group and metric."""
    pairs = F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("long").alias("v")) for k, v in _metrics().items()))
    return (
        counts.select("lang", "source", F.inline(pairs))
        .select("lang", "source", "metric", F.expr(BUCKET).cast("long").alias("bucket"))
        .groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))
    )


def _fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Rows, fence and tail of merged sketches; a group has a bounded number of buckets."""
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "metric")
    ranked = merged.select("*", F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("rows"), F.expr(LEAST).alias("least"))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("rows") * round(100 * q), F.col("least")))
    found = ranked.groupBy(*by, "metric").agg(F.max("rows").alias("rows"), at(0.25).alias("q25"), at(0.75).alias("q75"), at(TAIL).alias("tail"))
    return found.select(*by, "metric", "rows", (F.col("q75") + 3 * (F.col("q75") - F.col("q25"))).alias("fence"), "tail")


def _drawn(rows: str, fence: str, parent: str) -> Column:
    """A fence drawn towards its parent's, in whole numbers."""
    return F.expr(f"({rows} * {fence} + {WEIGHT} * {parent}) div ({rows} + {WEIGHT})")


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, and a threshold for each metric)."""
    own = _fences(sketch, ["lang", "source"]).drop("tail")
    lang = _fences(sketch, ["lang"]).select(F.col("lang").alias("of_lang"), F.col("metric").alias("of_metric"), F.col("rows").alias("lang_rows"), F.col("fence").alias("lang_fence"))
    whole = _fences(sketch, []).select("metric", F.col("fence").alias("all_fence"), "tail")  # a row a metric
    joined = own.join(lang, F.expr("lang <=> of_lang AND metric = of_metric")).join(F.broadcast(whole), "metric")
    fenced = joined.withColumn("lang_fence", _drawn("lang_rows", "lang_fence", "all_fence"))
    limit = F.greatest(_drawn("rows", "fence", "lang_fence"), F.col("tail"))
    limits = fenced.select("lang", "source", "metric", limit.alias("limit"))
    return limits.groupBy("lang", "source").agg(*(F.max(F.when(F.col("metric") == k, F.col("limit"))).alias(f"max_{k}") for k in _metrics()))


def judge(counts: DataFrame) -> DataFrame:
    """counts with base_failed, kept and failed_rule."""
    limits = thresholds(sketches(counts)).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    joined = counts.join(limits, F.expr("lang <=> of_lang AND source <=> of_source"), "left").withColumns(_metrics())
    over = [F.when(F.col(k) > F.col(f"max_{k}"), F.lit(k)) for k in _metrics()]
    base = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    rule = F.when(base, F.lit("base")).otherwise(F.coalesce(*over))
    return joined.select("doc_id", "lang", "source", *COUNTS, base.alias("base_failed"), rule.isNull().alias("kept"), rule.alias("failed_rule"))


def op6_rules(docs: DataFrame) -> DataFrame:
    """The contract's row for each document. Counts are written once, for sketch and filter."""
    counts = written(document_counts(docs), "counts")
    return judge(counts).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule")
