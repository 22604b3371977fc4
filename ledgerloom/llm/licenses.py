"""License scan: fuzzy search for short notices.

Texts become words joined by single spaces. Each notice, allowed k edits, is split
into k + 1 pieces, of which one must occur exactly (pigeonhole); one automaton finds
all pieces of all notices, and the regex library's bounded-error matching verifies
the surroundings of a piece and tells edits and span. Pieces of a notice whose
surroundings overlap are verified together, once, and equal surroundings are verified
once in a block. The phrases of the base are notices with no edits: their single piece
is the phrase itself.

Edits must not change what a licence is: of a found span the telling words (`TELLING`,
and all numbers) must be those of the notice, in order. Words count whole that the span
touches.

Defined results: null or empty texts have no words, no labels and score 0; an empty table
gives no rows; long texts are blocks of their own; repeated rows get equal results; of
overlapping notices with different labels the one with the fewest edits for its length
counts (ties: the longer, then the first in the list); the names of the results must not
be among the columns, whatever their case (ValueError).
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm.textarrays import ALNUM, Words, blocks, column_bytes, ranges

BLOCK_BYTES = 2 << 20
EDITS_FOR = 12  # one edit for so many characters of a notice
# Phrases of the base with their labels, and short notices.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "licensed under the bsd 3 clause license"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
]

# Words by which one licence differs from another. Numbers do as well.
TELLING = frozenset((
    "mit apache gnu general lesser library affero agpl lgpl gpl bsd clause mozilla mpl isc eclipse epl artistic boost "
    "zlib unlicense cc by nc nd sa attribution commercial noncommercial derivatives sharealike alike creative zero "
    "not without non"
).split())

FOUND = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("base", T.BooleanType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("edits", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
]))


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 parts with their places: k edits leave one of them as it is."""
    n = edits + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(cuts[i], notice[cuts[i] : cuts[i + 1]]) for i in range(n)]


def telling(words: list[str]) -> list[str]:
    """The words of a notice that must not be edited."""
    return [w for w in words if w in TELLING or w.isdigit()]


def _windows(starts: list[int], size: int, edits: int, begin: int, stop: int) -> Iterator[tuple[int, int]]:
    """Parts of a text, begin to stop, where a notice of this size can be, given about where it may
    begin. The pieces of one notice, moved by its edits at most, share a part."""
    first = last = None
    for start in [*starts, None]:
        if first is not None and (start is None or start > first + 2 * edits):
            yield max(begin, first - 2 * edits), min(stop, last + size + 2 * edits)
            first = None
        if first is None:
            first = start
        last = start


def _holds(words: list[str], wanted: list[str]) -> bool:
    """Whether the wanted words are there, in order."""
    rest = iter(words)
    return all(w in rest for w in wanted)


class Searcher:
    def __init__(self, notices=NOTICES, phrases=PHRASES):
        self.notices = []
        seeds: dict[str, list] = {}
        for label, text in phrases:
            seeds.setdefault(f" {text} ", []).append((label, None, 0))
        for label, text in notices:
            edits = len(text) // EDITS_FOR
            pattern = regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={edits}}}")
            self.notices.append((label, text, edits, pattern, telling(text.split(" "))))
            for at, piece in pieces(text, edits):
                seeds.setdefault(piece, []).append((label, len(self.notices) - 1, at))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in seeds.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()

    def search(self, words: Words) -> list[list[dict]]:
        """Findings of each document of a block; starts and ends are its words."""
        counts = words.counts
        lengths = words.ends - words.starts + 1
        # " word word ... " for each document, as one string of bytes
        sizes = np.zeros(len(counts), np.int64)
        np.add.at(sizes, words.documents(), lengths)
        sizes += 1
        begins = np.cumsum(sizes) - sizes
        places = np.cumsum(lengths) - lengths + np.repeat(np.arange(len(counts)), counts) + 1
        flat = np.full(int(sizes.sum()), 32, np.uint8)
        flat[ranges(places, lengths - 1)] = words.data[ranges(words.starts, lengths - 1)]
        text = flat.tobytes().decode("latin-1")
        out: list[list[dict]] = [[] for _ in counts]
        near: dict[tuple[int, int], list[int]] = {}  # where a notice may begin, by notice and document
        for end, (size, owners) in self.automaton.iter(text):
            start = end - size + 1
            doc = int(np.searchsorted(begins, start, side="right")) - 1
            for label, rule, at in owners:
                if rule is not None:
                    near.setdefault((rule, doc), []).append(start - at)
                elif end < begins[doc] + sizes[doc]:
                    first = int(np.searchsorted(places, start + 1))
                    last = int(np.searchsorted(places, end))
                    out[doc].append({"label": label, "base": True, "start": first - int(words.first[doc]), "end": last - int(words.first[doc]), "edits": 0, "score": 1.0, "rank": -1})
        verified: dict[tuple[int, str], tuple[int, int, int] | None] = {}
        for (rule, doc), starts in near.items():
            label, notice, edits, _, _ = self.notices[rule]
            begin, stop, spans = int(begins[doc]), int(begins[doc] + sizes[doc]), set()
            for low, high in _windows(sorted(starts), len(notice), edits, begin, stop):
                window = text[low:high]
                if (rule, window) not in verified:
                    verified[rule, window] = self._verify(rule, window)
                if span := verified[rule, window]:
                    spans.add((low + span[0], low + span[1], span[2]))
            for a, b, cost in sorted(spans):
                first = max(int(np.searchsorted(places, a, side="right")) - 1, int(words.first[doc]))
                last = int(np.searchsorted(places, b))
                out[doc].append({"label": label, "base": False, "start": first - int(words.first[doc]), "end": last - int(words.first[doc]), "edits": cost, "score": 1 - cost / len(notice), "rank": rule})
        return [self._best(found) for found in out]

    def _verify(self, rule: int, window: str) -> tuple[int, int, int] | None:
        """(start, end, edits) of the best match of a notice in a window."""
        _, _, _, pattern, wanted = self.notices[rule]
        if not _holds(window.split(" "), wanted):
            return None
        m = pattern.search(window)
        if m is None:
            return None
        left = window.rfind(" ", 0, m.start() + 1) + 1
        right = window.find(" ", max(m.end() - 1, 0))
        touched = window[left : right if right >= 0 else len(window)].split(" ")
        return (m.start(), m.end(), sum(m.fuzzy_counts)) if telling(touched) == wanted else None

    @staticmethod
    def _best(found: list[dict]) -> list[dict]:
        """All base places, and of overlapping notices the closest."""
        kept: list[tuple[int, int, dict]] = []  # by start; they don't overlap
        for f in sorted((f for f in found if not f["base"]), key=lambda f: (-f["score"], f["start"] - f["end"], f["rank"], f["start"])):
            k = bisect.bisect_left(kept, (f["start"],))
            if (k == 0 or kept[k - 1][1] <= f["start"]) and (k == len(kept) or f["end"] <= kept[k][0]):
                kept.insert(k, (f["start"], f["end"], f))
        all_ = [f for f in found if f["base"]] + [f for _, _, f in kept]
        return [{k: v for k, v in f.items() if k != "rank"} for f in sorted(all_, key=lambda f: (f["start"], f["end"], not f["base"]))]


def find_licenses(docs: DataFrame, text: str = "text", out: str = "licenses") -> DataFrame:
    """docs with `out`, the notices of each text, and `<out>_words`, its number of words."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if {out.lower(), f"{out}_words".lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"choose another name than {out} for the notices")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, FOUND), T.StructField(f"{out}_words", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher()
        for batch in batches:
            for begin, end in blocks(batch.column(text), BLOCK_BYTES):
                part = batch.slice(begin, end - begin)
                words = Words(*column_bytes(part.column(text)), ALNUM, lower=True, hashed=False)
                found = searcher.search(words)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, arrow.field(out).type), pa.array(words.counts, pa.int64())], schema=arrow)

    return docs.mapInArrow(run, schema)


def op3_licenses(docs: DataFrame) -> DataFrame:
    """The contract's row for each document."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("licenses").to_pylist()
            starts = [[f["start"] for f in x if f["base"]] for x in found]
            labels = lambda x, all_: ",".join(sorted({f["label"] for f in x if all_ or f["base"]}))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_words": batch.column("licenses_words"),
                "n_base": pa.array([len(s) for s in starts], pa.int64()),
                "first_word": pa.array([min(s, default=None) for s in starts], pa.int64()),
                "last_word": pa.array([max(s, default=None) for s in starts], pa.int64()),
                "base_labels": pa.array([labels(x, False) for x in found], pa.string()),
                "labels": pa.array([labels(x, True) for x in found], pa.string()),
                "score": pa.array([max((f["score"] for f in x), default=0.0) for x in found], pa.float64()),
                "spans": pa.array([",".join(f"{f['label']}:{f['start']}:{f['end']}:{f['edits']}" for f in x) for x in found], pa.string()),
            })

    columns = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return find_licenses(docs.select("doc_id", "text")).select("doc_id", "licenses", "licenses_words").mapInArrow(digest, columns)
