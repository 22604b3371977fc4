"""Items without an id, and texts of one word said many times."""

from __future__ import annotations

import resource
from collections import Counter

import pyarrow as pa
import pytest

from ledgerloom.llm import decontaminate
from ledgerloom.llm.textarrays import ALNUM, Words, column_bytes
from tests.llm import brute
from tests.llm.test_operators import frame, rows_of

COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("pairs", [1 << 19, 7, 1])
def test_items_without_an_id_count(spark, monkeypatch, pairs):
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    words = " ".join(f"w{i}" for i in range(40))
    docs = [(1, words), (2, "a b c"), (3, "x " * 30), (4, f"{words} {words}"), (5, None)]
    items = [(None, " ".join(words.split()[3:20])), (None, "a b"), (7, "x " * 12), (8, words), (8, "c"), (9, None)]
    found = decontaminate.op4_decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    want = Counter(brute.decontaminate(docs, items))
    assert rows_of(found, *COLUMNS) == want
    assert max(r[3] for r in want) >= 2


def test_one_word_said_many_times():
    """20,000 equal words against an item of 1,200: bounded memory, and the whole match."""
    test = decontaminate.TestSet(["i"], ["x " * 1200], 10)
    words = Words(*column_bytes(pa.array(["x " * 20_000], pa.string())), ALNUM, lower=True)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    rows = test.search(words.hashes, words.first)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 300
    covered = set()
    for _, start, _, _, n in rows.tolist():
        covered.update(range(start, start + n))
    assert len(covered) == 20_000 and max(r[4] for r in rows.tolist()) == 1200


def test_names_that_clash(spark):
    docs = frame(spark, [(1, "a")])
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for name in ("Matches", "matches_WORDS"):
        with pytest.raises(ValueError):
            decontaminate.find_matches(docs.withColumnRenamed("lang", name), items)
    assert decontaminate.op4_decontaminate(docs.limit(0), items).count() == 0
    assert [tuple(r)[2:4] for r in decontaminate.op4_decontaminate(docs, items.limit(0)).select(*COLUMNS).collect()] == [(0, 0)]
