"""Fuzzy notices against a plain edit distance, telling words, and time."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import licenses
from ledgerloom.llm.textarrays import ALNUM, Words, column_bytes
from tests.llm.test_operators import frame

SEARCHER = licenses.Searcher()


def search(texts):
    return SEARCHER.search(Words(*column_bytes(pa.array(texts, pa.string())), ALNUM, lower=True, hashed=False))


def labels(text):
    return {f["label"] for f in search([text])[0]}


@pytest.mark.parametrize(("text", "want"), [
    ("licensed under the bsd 2 clause license", set()),
    ("licensed under the apache license version 1 1", set()),
    ("released under the mpl license", set()),
    ("licensed under the gnu general public license version 1", set()),
    ("licensed under cc by nd 4 0", set()),
    ("licensed under cc by 4 0", {"cc-by"}),
    ("licensed under cc by sa 4 0", {"cc-by-sa"}),
    ("Licensed under the GNU Lesser General Public License, version 3", {"lgpl-3"}),
    ("Licensed under the GNU General Public License, version 3", {"gpl-3"}),
    ("Licenced under the GNU Affero General Public Licence, version 3", {"agpl-3"}),
    ("licensed under the bsd 3 clause licence", {"bsd-3"}),
    ("released under the mit licence", {"mit"}),
    ("not released under the mit licence", {"mit"}),
])
def test_edits_do_not_change_the_licence(text, want):
    assert labels(text) == want
    assert labels(f"some words before it {text} and some behind") == want


def distance(a: str, b: str) -> int:
    """Edit distance of whole strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def within(text: str, notice: str) -> int:
    """Least edit distance of the notice to any part of the text."""
    row = list(range(len(notice) + 1))
    best = row[-1]
    for x in text:
        last, row[0] = row[0], 0
        for j, y in enumerate(notice, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        best = min(best, row[-1])
    return best


def edited(rnd, notice, edits):
    """The notice with edits in words that don't tell licences apart."""
    words = notice.split(" ")
    free = [k for k, w in enumerate(words) if not licenses.telling([w]) and len(w) > 4]
    for _ in range(edits):
        k = rnd.choice(free)
        w, at = words[k], rnd.randrange(1, len(words[k]) - 1)
        words[k] = rnd.choice([w[:at] + w[at + 1 :], w[:at] + rnd.choice("qxz") + w[at:], w[:at] + rnd.choice("qxz") + w[at + 1 :]])
    return " ".join(words)


@pytest.mark.parametrize("rule", range(len(licenses.NOTICES)))
def test_every_notice_with_up_to_its_edits_is_found(rule):
    """Found, with the edits of a plain edit distance, wherever it stands."""
    label, notice = licenses.NOTICES[rule]
    allowed = len(notice) // licenses.EDITS_FOR
    rnd = random.Random(rule)
    filler = ["lorem", "ipsum", "dolor", "amet", "elit", "tempor", "labore"]
    for edits in range(allowed + 1):
        for _ in range(4):
            text = edited(rnd, notice, edits)
            whole = " ".join([*rnd.choices(filler, k=rnd.randint(0, 9)), text, *rnd.choices(filler, k=rnd.randint(0, 9))])
            found = [f for f in search([whole])[0] if f["label"] == label and not f["base"]]
            least = min(within(whole, n) for g, n in licenses.NOTICES if g == label and len(n) // licenses.EDITS_FOR >= within(whole, n))
            assert found and min(f["edits"] for f in found) <= edits and min(f["edits"] for f in found) >= min(least, edits)
            words = whole.split(" ")
            span = found[0]
            assert distance(" ".join(words[span["start"] : span["end"]]), notice) <= allowed + 12


def test_nothing_is_found_that_a_plain_search_does_not_allow():
    rnd = random.Random(12)
    vocabulary = sorted({w for _, n in licenses.NOTICES for w in n.split(" ")} | {"lorem", "ipsum", "2", "4"})
    for _ in range(150):
        text = " ".join(rnd.choices(vocabulary, k=rnd.randint(5, 60)))
        for f in search([text])[0]:
            if not f["base"]:
                notices = [n for g, n in licenses.NOTICES if g == f["label"]]
                assert any(within(text, n) <= len(n) // licenses.EDITS_FOR for n in notices)


def test_many_notices_in_one_text():
    """1,000 notices, all edited in another way and among other words, in less than a second."""
    rnd = random.Random(4)
    rules = [n for n in licenses.NOTICES if len(n[1]) < 60]
    parts, want = [], 0
    for _ in range(1000):
        label, notice = rnd.choice(rules)
        parts += [edited(rnd, notice, 1 if label != "cc-by-nc" else 0), "".join(rnd.choices("bcdfg", k=9))]
        want += 1
    text = " ".join(parts)
    search([text[:2000]])
    begin = time.process_time()
    found = [f for f in search([text])[0] if not f["base"]]
    assert time.process_time() - begin < 2.0
    assert len(found) >= 0.97 * want


def test_ties_and_odd_tables(spark):
    # of overlapping notices with equal score and length the first in the list
    twice = licenses.Searcher([("one", "alpha beta gamma delta"), ("two", "alpha beta gamma delta")], [])
    words = Words(*column_bytes(pa.array(["x alpha beta gamma delta y"], pa.string())), ALNUM, lower=True, hashed=False)
    assert [(f["label"], f["start"], f["end"]) for f in twice.search(words)[0]] == [("one", 1, 5)]
    docs = frame(spark, [(1, "released under the mit license")])
    assert licenses.op3_licenses(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.find_licenses(docs.withColumnRenamed("lang", "Licenses"))
    assert np.isclose(licenses.op3_licenses(docs).first().score, 1.0)
