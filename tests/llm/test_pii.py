"""Pseudonyms: calling codes, digits, time, and a plain permutation."""

from __future__ import annotations

import random
import time

import pytest

from ledgerloom.llm import pii
from tests.llm.test_operators import frame


@pytest.mark.parametrize(("number", "code"), [
    ("+353 87 123 4567", "+353"), ("+1 499 555 6503", "+1"), ("+7 495 123 45 67", "+7"), ("+49 30 1234567", "+49"), ("+44 20 7946 0958", "+44"),
    ("+420 601 123 456", "+420"), ("+86 10 1234 5678", "+86"), ("+971 4 123 4567", "+971"),
])
def test_the_calling_code_is_kept(number, code):
    names, back = pii.Pseudonyms(), pii.Pseudonyms(backward=True)
    seen = set()
    for n in range(30):
        text = f"{number[:-2]}{n:02d}"
        new = names.rewrite(text, names.find(text))
        digits = "+" + "".join(c for c in new if c.isdigit())
        assert new != text and digits.startswith(code) and len(new) == len(text)
        assert back.rewrite(new, back.find(new)) == text
        seen.add(new)
    assert len(seen) == 30


def test_other_digits_are_left_as_they_are():
    arabic = "".join(chr(0x660 + int(c)) if c.isdigit() else c for c in "2020-02-28 and 4111 1111 1111 1111, +49 30 1234567")
    for extra in ("", " 2020-02-28", " 12 34"):
        names = pii.Pseudonyms()
        text = arabic + extra
        new = names.rewrite(text, names.find(text))
        assert new.startswith(arabic)
        back = pii.Pseudonyms(backward=True)
        assert back.rewrite(new, back.find(new)) == text


def plain_spans(text):
    """Every match of a kind, first kinds first, against everything found so far."""
    names, found = pii.Pseudonyms(), []
    for kind, shape in pii.SHAPES.items():
        for m in shape.finditer(text):
            if all(m.end() <= a or b <= m.start() for a, b, _ in found) and names.kinds[kind](m[0]) is not None:
                found.append((m.start(), m.end(), kind))
    return sorted(found)


def test_spans_agree_with_a_plain_search():
    rnd = random.Random(3)
    parts = ["4111 1111 1111 1111", "2020-02-29", "25/12/1999", "+49 30 1234567", "a.b@c.de", "10.0.0.1", "123-45-6789", "GB82 WEST 1234 5698 7654 32", "12", "x", "-", "1.2.2003"]
    for _ in range(200):
        text = rnd.choice([" ", "", ","]).join(rnd.choices(parts, k=rnd.randint(1, 25)))
        assert [(a, b, k) for a, b, k, _ in pii.Pseudonyms().find(text)] == plain_spans(text)


def test_time_grows_with_the_text():
    def seconds(n):
        text = " ".join(f"u{i}@mail.example.com +49 30 {1000000 + i}" for i in range(n))
        names, begin = pii.Pseudonyms(), time.process_time()
        assert len(names.find(text)) == 2 * n
        return time.process_time() - begin

    seconds(100)
    assert seconds(4000) < 8 * max(seconds(1000), 0.02)


def test_permutations_are_not_held_for_ever():
    names = pii.Pseudonyms()
    text = " ".join("a" * (1 + i % 60) + "1" * (i // 60) + "@b.co" for i in range(pii.PERMUTATIONS_HELD // 8))
    names.find(text)
    assert names.permutation.cache_info().maxsize == pii.PERMUTATIONS_HELD


def test_the_key_is_a_setting(spark):
    from ledgerloom.llm import queries

    sf = "/root/testdata/sf0.001"
    first = {(r.doc_id, r.text) for r in queries.op8_feistel_pseudonyms(spark, sf).collect()}
    spark.conf.set(pii.KEY_SETTING, "another")
    try:
        second = {(r.doc_id, r.text) for r in queries.op8_feistel_pseudonyms(spark, sf).collect()}
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert first != second and second == {(r.doc_id, r.text) for r in queries.op8_feistel_pseudonyms(spark, sf, b"another").collect()}
    with pytest.raises(ValueError):
        pii.pseudonymise(frame(spark, [(1, "x")]).withColumnRenamed("lang", "PII"))
