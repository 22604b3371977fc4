"""Adaptive thresholds against a plain version."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from ledgerloom.llm import rules
from tests.llm import brute
from tests.llm.test_operators import ODD, SCHEMA

METRICS = ["symbol_permille", "dup_line_permille", "repeat_permille", "upper_permille", "word_length_tenths"]


def bucket_least(v):
    """The least value of the bucket of v: seven leading bits are kept."""
    if v < 128:
        return v
    shift = v.bit_length() - 7
    return v >> shift << shift


def values_of(text):
    n_words, chars, symbols, dup, repeat, _ = brute.quality_counts(text)
    lines = sum(1 for line in (text or "").split("\n") if brute.NONSPACE.search(line))
    upper = sum("A" <= c <= "Z" for c in text or "")
    share = lambda a, b: 1000 * a // max(1, b)
    return share(symbols, chars), share(dup, lines), share(repeat, n_words), share(upper, chars), 10 * chars // max(1, n_words)


def plain_thresholds(rows):
    groups = {"all": defaultdict(list), "lang": defaultdict(list), "own": defaultdict(list)}
    for _, text, lang, source, _ in rows:
        for m, v in enumerate(values_of(text)):
            groups["all"][m].append(bucket_least(v))
            groups["lang"][lang, m].append(bucket_least(v))
            groups["own"][lang, source, m].append(bucket_least(v))

    def quantile(values, percent):
        values = sorted(values)
        return next(v for i, v in enumerate(values, 1) if 100 * i >= percent * len(values))

    def fence(values):
        return quantile(values, 75) + 3 * (quantile(values, 75) - quantile(values, 25))

    def drawn(values, parent):
        return (len(values) * fence(values) + 100 * parent) // (len(values) + 100)

    out = {}
    for (lang, source, m), values in groups["own"].items():
        whole = groups["all"][m]
        of_lang = drawn(groups["lang"][lang, m], fence(whole))
        out[lang, source, m] = max(drawn(values, of_lang), quantile(whole, 98))
    return out


def plain_kept(rows):
    limits = plain_thresholds(rows)
    out = []
    for doc_id, text, lang, source, _ in rows:
        over = [m for m, v in zip(METRICS, values_of(text), strict=True) if v > limits[lang, source, METRICS.index(m)]]
        failed = "base" if brute.quality_counts(text)[5] else over[0] if over else None
        out.append((doc_id, failed is None, failed))
    return out


def corpus(n=300, seed=2):
    """Prose; a source of code, full of symbols; one of headlines; and junk in all of them."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = rnd.choice(["web", "code", "news"])
        words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 9))) for _ in range(rnd.randint(25, 90))]
        if source == "code":
            words = [w if rnd.random() < 0.5 else f"<{w}>|*" for w in words]
        if source == "news" and rnd.random() < 0.9:
            words = [w.upper() if rnd.random() < 0.5 else w for w in words]
        if rnd.random() < 0.02:
            words = [w + "$$$$$$$$" for w in words]
        lines = [" ".join(words[k : k + 9]) for k in range(0, len(words), 9)]
        if rnd.random() < 0.1:
            lines += [lines[0]] * rnd.randint(1, 6)
        rows.append((i, "\n".join(lines), rnd.choice(["en", "en", "en", "de", None]), source if rnd.random() < 0.98 else None, 1))
    return rows


@pytest.mark.parametrize("seed", [2, 5])
def test_kept_is_that_of_the_plain_version(spark, seed):
    rows = [*corpus(seed=seed), *ODD]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    counts = rules.document_counts(docs)
    found = {(r.lang, r.source, m): r[f"max_{k}"] for r in rules.thresholds(rules.sketches(counts)).collect() for m, k in enumerate(METRICS)}
    assert found == plain_thresholds(rows)
    got = sorted(((r.doc_id, r.kept, r.failed_rule) for r in rules.op6_rules(docs).collect()), key=str)
    assert got == sorted(plain_kept(rows), key=str)
    assert {f for _, _, f in got} >= {None, "base"} and len({f for _, _, f in got}) > 2


def test_the_same_text_is_judged_by_its_source(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choices("abcdef", k=5))
    plain = [(i, " ".join(word() for _ in range(50)), "en", "web", 1) for i in range(400)]
    dense = [(1000 + i, " ".join(word() + ("*<" if rnd.random() < 0.25 else "") for _ in range(50)), "en", "code", 1) for i in range(200)]
    text = " ".join(word() + ("*<" * 2 if k % 3 == 0 else "") for k in range(60))
    rows = [*plain, *dense, (-1, text, "en", "web", 1), (-2, text, "en", "code", 1)]
    kept = {r.doc_id: r.kept for r in rules.op6_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (kept[-1], kept[-2]) == (False, True)
    assert all(kept[i] for i, *_ in plain)


def test_no_threshold_is_a_constant(spark):
    """Scaling what the texts hold scales every threshold."""
    rows = corpus(200)
    limits = lambda rs: {k: v for k, v in plain_thresholds(rs).items() if k[2] == 4}
    longer = [(i, "\n".join(" ".join(w * 3 for w in line.split(" ")) for line in t.split("\n")), g, s, n) for i, t, g, s, n in rows]
    for rs in (rows, longer):
        counts = rules.document_counts(spark.createDataFrame(rs, SCHEMA))
        got = {(r.lang, r.source, 4): r.max_word_length_tenths for r in rules.thresholds(rules.sketches(counts)).collect()}
        assert got == limits(rs)
    assert all(limits(longer)[k] > 2 * v for k, v in limits(rows).items())


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 1)], SCHEMA).withColumnRenamed("n_chars", "N_words")
    with pytest.raises(ValueError):
        rules.document_counts(docs, keep=("doc_id", "N_words"))
    assert rules.op6_rules(docs).count() == 1
