"""Collocations, alignment and packing against plain versions, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import alignment, collocations, packing, spelling
from tests.llm.brute import UPPER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["the", "of", "Old", "new", "Ünder", "sea", "a", "b"]


def path(name):
    return public_tokenizers.path(name)


def content(name, binary=False):
    with open(path(name), "rb") as f:
        return f.read() if binary else f.read().decode()


# --- 11 collocations ----------------------------------------------------------------------


def plain_collocations(rows, support, top):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= support}
    out = defaultdict(list)
    for (lang, words), a in candidates.items():
        score, _, l, r = min((2000000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
        longer = [b for (g, v), b in candidates.items() if g == lang and len(v) > len(words) and any(v[i : i + len(words)] == words for i in range(len(v)))]
        if not any(100 * b >= 80 * a for b in longer):
            out[lang].append((-score, -a, " ".join(words).encode(), l, r))
    return {
        (lang, rank, phrase.decode(), -a, l, r, n[lang], -score)
        for lang, found in out.items() for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1)
    }


def phrase_rows(seed=4, n=150):
    rnd = random.Random(seed)
    fixed = ["the old sea", "of new a b", "Ünder the sea of"]
    signs = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "; ", " - "]
    rows = []
    for i in range(n):
        parts = [rnd.choice(fixed if rnd.random() < 0.4 else WORDS) + rnd.choice(signs) for _ in range(rnd.randint(0, 25))]
        rows.append((i, "".join(parts), rnd.choice(["en", "en", "de", None, "und"]), "s", 1))
    return [*rows, (None, None, None, None, None), (3, "", "fr", "s", 0), (3, " \t.,", "fr", "s", 0), rows[5], rows[5], (9, "x " * 5000, "xx", "s", 0), (10, "y" * 9000 + " z" * 40, "xx", None, None)]


@pytest.mark.parametrize(("support", "top", "bits"), [(30, 2000, 16), (3, 10, 11), (9, 2000, 20)])
def test_collocations(spark, support, top, bits):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = collocations.collocations(docs, support=support, top=top, bits=bits)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = [tuple(r) for r in found.collect()]
    want = plain_collocations([(t, g) for _, t, g, _, _ in rows], support, top)
    assert len(got) == len(want) and set(got) == want and want


def test_collocations_odd_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA), bits=12).count() == 0
    clash = "phrase string, lang string, text string, f long, words int, rank long, part int, score double"
    docs = spark.createDataFrame([("p", "en", "x y " * 40, 1, 1, 1, 1, 0.5)] * 2, clash)
    got = {tuple(r) for r in collocations.collocations(docs, bits=12).collect()}
    assert got == plain_collocations([("x y " * 40, "en")] * 2, 30, 2000)
    with pytest.raises(ValueError):
        collocations.collocations(docs, support=10_000)


def test_shards_never_hide_a_phrase(spark):
    """Exactly the support, one occurrence a document, spread over many partitions."""
    rows = [(i, "rare pair here", "en", "s", 1) for i in range(30)] + [(i, "rare word there", "en", "s", 1) for i in range(29)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(13)
    got = {r.phrase for r in collocations.collocations(docs, bits=24).collect()}
    assert got == {"rare pair here"}


def test_equal_hashes_are_told_apart():
    data = np.frombuffer(b"aabbaacc", np.uint8)
    starts = np.arange(0, 8, 2)
    for hashes in (None, np.zeros(4, np.uint64)):
        first, which = spelling.distinct_spans(data, starts, starts + 2, hashes)
        assert [data[s : s + 2].tobytes() for s in starts[first[which]]] == [b"aa", b"bb", b"aa", b"cc"]


# --- 12 alignment -------------------------------------------------------------------------

ODD_TEXTS = [
    None, "", " ", "  ", "a", " a ", " a  b", "\n", "\n a\n\n  b \t c\r\n", "▁", "a▁b", "ﬁ ﬀ é é", "中文 字符　 x", "<|endoftext|> x",
    "<s> </s> <unk> <0x41>", "😀 👍🏽", "don't 'S it's z", "\x00 a\x00b", "a" * 3000 + " b", "  a \x85 b", "word " * 4000, "Ａ １",
]


def both_ids(text, a, b, bytes_a, bytes_b):
    """Ids of both libraries over the whole text, or none."""
    if not text:
        return [], []
    one, two = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    whole = (" " + text).encode()
    if b"".join(bytes_a[i] for i in one) != whole or b"".join(bytes_b[i] for i in two) != whole:
        return [], []
    return one, two


def plain_groups(one, two, bytes_a, bytes_b):
    def ends(ids, table):
        out, at = {}, 0
        for k, i in enumerate(ids):
            at += len(table[i])
            out[at] = k + 1
        return out

    ends_a, ends_b = ends(one, bytes_a), ends(two, bytes_b)
    i = j = 0
    groups = []
    for e in sorted(set(ends_a) & set(ends_b)):
        groups.append((one[i : ends_a[e]], two[j : ends_b[e]]))
        i, j = ends_a[e], ends_b[e]
    return groups


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    alphabet = alignment.byte_alphabet()
    bytes_a = {i: bytes(alphabet.get(c, 0) for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    bytes_b = {i: alignment.piece_bytes(b.id_to_piece(i)) for i in range(b.vocab_size())}
    return a, b, bytes_a, bytes_b


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(8)
    mixed = ["".join(rnd.choices(" \n\ta b'.,é中1٣́ 　ﬁ😀<>|", k=rnd.randint(1, 60))) for _ in range(150)]
    return [*ODD_TEXTS, *mixed, *mixed[:3]]


def test_alignment(spark, sides, odd_texts):
    docs = spark.createDataFrame([(k if k % 7 else None, t, "en", "s", 1) for k, t in enumerate(odd_texts)], SCHEMA).repartition(4)
    a, b = content("byte_bpe_50k.json"), content("piece_bpe_32k.model", binary=True)
    all_groups = {t: plain_groups(*both_ids(t, *sides), *sides[2:]) for t in odd_texts}
    counts = Counter((x[-1], y[-1]) for t in odd_texts for x, y in all_groups[t])
    highest = {}
    for (_, y), n in counts.items():
        highest[y] = max(n, highest.get(y, 0))
    want = Counter()
    for k, t in enumerate(odd_texts):
        one, two = both_ids(t, *sides)
        links = [(x[-1], y[-1]) for x, y in all_groups[t]]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in all_groups[t])
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        want[(k if k % 7 else None, len(one), len(two), len(links), len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), digest)] += 1
    found = alignment.op12_align(docs, a, b)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in found.collect()) == want
    # the general interface: whole lists, and the ranks where groups end
    for r in alignment.align(docs.select("text", "n_chars", "doc_id").withColumnRenamed("text", "body"), a, b, text="body", keep=["doc_id", "body"]).collect():
        got = []
        i = j = 0
        for x, y in zip(r.a_ends, r.b_ends, strict=True):
            got.append((r.a_ids[i:x], r.b_ids[j:y]))
            i, j = x, y
        assert got == all_groups[r.body]
    assert alignment.op12_align(docs.limit(0), a, b).count() == 0
    with pytest.raises(ValueError):
        alignment.align(docs.withColumnRenamed("lang", "A_ids"), a, b)


def test_whole_texts_when_pieces_are_not_independent(sides, odd_texts):
    """A vocabulary whose pieces may cross spaces is used on whole texts, with equal results here."""
    a, b = alignment.byte_level(content("byte_bpe_50k.json")), alignment.piece_level(content("piece_bpe_32k.model", binary=True))
    assert a.by_units is None and b.by_units
    column = pa.array(odd_texts, pa.string())
    parts, whole = alignment.Aligned(column, a, b), alignment.Aligned(column, *(alignment.Spelling(s.plain, s.tokens, False) for s in (a, b)))
    for x, y in zip((*parts.ids, *parts.at), (*whole.ids, *whole.at), strict=True):
        assert np.array_equal(x, y)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 400), max_size=150), st.sets(st.integers(1, 400), max_size=150)), max_size=5))
def test_gallop_is_intersection(docs):
    a, b, first_a, first_b, base = [], [], [0], [0], 0
    for x, y in docs:
        a += [base + e for e in sorted(x)]
        b += [base + e for e in sorted(y)]
        base += 401
        first_a.append(len(a))
        first_b.append(len(b))
    i, j = alignment.common(np.array(a, np.int64), np.array(b, np.int64), np.array(first_a), np.array(first_b))
    both = sorted(set(a) & set(b))
    assert [a[k] for k in i] == both and [b[k] for k in j] == both


# --- 13 packing ---------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 4), max_size=5), st.integers(0, 40))
def test_closest(counts, room):
    picked = packing.closest(counts, room)
    best = max(s for s in (sum(n * c for n, c in zip(counts, some, strict=True)) for some in product(*(range(c + 1) for c in counts.values()))) if s <= room)
    assert sum(n * c for n, c in picked) == best
    assert all(0 < c <= counts[n] for n, c in picked) and len({n for n, _ in picked}) == len(picked)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=80), st.sampled_from([0, 3, 64]))
def test_held_places_every_token(lengths, slack):
    held = packing.Held()
    for row, n in enumerate(lengths):
        held.add(n, row, 0)
    windows = [*held.fill(64, slack), *held.rest()]
    covered = Counter((row, start + k) for w in windows for row, start, n in w for k in range(n))
    assert covered == Counter((row, k) for row, n in enumerate(lengths) for k in range(n))
    sizes = [sum(n for _, _, n in w) for w in windows]
    assert all(0 < s <= 64 for s in sizes)
    assert slack or all(s & s - 1 == 0 for s in sizes)
    assert all(64 - s <= slack or s & s - 1 == 0 for s in sizes)


def check_pieces(rows, texts, encode, capacity):
    """Every id of every text once, in gapless sequences without padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity and at & at - 1 == 0
    assert set(by_doc) == set(texts)
    for doc_id, same in texts.items():
        ids = [*encode(same[0] or ""), 1]
        spans = Counter((r.start, r.length) for r in by_doc[doc_id])
        covered = Counter(k for (start, n), times in spans.items() for k in range(start, start + n) for _ in range(times))
        assert covered == {k: len(same) for k in range(len(ids))}
        for r in by_doc[doc_id]:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_packing(spark):
    rnd = random.Random(5)
    words = ["don't", "The", "x1y22", "('s", "It's", "Été", "é", "中文", "a,b", "3.14", "<|endoftext|>", "ﬁ", "Σας", "'re", "--'t", "😀", "Ünï", "'s'S", "a'1", "9'll"]
    texts = {}
    for i in range(120):
        parts = [rnd.choice(words) + rnd.choice([" ", " ", "\n", "", "\t", " ", "  "]) for _ in range(rnd.choice([0, 3, 40, 300, 900]))]
        texts[i] = ["".join(parts)]
    texts |= {500: [None], 501: ["", ""], 502: ["same text here " * 300] * 5, None: ["no id"], 503: ["long " * 9000]}
    rows = [(i, t, "en", "s", 1) for i, same in texts.items() for t in same]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    found = packing.op13_pack(docs, content("word_bpe_49k.json"))
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check_pieces(found.collect(), texts, lambda t: tokenizer.encode(t, add_special_tokens=False).ids, 2048)


def test_packing_in_many_flushes(spark):
    texts = {i: ["word " * (i % 37)] for i in range(400)}
    docs = spark.createDataFrame([(i, t[0], "en", "s", 1) for i, t in texts.items()], SCHEMA).coalesce(1)
    name = content("word_bpe_49k.json")
    found = packing.pack(docs.withColumnRenamed("text", "Body"), name, text="Body", keep=["doc_id", "lang"], capacity=64, held_tokens=500)
    assert found.columns[:2] == ["doc_id", "lang"]
    rows = found.selectExpr("*", "crc32(ids) as ids_crc32").collect()
    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    check_pieces(rows, texts, lambda t: tokenizer.encode(t, add_special_tokens=False).ids, 64)
    assert {r.lang for r in rows} == {"en"}


def test_packing_odd_tables(spark):
    name = content("word_bpe_49k.json")
    assert packing.op13_pack(spark.createDataFrame([], SCHEMA), name).count() == 0
    docs = spark.createDataFrame([(1, "x", "en", "s", 1)], SCHEMA)
    with pytest.raises(ValueError):
        packing.pack(docs.withColumnRenamed("lang", "Offset"), name)
    with pytest.raises(ValueError):
        packing.pack(docs, name, capacity=100)
    assert packing.by_pieces(name) and not packing.by_pieces(content("byte_bpe_50k.json"))
    # a tokenizer that isn't known to part texts so encodes them whole
    other = packing.pack(docs, content("byte_bpe_50k.json"), closing=None).collect()
    assert [(r.start, r.length, r.doc_tokens) for r in other] == [(0, 1, 1)]
