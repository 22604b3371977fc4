"""Plain Python versions of the contracts, one document at a time."""

from __future__ import annotations

import hashlib
import re

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NONSPACE = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def alnum(text):
    return ALNUM.findall((text or "").translate(UPPER))


def nonspace(text):
    return NONSPACE.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def decontaminate(docs, items, window=10):
    table = {}
    for item_id, text in items:
        words = alnum(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            table.setdefault(tuple(words[i : i + n]), set()).add(item_id)
    lengths = {len(k) for k in table}
    out = []
    for doc_id, text in docs:
        words = alnum(text)
        hit, ids = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                found = table.get(tuple(words[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    ids |= found
        out.append((doc_id, len(words), len(hit), len(ids), sha(",".join(sorted(str(i) for i in ids if i is not None))), bool(hit)))
    return out


def substring_dedup(docs, window=50):
    first = {}
    for doc_id, text in docs:
        words = nonspace(text)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in docs:
        words = nonspace(text)
        gone = set()
        for i in range(len(words) - window + 1):
            if doc_id is not None and first[tuple(words[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        out.append((doc_id, len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    return out


def quality_counts(text):
    words = nonspace(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if NONSPACE.search(line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated), n < 20 or 100 * len(repeated) > 30 * n


def shingles(text, k=5):
    words = alnum(text)
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
