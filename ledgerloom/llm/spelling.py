"""Token ids of whole texts from the ids of their distinct pieces.

A block of texts is cut into pieces that a tokenizer treats independently; each
distinct piece is encoded once, and the ids are put together by position. Equal
pieces are found by hash and then compared byte by byte, so a collision can't give
wrong ids.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np

from ledgerloom.llm.textarrays import long_spans_hash, ranges

COMPARED = 1 << 20  # bytes compared at once
CACHED = 4
KNOWN_PIECES = 300_000  # that a worker remembers; then it begins anew


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): one span of each distinct content, and the content of every span.

    Spans are sorted and don't overlap unless their hashes are given.
    """
    if hashes is None:
        hashes = long_spans_hash(data, starts, ends)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    if not _same(data, starts, ends, first[which]):
        contents: dict[bytes, int] = {}
        which = np.fromiter((contents.setdefault(data[a:b].tobytes(), len(contents)) for a, b in zip(starts, ends, strict=True)), np.int64, len(starts))
        _, first = np.unique(which, return_index=True)
    return first, which


def _same(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, as_span: np.ndarray) -> bool:
    """Whether each span has the bytes of the span that stands for it."""
    sizes = ends - starts
    if (sizes != sizes[as_span]).any():
        return False
    steps = np.cumsum(sizes)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(steps, (steps[i - 1] if i else 0) + COMPARED, side="right")))
        if j == i + 1:
            a, b = starts[i], starts[as_span[i]]
            same = np.array_equal(data[a : a + sizes[i]], data[b : b + sizes[i]])
        else:
            same = (data[ranges(starts[i:j], sizes[i:j])] == data[ranges(starts[as_span[i:j]], sizes[i:j])]).all()
        if not same:
            return False
        i = j
    return True


class Spelled:
    """Ids of a block: piece p has the ids `flat[at[p] : at[p] + sizes[p]]`."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode: Callable[[list[str]], list[bytes]]):
        first, self.which = distinct_spans(data, starts, ends)
        raw = data.tobytes()
        #: distinct pieces, as text, and their ids
        self.pieces = [raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        lists = encode(self.pieces)
        self.own = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        self.flat = np.frombuffer(b"".join(lists), np.int32)
        self.sizes = self.own[self.which]
        self.at = (np.cumsum(self.own) - self.own)[self.which]

    def ids(self, chosen=slice(None)) -> np.ndarray:
        """Ids of the chosen pieces, one after the other."""
        return self.flat[ranges(self.at[chosen], self.sizes[chosen])]


class Remembered:
    """An encoder that asks another one only for pieces it has not met of late.

    The ids of a piece are 32-bit numbers in a byte string. Pieces live in two
    generations: when the younger one is full it becomes the older one, whose pieces
    are forgotten unless they were met meanwhile.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], known: int = KNOWN_PIECES):
        self.encode = encode
        self.known = known
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.young) >= self.known:
            self.young, self.old = {}, self.young
        found = list(map(self.young.get, texts))
        rest = [k for k, ids in enumerate(found) if ids is None]
        asked = []
        for k in rest:
            ids = self.old.get(texts[k])
            if ids is None:
                asked.append(k)
            else:
                found[k] = self.young[texts[k]] = ids
        if asked:
            lists = self.encode([texts[k] for k in asked])
            ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists))) * 4
            raw = np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]) // 4).tobytes()
            begin = 0
            for k, end in zip(asked, ends.tolist(), strict=True):
                found[k] = self.young[texts[k]] = raw[begin:end]
                begin = end
        return found


@lru_cache(CACHED)
def json_tokenizer(content: str):
    """A tokenizer of the library `tokenizers`, once for each worker; special tokens are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content)
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(CACHED)
def piece_tokenizer(content: bytes):
    """A tokenizer of the library `sentencepiece`, once for each worker."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=content)
