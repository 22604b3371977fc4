"""Quality classifier: a linear-chain conditional random field over lines.

Each line with a word is good or bad; its features are shares of its own characters
and words and those of its neighbours. The field is trained here on a bounded sample
of labelled documents (at most `PER_CLASS` of each label, all lines of each; lines take
the label of their document). Forward-backward marginals of
all lines of a whole text, weighted by length, give the document's share of good
text, which a logistic curve fitted on the same sample turns into the score. Scoring
is one narrow pass; the model is a few hundred numbers.

Defined results: null or empty texts, and texts without a word, have no line and get
the share of good labels as score; repeated rows get equal scores; null ids count as
the empty text when rows are held out; documents with contradicting labels and null
labels are not trained on. labels, lang, source and doc_id are never features. Other
columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.textarrays import NONSPACE, Words, blocks, column_bytes, give_back, keyed, long_spans_hash

BLOCK_BYTES = 2 << 20
PER_CLASS = 1500
CHAIN = 60  # lines of one training chain
STEPS = 200
# The byte classes whose shares of a line are features.
CLASSES = {
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "symbol": b"#*$%&<>@^~=_\\/+",
    "pipe": b"|",
    "bang": b"!?",
    "stop": b".,;:",
    "bracket": b"()[]{}\"'`-",
    "high": bytes(range(128, 256)),
}
OWN = ["one", "log_words", "word_length", "distinct", "seen", *CLASSES]
NEIGHBOUR = ["distinct", "seen", "upper", "symbol", "pipe", "bang", "digit"]
FEATURES = [*OWN, *(f"before_{f}" for f in NEIGHBOUR), *(f"after_{f}" for f in NEIGHBOUR), "is_first", "is_last"]


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line with a word, bytes of each line, first line of each text)."""
    data, offsets = column_bytes(column)
    words = Words(data, offsets, NONSPACE, lower=False)
    breaks = np.flatnonzero(data == 10)
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    starts = np.sort(np.concatenate([breaks + 1, offsets[:-1]]), kind="stable")
    low, high = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    full = high > low
    starts, ends, low, high = starts[full], ends[full], low[full], high[full]
    n = len(starts)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    first = np.searchsorted(doc, np.arange(len(offsets)))
    size, n_words = (ends - starts).astype(float), (high - low).astype(float)
    own = {"one": np.ones(n), "log_words": np.log1p(n_words) / 5}
    letters = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
    own["word_length"] = np.minimum((letters[high] - letters[low]) / np.maximum(n_words, 1) / 20, 3)
    line_of_word = np.repeat(np.arange(n), high - low)
    _, once = np.unique(keyed(words.hashes, line_of_word), return_index=True)
    # shares of short lines are drawn towards those of clean text
    own["distinct"] = (np.bincount(line_of_word[once], minlength=n) + 5) / (n_words + 5)
    _, once = np.unique(keyed(long_spans_hash(data, starts, ends), doc), return_index=True)
    own["seen"] = np.ones(n)
    own["seen"][once] = 0
    code = np.zeros(256, np.int64)
    for k, members in enumerate(CLASSES.values(), 1):
        code[list(members)] = k
    line_of_byte = np.zeros(len(data) + 1, np.int32)
    np.add.at(line_of_byte, starts, 1)
    np.add.at(line_of_byte, ends, -1)
    inside = np.cumsum(line_of_byte[:-1]) > 0
    line = np.searchsorted(starts, np.flatnonzero(inside), side="right") - 1 if n else np.empty(0, np.int64)
    table = np.bincount(line * 16 + code[data[inside]], minlength=n * 16).reshape(n, 16) if n else np.zeros((0, 16))
    for k, name in enumerate(CLASSES, 1):
        own[name] = table[:, k] / (size + 20)
    x = np.zeros((n, len(FEATURES)))
    for k, name in enumerate(OWN):
        x[:, k] = own[name]
    is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
    with_lines = first[:-1][np.diff(first) > 0]
    is_first[with_lines] = True
    is_last[(first[1:] - 1)[np.diff(first) > 0]] = True
    base = len(OWN)
    for k, name in enumerate(NEIGHBOUR):
        x[1:, base + k] = own[name][:-1]
        x[is_first, base + k] = 0
        x[:-1, base + len(NEIGHBOUR) + k] = own[name][1:]
        x[is_last, base + len(NEIGHBOUR) + k] = 0
    x[:, -2], x[:, -1] = is_first, is_last
    return x, size, first


@dataclass
class Model:
    weights: np.ndarray  # log odds of good for each feature
    moves: np.ndarray  # log potentials, [from, to]; 0 bad, 1 good
    scale: np.ndarray  # logistic curve over the share of good text: slope and offset
    empty: float  # score of a text without lines

    def _pass(self, odds: np.ndarray) -> np.ndarray:
        t = self.moves
        return np.logaddexp(t[1, 1] + odds, t[0, 1]) - np.logaddexp(t[1, 0] + odds, t[0, 0])

    def marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability that a line is good, by forward-backward; texts run side by side."""
        own = x @ self.weights
        counts = np.diff(first)
        order = np.argsort(-counts, kind="stable")
        begin, sizes = first[:-1][order], counts[order]
        longest = int(sizes[0]) if len(sizes) else 0
        live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest)]  # texts with over t lines
        forward, backward = own.copy(), np.zeros_like(own)
        back = Model(self.weights, self.moves.T, self.scale, self.empty)
        for t in range(1, longest):
            at = begin[: live[t]] + t
            forward[at] += self._pass(forward[at - 1])
            at = (begin + sizes - 1 - t)[: live[t]]
            backward[at] = back._pass(own[at + 1] + backward[at + 1])
        return 1 / (1 + np.exp(-np.clip(forward + backward, -50, 50)))

    def share(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted share of good text; nan without lines."""
        good = np.concatenate([[0], np.cumsum(self.marginals(x, first) * size)])
        whole = np.concatenate([[0], np.cumsum(size)])
        with np.errstate(invalid="ignore", divide="ignore"):
            return (good[first[1:]] - good[first[:-1]]) / (whole[first[1:]] - whole[first[:-1]])

    def score(self, share: np.ndarray) -> np.ndarray:
        p = np.clip(share, 1e-4, 1 - 1e-4)
        out = 1 / (1 + np.exp(-(self.scale[0] * np.log(p / (1 - p)) + self.scale[1])))
        return np.where(np.isnan(share), self.empty, out)


class _Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, x: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return x - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def fit(lines: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray, prior: float, steps: int = STEPS) -> Model:
    """Maximum likelihood with a small penalty; both labels weigh the same, prior is restored by the curve."""
    # A long document is trained on as several chains, so that short ones aren't padded to its length.
    chains = [(i, rows[k : k + CHAIN]) for i, rows in enumerate(lines) for k in range(0, len(rows), CHAIN)]
    counts = np.array([len(rows) for _, rows in chains], np.int64)
    n, longest = len(chains), max(counts, default=0)
    x = np.zeros((n, longest, len(FEATURES)), np.float32)
    for i, (_, rows) in enumerate(chains):
        x[i, : len(rows)] = rows
    mask = np.arange(longest) < counts[:, None]
    whole = labels.astype(float)
    each = np.where(whole == 1, 0.5 / max(whole.sum(), 1), 0.5 / max((1 - whole).sum(), 1)) / np.maximum([len(rows) for rows in lines], 1)
    owner = np.array([i for i, _ in chains], np.int64)
    y, weight = whole[owner], each[owner]
    state = np.zeros(len(FEATURES) + 4)
    adam = _Adam(len(state), 0.1)
    both = mask[:, 1:]
    for _ in range(steps):
        w, moves = state[:-4], state[-4:].reshape(2, 2)
        own = np.stack([np.zeros((n, longest)), x @ w.astype(np.float32)], axis=2)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = own[:, 0]
        for t in range(1, longest):
            step = np.logaddexp(alpha[:, t - 1, :1] + moves[0], alpha[:, t - 1, 1:] + moves[1]) + own[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            after = own[:, t + 1] + beta[:, t + 1]
            step = np.logaddexp(moves[:, 0] + after[:, :1], moves[:, 1] + after[:, 1:])
            beta[:, t] = np.where(mask[:, t + 1, None], step, 0)
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        good = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total[:, None]) * mask
        error = (good - y[:, None] * mask) * weight[:, None]
        gradient = np.concatenate([np.einsum("nt,ntf->f", error, x), np.zeros(4)])
        for a in range(2):
            for b in range(2):
                pair = np.exp(alpha[:, :-1, a] + moves[a, b] + own[:, 1:, b] + beta[:, 1:, b] - total[:, None]) * both
                true = (y[:, None] == a) * (y[:, None] == b) * both
                gradient[len(FEATURES) + 2 * a + b] = ((pair - true) * weight[:, None]).sum()
        gradient += 1e-4 * state
        gradient[-4:] += 1e-2 * state[-4:]
        state = adam.step(state, gradient)
    model = Model(state[:-4], state[-4:].reshape(2, 2), np.array([1.0, 0.0]), prior)
    first = np.concatenate([[0], np.cumsum([len(rows) for rows in lines])]).astype(np.int64)
    flat = np.concatenate([np.asarray(r, float) for r in lines]) if n else np.zeros((0, len(FEATURES)))
    share = model.share(flat, np.concatenate(sizes) if n else np.zeros(0), first)
    use = ~np.isnan(share)
    logit = np.log(np.clip(share[use], 1e-4, 1 - 1e-4) / (1 - np.clip(share[use], 1e-4, 1 - 1e-4)))
    true = whole[use]
    balance = np.where(true == 1, prior / max(true.sum(), 1), (1 - prior) / max((1 - true).sum(), 1))
    curve, adam = np.array([1.0, 0.0]), _Adam(2, 0.05)
    for _ in range(400):
        p = 1 / (1 + np.exp(-(curve[0] * logit + curve[1])))
        error = (p - true) * balance
        curve = adam.step(curve, np.array([(error * logit).sum(), error.sum()]) + 1e-4 * (curve - [1, 0]))
    model.scale = np.array([max(curve[0], 1e-3), curve[1]])
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from labelled rows that are not held out. What comes to the driver is bounded by per_class."""
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other")
    )
    share = {r[0]: r[1] for r in usable.groupBy("label").count().collect()}
    prior = share.get(1, 0) / max(1, sum(share.values())) if share else 0.5
    parts = [usable.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    sample = parts[0].union(parts[1]).select("doc_id", "label")
    # at most 2 x per_class ids: bounded, so it is broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in blocks(batch.column("text"), BLOCK_BYTES):
                part = batch.slice(begin, end - begin)
                x, size, first = line_features(part.column("text"))
                lines = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"),
                    part.column("label").cast(pa.int32()),
                    pa.array([x[a:b].astype("<f4").tobytes() for a, b in lines], pa.binary()),
                    pa.array([size[a:b].astype("<f4").tobytes() for a, b in lines], pa.binary()),
                ], names=["doc_id", "label", "x", "size"])

    rows = texts.mapInArrow(features, "doc_id long, label int, x binary, size binary").collect()
    rows = sorted((r for r in rows if len(r.size)), key=lambda r: r.doc_id)
    if len({r.label for r in rows}) < 2:
        return Model(np.zeros(len(FEATURES)), np.zeros((2, 2)), np.array([1.0, np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))]), prior)
    lines = [np.frombuffer(r.x, "<f4").reshape(-1, len(FEATURES)) for r in rows]
    return fit(lines, [np.frombuffer(r.size, "<f4").astype(float) for r in rows], np.array([r.label for r in rows]), prior)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with `out`, the quality of each whole text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"choose another name than {out} for the score")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in blocks(batch.column(text), BLOCK_BYTES):
                part = batch.slice(begin, end - begin)
                found = model.score(model.share(*line_features(part.column(text))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], schema=arrow)
        give_back()

    return docs.mapInArrow(run, schema)


def accept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents with a score of at least `least`; columns as they were."""
    name = "score__"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return score(docs, model, out=name).where(F.col(name) >= least).select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
