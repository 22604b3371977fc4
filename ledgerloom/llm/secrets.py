"""Secret scan: fixed patterns, and novelty against a zstandard dictionary.

The base kinds are patterns. The method adds `novel` spans: a run of key characters,
any part of which lies within NEAR characters of a sensitive word, whose marginal
compressed size, given the CONTEXT characters on both sides and a dictionary of code and
identifiers, stays close to its own size. C(around + run) - C(around) with the primed
compressor is that size: names and repeated text cost little, random keys cannot be
compressed: of 400 random keys of letters and digits each, in prose of four forms, 0.89 of
those of 16 characters were found at MIN_NOVELTY, 0.99 of 20, and all of 32 and 64; of
names of code none. Runs are taken whole, however long, and each is measured once; words, runs and
base spans are walked side by side, so a text takes time in proportion to its length.

Defined results: null texts count as empty, empty texts have no spans; a table without
rows gives none; very long texts are scanned whole; repeated rows get equal results;
positions are code points, ends exclusive; of spans that begin together the kind listed
first comes first; a novel span never overlaps a base span. Other columns pass through
unread; the name of the result must not be among them, whatever its case (ValueError).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.textarrays import give_back

# The patterns of the base kinds, sensitive words, and identifiers of ordinary code.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones need not be matched and dropped
KINDS = ["assign", "access", "hex", "novel"]
SENSITIVE = re.compile(r"password|passwd|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|bearer|authori[sz]ation", re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SUSPECT = r"(?i)password|passwd|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|bearer|authori[sz]ation"
IDENTIFIERS = """
public static final class interface extends implements return private protected void
function const let var import export from default async await promise undefined null
def self init args kwargs lambda yield raise except finally assert global nonlocal
int float double string boolean char unsigned signed long short struct union enum
include define ifdef endif pragma namespace template typename virtual override
select insert update delete where group order limit values create table index
http https www com org net html css json xml yaml config settings options parameters
username password passwd secret token api_key apikey access_key private_key client_id
client_secret authorization bearer credential certificate session cookie localhost
example sample placeholder changeme your_password_here your_api_key_here xxxxxxxxxxxx
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef
getElementById addEventListener createElement querySelector appendChild innerHTML
request response handler controller service repository manager factory builder
buffer stream reader writer iterator collection container element document window
"""
CONTEXT = 256
NEAR = 80
MIN_NOVELTY = 0.5

FINDINGS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("value_start", T.IntegerType()),
    T.StructField("novelty", T.DoubleType()),
]))


class Novelty:
    """Marginal compressed bytes of a string, given the text around it, per character."""

    def __init__(self, dictionary: str = IDENTIFIERS):
        raw = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=9)
        self.zip = zstandard.ZstdCompressor(dict_data=raw, write_content_size=False)

    def of(self, around: str, value: str) -> float:
        alone = len(self.zip.compress(around.encode()))
        return (len(self.zip.compress((around + value).encode())) - alone) / len(value)


def _mixed(value: str) -> bool:
    """Letters and digits, or both cases within: no plain word or number."""
    digit = any(c.isdigit() for c in value)
    return (digit and any(c.isalpha() for c in value)) or (not value[1:].islower() and not value[1:].isupper() and any(c.isupper() for c in value[2:]) and any(c.islower() for c in value))


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the base kinds."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return out


def _near(text: str) -> Iterator[tuple[int, int]]:
    """Spans of key characters any part of which is near a sensitive word, in order."""
    words = [(w.start() - NEAR, w.end() + NEAR) for w in SENSITIVE.finditer(text)]
    k = 0
    for m in CANDIDATE.finditer(text) if words else ():
        # the ends of words ascend, so one that ends before this run ends before all later ones
        while k < len(words) and words[k][1] <= m.start():
            k += 1
        if k == len(words):
            return
        if words[k][0] < m.end():
            yield m.span()


def scan(text: str, novelty: Novelty) -> list[tuple[int, int, int, int, float | None]]:
    """All spans in order: (start, kind, end, start of the value, novelty)."""
    found = [(*s, None) for s in base_spans(text)]
    claimed = sorted((s[0], s[2]) for s in found)
    k = reach = 0
    for start, end in _near(text):
        while k < len(claimed) and claimed[k][0] < end:
            reach = max(reach, claimed[k][1])
            k += 1
        if reach > start or not _mixed(text[start:end]):
            continue
        value = novelty.of(text[max(0, start - CONTEXT) : start] + text[end : end + CONTEXT], text[start:end])
        if value >= MIN_NOVELTY:
            found.append((start, 3, end, start, value))
    return sorted(found)


def _suspects(column: pa.Array) -> list[int]:
    """Rows whose text can have a span at all, by one linear pass."""
    maybe = pc.match_substring_regex(column, SUSPECT + r"|(?-i:AKIA[A-Z0-9]{14}|[0-9a-f]{16})")
    return [i for i, flag in enumerate(maybe.to_pylist()) if flag]


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """docs with `out`, the spans of each text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"choose another name than {out} for the spans")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, FINDINGS)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            column, found = batch.column(text), [[] for _ in range(len(batch))]
            for i in _suspects(column):
                spans = scan(column[i].as_py(), novelty)
                found[i] = [{"kind": KINDS[k], "start": a, "end": b, "value_start": v, "novelty": x} for a, k, b, v, x in spans]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow.field(out).type)], schema=arrow)
        give_back()

    return docs.mapInArrow(run, schema)


def _redacted(text: str, found: list[tuple[int, int, int, int, float | None]], mark: str) -> str:
    parts, reach = [], 0
    for _, _, end, value, _ in sorted(found, key=lambda f: (f[3], -f[2])):
        if end <= reach:
            continue
        parts += [text[reach : max(reach, value)], mark]
        reach = end
    return "".join(parts) + text[reach:]


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with the values of all found secrets replaced by `mark`; columns as they were."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, place = to_arrow_schema(docs.schema), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for i in _suspects(batch.column(place)):
                if found := scan(texts[i], novelty):
                    texts[i] = _redacted(texts[i], found, mark)
            columns = [*batch.columns[:place], pa.array(texts, arrow.field(place).type), *batch.columns[place + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        give_back()

    return docs.mapInArrow(run, docs.schema)


def redacted_documents(docs: DataFrame) -> DataFrame:
    """documents without secrets; n_chars, where there is one, fits the new texts."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _join(found: list[dict]) -> str:
    return ",".join(f"{f['kind']}:{f['start']}:{f['end']}" for f in found)


def op2_secrets(docs: DataFrame) -> DataFrame:
    """The contract's row for each document."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("secrets").to_pylist()
            base = [[f for f in x if f["kind"] != "novel"] for x in found]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                **{f"n_{k}": pa.array([sum(f["kind"] == k for f in x) for x in found], pa.int64()) for k in KINDS},
                "base_sha256": pa.array([hashlib.sha256(_join(x).encode()).hexdigest() for x in base], pa.string()),
                "spans": pa.array([_join(x) for x in found], pa.string()),
            })

    columns = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    return find_secrets(docs.select("doc_id", "text")).select("doc_id", "secrets").mapInArrow(digest, columns)
