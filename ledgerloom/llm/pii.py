"""Format-preserving Feistel pseudonyms for personal numbers and dates.

Numbers are found by their shape and validated (check digits, ranges, calendar). Each
is a number below the count of its format's values, and a keyed Feistel network with
cycle walking permutes that range, so a pseudonym has the format and validity of its
original, equal values stay equal in all documents, and whoever has the key can
invert it. Every text is rewritten where it stands: no shuffle.

Kinds, in order of precedence: email (letters and digits of the local part, each
within its own class), iban (mod 97), ipv4 (octets), date (calendar days of
1900-2099, each format on its own), card (13-19 digits, Luhn, first digit and check
kept valid), phone (+ and 8-15 digits; calling code kept), ssn (areas, groups). Digits are
the ASCII ones: a value in other digits has another format and is left as it is.

Defined results: null texts stay null and have no values, empty texts have none; an empty
table gives no rows; very long texts are read whole, in time that grows with their length;
repeated rows get equal results; of overlapping matches the earlier kind wins, of one kind
the first; other columns pass through unread; the name of the result must not be among
them, whatever its case (ValueError).
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The session setting that holds the key of the registered query.
KEY_SETTING = "spark.ledgerloom.pii.key"
#: Known to everyone who can read this: for tests and checks only.
DEFAULT_KEY = b"ledgerloom pseudonyms"
ROUNDS = 8
# Shapes of the kinds, and a cheap test that every match passes.
SHAPES = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", re.A),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.A),
    "ipv4": re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", re.A),
    "date": re.compile(r"(?<![\d/.-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?![\d/-]|\.\d)", re.A),
    "card": re.compile(r"(?<![A-Za-z0-9])\d(?:[ -]?\d){12,18}(?![A-Za-z0-9])", re.A),
    "phone": re.compile(r"(?<![\w+])\+\d(?:[ .-]?[(]?\d[)]?){7,14}(?!\d)", re.A),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", re.A),
}
# The calling codes of two digits; 1 and 7 have one, all others three.
TWO_DIGIT_CODES = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
PERMUTATIONS_HELD = 4096
SUSPECT = r"\d\D{0,2}\d|\d.*@|@"
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


class Feistel:
    """A keyed permutation of the whole numbers below n, and its inverse."""

    def __init__(self, key: bytes, kind: str, n: int):
        self.n, self.half = n, max(1, -(-max(n - 1, 1).bit_length() // 2))
        self.mask = (1 << self.half) - 1
        self.key = hashlib.blake2b(f"{kind}:{n}".encode(), key=key[:64], digest_size=32).digest()

    def _round(self, i: int, half: int) -> int:
        size = -(-self.half // 8)
        out = hashlib.blake2b(bytes([i]) + half.to_bytes(size, "big"), key=self.key, digest_size=min(64, size)).digest()
        while len(out) < size:
            out += hashlib.blake2b(out, key=self.key, digest_size=64).digest()
        return int.from_bytes(out[:size], "big") & self.mask

    def forward(self, x: int) -> int:
        while True:
            left, right = x >> self.half, x & self.mask
            for i in range(ROUNDS):
                left, right = right, left ^ self._round(i, right)
            x = left << self.half | right
            if x < self.n:
                return x

    def backward(self, x: int) -> int:
        while True:
            left, right = x >> self.half, x & self.mask
            for i in reversed(range(ROUNDS)):
                left, right = right ^ self._round(i, left), left
            x = left << self.half | right
            if x < self.n:
                return x


def luhn(digits: str) -> int:
    """Luhn sum modulo 10 of a number with its check digit: 0 if valid."""
    return sum(d if i % 2 == 0 else d // 5 + 2 * d % 10 for i, d in enumerate(map(int, reversed(digits)))) % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _radix(c: str) -> tuple[int, int, str] | None:
    """(size of the class of c, place of c in it, first of the class)."""
    for low, size in (("0", 10), ("a", 26), ("A", 26)):
        if low <= c < chr(ord(low) + size):
            return size, ord(c) - ord(low), low
    return None


class Pseudonyms:
    def __init__(self, key: bytes = DEFAULT_KEY, backward: bool = False):
        self.backward = backward
        self.permutation = lru_cache(PERMUTATIONS_HELD)(lambda kind, n: Feistel(key, kind, n))
        self.kinds: dict[str, Callable[[str], str | None]] = {
            "email": self._email, "iban": self._iban, "ipv4": self._ipv4, "date": self._date, "card": self._card, "phone": self._phone, "ssn": self._ssn,
        }

    def _permute(self, kind: str, x: int, n: int) -> int:
        if n < 2:
            return x
        f = self.permutation(kind, n)
        return f.backward(x) if self.backward else f.forward(x)

    def _classes(self, kind: str, text: str) -> str:
        """Letters and digits permuted together, each place within its class."""
        places = [_radix(c) for c in text]
        x, n = 0, 1
        for p in places:
            if p:
                x, n = x * p[0] + p[1], n * p[0]
        shape = "".join(p[2] if p else c for p, c in zip(places, text, strict=True))
        x, out = self._permute(f"{kind}:{shape}", x, n), []
        for p, c in zip(reversed(places), reversed(text), strict=True):
            if p:
                x, d = divmod(x, p[0])
                c = chr(ord(p[2]) + d)
            out.append(c)
        return "".join(reversed(out))

    @staticmethod
    def _refill(text: str, digits: str) -> str:
        rest = iter(digits)
        return "".join(next(rest) if c.isdigit() or c.isalpha() else c for c in text)

    def _email(self, text: str) -> str:
        local, _, host = text.partition("@")
        return f"{self._classes('email', local)}@{host}"

    def _iban(self, text: str) -> str | None:
        bare = text.replace(" ", "")
        if not 15 <= len(bare) <= 34 or mod97(bare) != 1:
            return None
        body = self._classes(f"iban:{bare[:2]}", bare[4:])
        return self._refill(text, f"{bare[:2]}{98 - mod97(bare[:2] + '00' + body):02d}{body}")

    def _ipv4(self, text: str) -> str | None:
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255 or text != ".".join(map(str, parts)):
            return None
        x = self._permute("ipv4", int.from_bytes(bytes(parts), "big"), 1 << 32)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _date(self, text: str) -> str | None:
        parse = self._parsed(text)
        if parse is None:
            return None
        day, order, sign = parse
        x = day.toordinal() - FIRST_DAY
        if not 0 <= x < DAYS:
            return None
        while True:  # until the new text is read in the same order
            x = self._permute(f"date:{order}", x, DAYS)
            new = datetime.date.fromordinal(x + FIRST_DAY)
            values = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
            out = sign.join(values[c] for c in order)
            if self._parsed(out) == (new, order, sign):
                return out

    @staticmethod
    def _parsed(text: str):
        sign = text[4] if text[4] in "-/." else text[2]
        parts = text.split(sign)
        # of two readings the month comes first with a slash and the day otherwise
        for order in ("ymd",) if len(parts[0]) == 4 else ("mdy", "dmy") if sign == "/" else ("dmy", "mdy"):
            v = {c: int(p) for c, p in zip(order, parts, strict=True)}
            try:
                return datetime.date(v["y"], v["m"], v["d"]), order, sign
            except ValueError:
                continue
        return None

    def _card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if luhn(digits) or len(set(digits)) == 1:
            return None
        n = len(digits) - 2
        x = self._permute(f"card:{digits[0]}", int(digits[1:-1]), 10**n)
        body = f"{digits[0]}{x:0{n}d}"
        return self._refill(text, body + str(-luhn(body + "0") % 10))

    def _phone(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if not 8 <= len(digits) <= 15:
            return None
        code = 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3
        n = len(digits) - code
        return self._refill(text, digits[:code] + f"{self._permute(f'phone:{digits[:code]}', int(digits[code:]), 10**n):0{n}d}")

    @staticmethod
    def _valid_ssn(digits: str) -> bool:
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"

    def _ssn(self, text: str) -> str | None:
        digits = text.replace("-", "")
        if not self._valid_ssn(digits):
            return None
        while True:
            digits = f"{self._permute('ssn', int(digits), 10**9):09d}"
            if self._valid_ssn(digits):
                return self._refill(text, digits)

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of the values of a text, in order."""
        found: list[tuple[int, int, str, str]] = []  # in order, without overlaps
        for kind, shape in SHAPES.items():
            new = []
            for m in shape.finditer(text):
                k = bisect.bisect_left(found, (m.start(),))
                if (k and found[k - 1][1] > m.start()) or (k < len(found) and found[k][0] < m.end()):
                    continue
                value = self.kinds[kind](m[0])
                if value is not None:
                    new.append((m.start(), m.end(), kind, value))
            found = sorted(found + new)  # two sorted runs
        return found

    def rewrite(self, text: str, found: list[tuple[int, int, str, str]]) -> str:
        parts, reach = [], 0
        for start, end, _, new in found:
            parts += [text[reach:start], new]
            reach = end
        return "".join(parts) + text[reach:]


FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def pseudonymise(docs: DataFrame, key: bytes = DEFAULT_KEY, text: str = "text", out: str = "pii", backward: bool = False) -> DataFrame:
    """docs with pseudonyms in `text` and `out`, the spans of the replaced values (code points of the input)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"choose another name than {out} for the spans")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, FOUND)])
    arrow, place = to_arrow_schema(schema), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, backward)
        for batch in batches:
            column = batch.column(place)
            texts, spans = column.to_pylist(), [[] for _ in range(len(batch))]
            for i, flag in enumerate(pc.match_substring_regex(column, SUSPECT).to_pylist()):
                if flag and (found := names.find(texts[i])):
                    spans[i] = [{"kind": k, "start": a, "end": b} for a, b, k, _ in found]
                    texts[i] = names.rewrite(texts[i], found)
            columns = [*batch.columns[:place], pa.array(texts, arrow.field(place).type), *batch.columns[place + 1 :], pa.array(spans, arrow.field(out).type)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.mapInArrow(run, schema)


def op8_pseudonyms(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """doc_id, the whole pseudonymised text, the number of values by kind, and their spans."""
    found = pseudonymise(docs.select("doc_id", "text"), key)
    counts = [F.expr(f"CAST(size(filter(pii, x -> x.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}") for kind in SHAPES]
    spans = F.concat_ws(",", F.transform("pii", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    return found.select("doc_id", "text", F.size("pii").cast("long").alias("n_values"), *counts, spans.alias("spans"))
