"""Little-endian record layouts as Spark SQL expressions.

A layout is compiled from the interface types into SQL text over a binary
payload and an offset. Nothing here touches rows: decoding runs inside
whole-stage code generation, but for the Arrow UDFs of keys and 128-bit integers
in columns of their own, and prunes with the columns a query asks for. Text
keeps plan building cheap: one parse per field, however deep its type.

* ``advance``  - offset after a value, null when a tag byte is out of range
* ``scalar``   - a value with its own Spark type
* ``json_text``- a nested value as JSON text: 64- and 128-bit integers and keys
  are strings, small numbers are numbers, bytes are arrays of numbers
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import quad, wide
from ledgerloom.functions.base58 import ALPHABET, bytes_to_base58
from ledgerloom.functions.text import camel_name

# Byte width of each fixed-size primitive.
WIDTH = {
    "u8": 1, "i8": 1, "u16": 2, "i16": 2, "u32": 4, "i32": 4, "u64": 8, "i64": 8,
    "u128": 16, "i128": 16, "u256": 32, "i256": 32, "f32": 4, "f64": 8, "pubkey": 32,
}
# Values whose bytes an Arrow UDF converts, many rows at a time.
_WHOLE = {"pubkey": bytes_to_base58, "u128": wide.unsigned_limbs, "i128": wide.signed_limbs}
KEY_BYTES = 32
LENGTH_BYTES = 4
DEEPEST = 64  # instances of defined types inside each other


@dataclass(frozen=True)
class At:
    """An offset: a SQL expression plus a constant."""

    base: str | None = None
    plus: int = 0

    def __add__(self, count: int) -> At:
        return At(self.base, self.plus + count)

    def __str__(self) -> str:
        if self.base is None:
            return f"{self.plus}L"
        return f"({self.base} + {self.plus}L)" if self.plus else self.base


_names = itertools.count()


# Uses, and length of their text, up to which a value is repeated rather than bound.
REPEATED, REPEATED_TEXT = 2, 3000


def let(value: str, body) -> str:
    """Use an expression several times.

    A lambda variable keeps its cost from multiplying, but all of a lambda is interpreted. So
    a value that is used once, or a cheap one that is used twice, is put in place, where code
    is generated for it; never inside a lambda, which may run once per element.
    """
    name = f"v{next(_names)}"
    mark = f"\0{name}\0"
    text = body(mark)
    uses = text.count(mark)
    cheap = "->" not in value and uses * len(value) <= REPEATED_TEXT
    if "->" not in text[: text.rfind(mark) + 1] and (uses <= 1 or (uses <= REPEATED and cheap)):
        return text.replace(mark, f"({value})")
    return f"get(transform(array({value}), {name} -> {text.replace(mark, name)}), 0)"


def quote(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def defined_name(kind: dict) -> str:
    inner = kind["defined"]
    return inner if isinstance(inner, str) else inner["name"]


def type_arguments(kind: dict) -> list:
    """What a defined type is instantiated with: types, and values of constants."""
    inner = kind["defined"]
    given = [] if isinstance(inner, str) else inner.get("generics") or []
    return [(a["type"] if "type" in a else a["value"]) if isinstance(a, dict) and ("type" in a or "value" in a) else a for a in given]


def defined_types(kind) -> Iterator[dict]:
    """The defined types that a type or definition names, but for their arguments."""
    if isinstance(kind, list):
        for inner in kind:
            yield from defined_types(inner)
    elif isinstance(kind, dict):
        if "defined" in kind:
            yield kind
        else:
            for key, inner in kind.items():
                if key != "generics":
                    yield from defined_types(inner)


def filled(kind, names: dict[str, object]):
    """A type, or a length, with its type parameters replaced. An unfilled one is an error."""
    if isinstance(kind, list):
        return [filled(k, names) for k in kind]
    if not isinstance(kind, dict):
        return kind
    if "generic" in kind:
        if kind["generic"] not in names:
            raise ValueError(f"Type parameter '{kind['generic']}' is not filled")
        return names[kind["generic"]]
    if "defined" in kind and isinstance(kind["defined"], dict):
        inner = kind["defined"]
        given = [{"type": filled(a, names)} for a in type_arguments(kind)]
        return {"defined": {**inner, "generics": given}} if given else kind
    return {k: v if k in ("name", "kind", "docs", "generics") else filled(v, names) for k, v in kind.items()}


# -- primitives ----------------------------------------------------------


def _slice(p: str, at: At, size: int | str) -> str:
    start = str(at.plus + 1) if at.base is None else f"try_cast({at + 1} AS INT)"
    count = str(size) if isinstance(size, int) else f"try_cast({size} AS INT)"
    return f"substring({p}, {start}, {count})"


def _conv(p: str, at: At, size: int, base: int = 10) -> str:
    """Decimal text of up to eight bytes; base -10 reads eight of them as signed."""
    parts = ", ".join(_slice(p, at + i, 1) for i in reversed(range(size)))
    return f"conv(hex(concat({parts})), 16, {base})"


def _unsigned(p: str, at: At, size: int) -> str:
    return f"try_cast({_conv(p, at, size)} AS BIGINT)"


def _signed(p: str, at: At, size: int) -> str:
    if size == 8:
        return f"try_cast({_conv(p, at, 8, -10)} AS BIGINT)"
    # Widening the sign bit: x xor h, minus h.
    half = 1 << (8 * size - 1)
    return f"(({_unsigned(p, at, size)} ^ {half}L) - {half}L)"


def _float(p: str, at: At, size: int) -> str:
    """IEEE 754 from its bits by exact arithmetic."""
    fraction_bits, exponent_bits = (52, 11) if size == 8 else (23, 8)
    bias, top = (1 << (exponent_bits - 1)) - 1, (1 << exponent_bits) - 1

    def value(bits: str) -> str:
        fraction = f"({bits} & {(1 << fraction_bits) - 1}L)"
        exponent = f"(shiftrightunsigned({bits}, {fraction_bits}) & {top}L)"
        tiny = f"power(2D, {1 - bias - fraction_bits}D)"
        size_of = (
            f"CASE WHEN {exponent} = {top} THEN IF({fraction} = 0, double('Infinity'), double('NaN'))"
            f" WHEN {exponent} = 0 THEN double({fraction}) * {tiny}"
            f" ELSE (double({fraction}) * power(2D, -{fraction_bits}D) + 1D)"
            f" * power(2D, double({exponent} - {bias}L)) END"
        )
        negative = f"(shiftrightunsigned({bits}, {fraction_bits + exponent_bits}) & 1L) = 1"
        return let(size_of, lambda x: f"IF({negative}, -{x}, {x})")

    text = let(_signed(p, at, 8) if size == 8 else _unsigned(p, at, 4), value)
    return text if size == 8 else f"float({text})"


def _wide(p: str, at: At, signed: bool) -> str:
    """128 bits as base-10**19 limbs: v = a * 2**96 + b * 2**64 + c.

    The sums stay below 38 digits. A negative value is read as unsigned and moved
    down by 2**128, whose limbs are constants.
    """
    base = wide.BASE
    number = lambda n: f"CAST({n} AS DECIMAL(38,0))"

    def limbs(high: str, low: str) -> str:
        carry = f"CAST(({low} - {low} % {base}BD) / {base}BD AS DECIMAL(38,0))"
        return (f"named_struct('hi', try_cast({high} + {carry} AS DECIMAL(20,0)),"
                f" 'lo', try_cast({low} % {base}BD AS DECIMAL(19,0)))")

    def parts(s: str) -> str:
        a, b, c = f"{s}.a", f"{s}.b", f"{s}.c"
        low = number(f"{a} * {2**96 % base}BD + {b} * {2**64 % base}BD + {c}")
        high = number(f"{a} * {2**96 // base}BD + {b} * {2**64 // base}BD")
        if signed:
            down = -(2**128)
            low = f"({low} + IF({a} >= {2**31}BD, {down % base}BD, 0BD))"
            high = f"({high} + IF({a} >= {2**31}BD, {down // base}BD, 0BD))"
        return let(f"named_struct('h', {number(high)}, 'l', {number(low)})",
                   lambda t: limbs(f"{t}.h", f"{t}.l"))

    words = [f"try_cast({_conv(p, at + o, n)} AS DECIMAL(20,0))" for o, n in ((12, 4), (8, 4), (0, 8))]
    return let(f"named_struct('a', {words[0]}, 'b', {words[1]}, 'c', {words[2]})", parts)


def _quad(p: str, at: At, signed: bool) -> str:
    """256 bits as base-10**20 limbs, see `quad`.

    Each 32-bit word is multiplied with the limbs of its power of two, a constant; the
    sums stay below 38 digits and are carried from the least limb up. A negative value
    is read as unsigned and moved down by 2**256.
    """
    base = quad.BASE
    number = lambda n: f"CAST({n} AS DECIMAL(38,0))"
    names = [f"w{i}" for i in range(8)]
    words = ", ".join(f"'{name}', try_cast({_conv(p, at + 4 * i, 4)} AS DECIMAL(10,0))" for i, name in enumerate(names))
    powers = [quad.split(2 ** (32 * i)) for i in range(8)]
    down = quad.split(-(2**256))

    def summed(s: str) -> str:
        limbs = []
        for k, limb in enumerate(quad.LIMBS):
            terms = [number(f"{s}.{name} * {power[k]}BD") for name, power in zip(names, powers, strict=True) if power[k]]
            if signed:
                terms.append(f"IF({s}.w7 >= {2**31}BD, {number(f'{down[k]}BD')}, {number('0BD')})")
            total = terms[0]
            for term in terms[1:]:
                total = number(f"{total} + {term}")
            limbs.append(f"'{limb}', {total}")
        return let(f"named_struct({', '.join(limbs)})", carried)

    def carried(t: str) -> str:
        def step(limb: str, above: str, then) -> str:
            total = number(f"{t}.{limb} + {above}") if above else f"{t}.{limb}"
            pair = lambda x: f"named_struct('r', {number(f'pmod({x}, {base}BD)')}, 'x', {x})"
            return let(let(total, pair), lambda y: then(f"{y}.r", number(f"({y}.x - {y}.r) / {base}BD")))

        limb = lambda n: f"try_cast({n} AS DECIMAL({quad.DIGITS},0))"
        return step("d", "", lambda d, up_d: step("c", up_d, lambda c, up_c: step("b", up_c, lambda b, up_b: (
            f"named_struct('a', {limb(number(f'{t}.a + {up_b}'))}, 'b', {limb(b)}, 'c', {limb(c)}, 'd', {limb(d)})"))))

    return let(f"named_struct({words})", summed)


def _quad_text(value: str) -> str:
    """Decimal text of limbs, see `quad.text`."""
    base = quad.BASE

    def padded(limbs: list[str]) -> str:
        parts = ", ".join(f"lpad(string({n}), {quad.DIGITS}, '0')" for n in limbs)
        return f"regexp_replace(concat({parts}), '^0+(?=[0-9])', '')"

    def shown(v: str) -> str:
        # -v: every limb is taken from the base, or from the base less one past the first that isn't 0
        a, b, c, d = (f"{v}.{name}" for name in quad.LIMBS)
        turned = (
            f"CASE WHEN {d} > 0 THEN {padded([f'(-{a} - 1)', f'({base - 1}BD - {b})', f'({base - 1}BD - {c})', f'({base}BD - {d})'])}"
            f" WHEN {c} > 0 THEN {padded([f'(-{a} - 1)', f'({base - 1}BD - {b})', f'({base}BD - {c})', '0'])}"
            f" WHEN {b} > 0 THEN {padded([f'(-{a} - 1)', f'({base}BD - {b})', '0', '0'])}"
            f" ELSE {padded([f'(-{a})', '0', '0', '0'])} END"
        )
        return f"IF({a} < 0, concat('-', {turned}), {padded([a, b, c, d])})"

    return let(value, shown)


def _wide_text(value: str) -> str:
    """Decimal text of limbs, see `wide.pair_text`."""
    base = wide.BASE

    def shown(v: str) -> str:
        digits = lambda hi, lo: (
            f"IF({hi} = 0, string({lo}), concat(string({hi}), lpad(string({lo}), 19, '0')))")
        borrowed = digits(f"(-{v}.hi - 1)", f"({base}BD - {v}.lo)")
        return (f"CASE WHEN {v}.hi >= 0 THEN {digits(f'{v}.hi', f'{v}.lo')}"
                f" WHEN {v}.lo > 0 THEN concat('-', {borrowed})"
                f" ELSE concat('-', {digits(f'(-{v}.hi)', f'{v}.lo')}) END")

    return let(value, shown)


def key_text(data: str) -> str:
    """Base58 of 32 bytes with built-ins, for keys inside lambdas where no UDF may go.

    Eight 32-bit words are divided nine times by 58**5; each remainder gives five
    digits, and each leading zero byte gives one leading "1".
    """
    words = (f"transform(sequence(0, 7), i -> "
             f"try_cast(conv(hex(substring({data}, i * 4 + 1, 4)), 16, 10) AS BIGINT))")
    current = f"(acc.m * {1 << 32}L + w)"
    word = (f"named_struct('q', concat(acc.q, array({current} div {58**5}L)), 'm', {current} % {58**5}L)")
    divided = ("aggregate(s.w, named_struct('q', cast(array() AS array<bigint>), 'm', 0L), "
               f"(acc, w) -> {word})")
    step = let(divided, lambda d: f"named_struct('w', {d}.q, 'r', concat(array({d}.m), s.r))")
    rests = (f"aggregate(sequence(1, 9), named_struct('w', {words}, 'r', cast(array() AS array<bigint>)), "
             f"(s, n) -> {step}, s -> s.r)")
    powers = ", ".join(f"(r div {58**i}L) % 58" for i in (4, 3, 2, 1, 0))
    digits = f"flatten(transform({rests}, r -> array({powers})))"
    text = f"array_join(transform({digits}, d -> substring('{ALPHABET}', int(d) + 1, 1)), '')"
    zeros = f"length(regexp_extract(hex({data}), '^(00)*', 0)) div 2"
    first = ALPHABET[0]
    return f"concat(repeat('{first}', int({zeros})), regexp_replace({text}, '^{first}+', ''))"


# -- layouts -------------------------------------------------------------


def _json_number(x: str) -> str:
    """JSON text of a double: whole numbers without a point, exponents only outside 1e-6 to 1e21."""
    shown, size = f"string({x})", f"abs({x})"
    # decimals of different scale would meet in one narrower type, so each is text first
    fixed = f"IF({size} < 1, string(try_cast({shown} AS DECIMAL(38,30))), string(try_cast({shown} AS DECIMAL(38,16))))"
    power = f"int(split_part({shown}, 'E', 2))"
    mantissa = f"regexp_replace(split_part({shown}, 'E', 1), '[.]0$', '')"
    return (
        f"CASE WHEN isnan({x}) OR {size} = double('Infinity') THEN 'null' WHEN {x} = 0 THEN '0' "
        f"WHEN {size} >= 1e-6 AND {size} < 1e21 THEN regexp_replace({fixed}, '[.]?0+$', '') "
        f"ELSE concat({mantissa}, 'e', IF({power} < 0, '-', '+'), abs({power})) END"
    )


class Layout:
    """Compiler from interface types to SQL, given the named type definitions."""

    def __init__(self, types: dict[str, dict]):
        self.types = types
        self._instances: dict[tuple[str, str], dict] = {}

    # shape

    def _definition(self, kind: dict) -> dict:
        """Body of a defined type, with its type parameters filled."""
        if "generic" in kind:
            raise ValueError(f"Type parameter '{kind['generic']}' is not filled")
        if "defined" not in kind:
            raise ValueError(f"Type {kind} cannot be decoded")
        name = defined_name(kind)
        if name not in self.types:
            raise ValueError(f"Type '{name}' has no definition and cannot be decoded")
        return self._instance(name, json.dumps(type_arguments(kind)))

    def _instance(self, name: str, arguments: str, path: tuple = ()) -> dict:
        """A definition for given arguments. Types that contain themselves are refused, and so
        are those that contain ever larger instances of themselves."""
        key = (name, arguments)
        if key in path or len(path) > DEEPEST:
            raise ValueError(f"Type '{name}' contains itself and cannot be decoded")
        if key in self._instances:
            return self._instances[key]
        body, given = self.types[name], json.loads(arguments)
        wanted = [g["name"] for g in body.get("generics") or []]
        if len(given) < len(wanted):
            raise ValueError(f"Type parameter '{wanted[len(given)]}' of '{name}' is not filled")
        if len(given) > len(wanted):
            raise ValueError(f"Type '{name}' has {len(wanted)} type parameters, not {len(given)}")
        whole = filled(body, dict(zip(wanted, given, strict=True))) if wanted else body
        for inner in defined_types(whole):
            if defined_name(inner) in self.types:
                self._instance(defined_name(inner), json.dumps(type_arguments(inner)), (*path, key))
        self._instances[key] = whole
        return whole

    @staticmethod
    def _length(kind: dict) -> int:
        length = kind["array"][1]
        if isinstance(length, dict):
            raise ValueError(f"Length '{length.get('generic', length)}' is not filled")
        return int(length)

    @staticmethod
    def _members(fields) -> list[tuple[str, object]]:
        """Named fields, or tuple fields under their position."""
        return [
            (f["name"], f["type"]) if isinstance(f, dict) and "name" in f else (str(i), f)
            for i, f in enumerate(fields or [])
        ]

    def width(self, kind) -> int | None:
        """Byte width when it is fixed and every byte pattern is valid, else None."""
        if isinstance(kind, str):
            return WIDTH.get(kind)
        if "array" in kind:
            size = self.width(kind["array"][0])
            return None if size is None else size * self._length(kind)
        if "defined" in kind:
            body = self._definition(kind)
            if body["kind"] == "type":
                return self.width(body["alias"])
            if body["kind"] == "struct":
                sizes = [self.width(t) for _, t in self._members(body.get("fields"))]
                return None if None in sizes else sum(sizes)
        return None

    def smallest(self, kind) -> int:
        """Least number of bytes a value can take; bounds the length of a vector."""
        if isinstance(kind, str):
            return 1 if kind == "bool" else WIDTH.get(kind, LENGTH_BYTES)
        if "option" in kind:
            return 1
        if "coption" in kind or "vec" in kind:
            return LENGTH_BYTES
        if "array" in kind:
            return self.smallest(kind["array"][0]) * self._length(kind)
        body = self._definition(kind)
        if body["kind"] == "type":
            return self.smallest(body["alias"])
        if body["kind"] == "enum":
            return 1
        return sum(self.smallest(t) for _, t in self._members(body.get("fields")))

    def _count(self, inner, p: str, at: At) -> str:
        """Vector length, null when the payload cannot hold that many elements."""
        least = self.smallest(inner)
        if least == 0:
            raise ValueError("Vectors of empty values cannot be decoded")
        return let(_unsigned(p, at, LENGTH_BYTES), lambda n: f"IF({n} * {least} <= length({p}), {n}, NULL)")

    # offsets

    def advance(self, kind, p: str, at: At) -> str:
        fixed = self.width(kind)
        if fixed is not None:
            return str(at + fixed)
        if kind == "bool":
            return f"IF({_unsigned(p, at, 1)} <= 1, {at + 1}, NULL)"
        if kind in ("string", "bytes"):
            return f"({at + LENGTH_BYTES} + {_unsigned(p, at, LENGTH_BYTES)})"
        if isinstance(kind, str):
            raise ValueError(f"Type '{kind}' cannot be decoded")
        if "option" in kind:
            return (f"CASE {_unsigned(p, at, 1)} WHEN 0 THEN {at + 1}"
                    f" WHEN 1 THEN {self.advance(kind['option'], p, at + 1)} END")
        if "coption" in kind:
            return self.advance(kind["coption"], p, at + LENGTH_BYTES)
        if "vec" in kind:
            inner = kind["vec"]
            return let(self._count(inner, p, at),
                       lambda n: self._advance_many(inner, n, p, at + LENGTH_BYTES))
        if "array" in kind:
            return self._advance_many(kind["array"][0], f"{self._length(kind)}L", p, at)
        body = self._definition(kind)
        if body["kind"] == "type":
            return self.advance(body["alias"], p, at)
        if body["kind"] == "struct":
            return self._advance_members(self._members(body.get("fields")), p, at)
        cases = " ".join(
            f"WHEN {i} THEN {self._advance_members(self._members(v.get('fields')), p, at + 1)}"
            for i, v in enumerate(body["variants"])
        )
        return f"CASE {_unsigned(p, at, 1)} {cases} END"

    def _advance_many(self, inner, count: str, p: str, at: At) -> str:
        size = self.width(inner)
        if size is not None:
            return f"({at} + {count} * {size}L)"
        step, name = f"v{next(_names)}", f"v{next(_names)}"
        loop = (f"aggregate(sequence(1L, {count}), {at}, "
                f"({name}, {step}) -> {self.advance(inner, p, At(name))})")
        return f"CASE WHEN {count} = 0 THEN {at} WHEN {count} > 0 THEN {loop} END"

    def _advance_members(self, members, p: str, at: At) -> str:
        if not members:
            return str(at)
        (_, kind), rest = members[0], members[1:]
        size = self.width(kind)
        if size is not None:
            return self._advance_members(rest, p, at + size)
        here = self.advance(kind, p, at)
        return let(here, lambda n: self._advance_members(rest, p, At(n))) if rest else here

    # values

    def column(self, kind, p: str, at: At) -> Column:
        """The value a table column holds. Keys and 128-bit integers go through Arrow UDFs."""
        inner, held = kind, []
        while isinstance(inner, dict) and "option" in inner:
            held.append(f"{_unsigned(p, at, 1)} = 1")
            inner, at = inner["option"], at + 1
        if isinstance(inner, str) and inner in _WHOLE:
            raw = _slice(p, at, WIDTH[inner])
            return _WHOLE[inner](F.expr(f"IF({' AND '.join(held)}, {raw}, NULL)" if held else raw))
        value = self.scalar(inner, p, at)
        return F.expr(f"IF({' AND '.join(held)}, {value}, NULL)" if held else value)

    def scalar(self, kind, p: str, at: At) -> str:
        """A primitive with its own Spark type; anything else as JSON text."""
        if isinstance(kind, dict):
            return self.json_text(kind, p, at)
        if kind == "bool":
            return f"({_unsigned(p, at, 1)} = 1)"
        if kind in ("u8", "i8", "i16"):
            read = _unsigned if kind == "u8" else _signed
            return f"try_cast({read(p, at, WIDTH[kind])} AS SMALLINT)"
        if kind in ("u16", "i32"):
            read = _unsigned if kind == "u16" else _signed
            return f"try_cast({read(p, at, WIDTH[kind])} AS INT)"
        if kind == "u32":
            return _unsigned(p, at, 4)
        if kind == "i64":
            return _signed(p, at, 8)
        if kind == "u64":
            return f"try_cast({_conv(p, at, 8)} AS DECIMAL(20,0))"
        if kind in ("u128", "i128"):
            return _wide(p, at, kind == "i128")
        if kind in ("u256", "i256"):
            return _quad(p, at, kind == "i256")
        if kind in ("f32", "f64"):
            return _float(p, at, WIDTH[kind])
        if kind == "pubkey":
            return key_text(_slice(p, at, KEY_BYTES))
        data = _slice(p, at + LENGTH_BYTES, _unsigned(p, at, LENGTH_BYTES))
        if kind == "string":
            return f"make_valid_utf8(string({data}))"
        if kind == "bytes":
            return data
        raise ValueError(f"Type '{kind}' cannot be decoded")

    def json_text(self, kind, p: str, at: At) -> str:
        """JSON text of a value; every value yields text, absent options the word null."""
        if isinstance(kind, str):
            return self._json_primitive(kind, p, at)
        if "option" in kind or "coption" in kind:
            inner = kind.get("option", kind.get("coption"))
            size = 1 if "option" in kind else LENGTH_BYTES
            return f"IF({_unsigned(p, at, size)} = 1, {self.json_text(inner, p, at + size)}, 'null')"
        if "vec" in kind:
            return self._json_vector(kind["vec"], p, at)
        if "array" in kind:
            return self._json_many(kind["array"][0], f"{self._length(kind)}L", p, at)
        body = self._definition(kind)
        if body["kind"] == "type":
            return self.json_text(body["alias"], p, at)
        if body["kind"] == "struct":
            return self._json_members(self._members(body.get("fields")), p, at)
        cases = []
        for i, variant in enumerate(body["variants"]):
            key = quote('{"' + camel_name(variant["name"]) + '":')
            inner = self._json_members(self._members(variant.get("fields")), p, at + 1)
            cases.append(f"WHEN {i} THEN concat({key}, {inner}, '}}')")
        return f"CASE {_unsigned(p, at, 1)} {' '.join(cases)} END"

    def _json_primitive(self, kind: str, p: str, at: At) -> str:
        if kind == "bytes":
            return self._json_vector("u8", p, at)
        value = self.scalar(kind, p, at)
        if kind == "pubkey":
            return f"concat('\"', {value}, '\"')"
        if kind in ("u64", "i64"):
            return f"concat('\"', string({value}), '\"')"
        if kind in ("u128", "i128"):
            return f"concat('\"', {_wide_text(value)}, '\"')"
        if kind in ("u256", "i256"):
            return f"concat('\"', {_quad_text(value)}, '\"')"
        if kind == "string":
            return let(f"to_json(array({value}))", lambda t: f"substring({t}, 2, length({t}) - 2)")
        if kind in ("f32", "f64"):
            return let(f"double({value})", _json_number)
        return f"string({value})"

    def _json_vector(self, inner, p: str, at: At) -> str:
        return let(self._count(inner, p, at), lambda n: self._json_many(inner, n, p, at + LENGTH_BYTES))

    def _json_many(self, inner, count: str, p: str, at: At) -> str:
        size, step = self.width(inner), f"v{next(_names)}"
        if size is not None:
            # One use of the count, which is never negative; a null one gives null.
            here = At(f"({at} + {step} * {size}L)")
            places = f"array_repeat(0, int({count})), (_{step}, {step})"
            return f"concat('[', array_join(transform({places} -> {self.json_text(inner, p, here)}), ','), ']')"
        acc = f"v{next(_names)}"
        here = At(f"{acc}.at")
        texts = (
            f"aggregate(sequence(1L, {count}), "
            f"named_struct('at', {at}, 'texts', cast(array() AS array<string>)), "
            f"({acc}, {step}) -> named_struct('at', {self.advance(inner, p, here)}, "
            f"'texts', concat({acc}.texts, array({self.json_text(inner, p, here)}))), "
            f"{acc} -> {acc}.texts)"
        )
        return (f"CASE WHEN {count} = 0 THEN '[]'"
                f" WHEN {count} > 0 THEN concat('[', array_join({texts}, ','), ']') END")

    def _json_members(self, members, p: str, at: At) -> str:
        return f"concat('{{', {self._json_rest(members, p, at, '')}, '}}')"

    def _json_rest(self, members, p: str, at: At, comma: str) -> str:
        if not members:
            return "''"
        (name, kind), rest = members[0], members[1:]
        head = f"{quote(comma + chr(34) + name + chr(34) + ':')}, {self.json_text(kind, p, at)}"
        if not rest:
            return f"concat({head})"
        size = self.width(kind)
        if size is not None:
            return f"concat({head}, {self._json_rest(rest, p, at + size, ',')})"
        tail = let(self.advance(kind, p, at), lambda n: self._json_rest(rest, p, At(n), ","))
        return f"concat({head}, {tail})"
