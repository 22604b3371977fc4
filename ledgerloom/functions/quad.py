"""256-bit integers without a UDF.

A value v is kept as struct<a, b, c, d> with v = ((a * B + b) * B + c) * B + d, B = 10**20
and 0 <= b, c, d < B; only a carries a sign. Struct comparison is lexicographic, so
ordering, min, max and comparisons with a literal work on it unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import text as shown
from ledgerloom.functions import wide

BASE = 10**20
LIMBS = ("a", "b", "c", "d")  # the greatest first
DIGITS = 20
QUAD = T.StructType([T.StructField(name, T.DecimalType(DIGITS, 0)) for name in LIMBS])


def split(value: int) -> list[int]:
    """The limbs of a Python integer, the greatest first."""
    out = []
    for _ in LIMBS[1:]:
        value, rest = divmod(value, BASE)
        out.append(rest)
    return [value, *reversed(out)]


def literal(value: int) -> Column:
    """A Python integer as limbs; the split happens once, on the driver."""
    parts = (wide.dec(n).cast(f"decimal({DIGITS},0)").alias(name) for n, name in zip(split(value), LIMBS, strict=True))
    return F.struct(*parts)


def _decimal(column: Column) -> Column:
    return column.cast("decimal(38,0)")


def carried(limbs: list[Column]) -> list[Column]:
    """Limbs below the base (but for the greatest) from sums of limbs, which may be negative."""
    base, above, out = wide.dec(BASE), None, []
    for limb in reversed(limbs[1:]):
        total = _decimal(limb) if above is None else _decimal(_decimal(limb) + above)
        rest = _decimal(F.pmod(total, base))
        out.append(rest)
        above = _decimal((total - rest) / base)
    return [_decimal(_decimal(limbs[0]) + above), *reversed(out)]


def sums(value: Column) -> list[Column]:
    """Aggregate expressions: the limbs of the sum, null when nothing was summed."""
    return carried([F.sum(value[name]) for name in LIMBS])


def magnitude(limbs: list[Column]) -> tuple[Column, list[Column]]:
    """(is negative, limbs of |v|)."""
    negative = limbs[0] < 0
    turned = carried([-limb for limb in limbs])
    return negative, [F.when(negative, t).otherwise(n) for t, n in zip(turned, limbs, strict=True)]


def digits(limbs: list[Column]) -> Column:
    """Decimal digits of a value that is not negative."""
    text = F.concat(*(F.lpad(_decimal(limb).cast("string"), 38 if k == 0 else DIGITS, "0") for k, limb in enumerate(limbs)))
    return F.regexp_replace(text, "^0+(?=[0-9])", "")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value to a lambda variable; repeating its expression would multiply the plan's size."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bound_limbs(limbs: list[Column], body: Callable[[list[Column]], Column]) -> Column:
    held = F.struct(*(limb.alias(name) for limb, name in zip(limbs, LIMBS, strict=True)))
    return _bound(held, lambda v: body([v[name] for name in LIMBS]))


def _sized(limbs: list[Column], body: Callable[[Column, list[Column]], Column]) -> Column:
    """What body makes of the sign and the size of a value."""
    return _bound_limbs(limbs, lambda v: _bound_limbs(magnitude(v)[1], lambda size: body(v[0] < 0, size)))


def limbs_text(limbs: list[Column]) -> Column:
    return _sized(limbs, lambda negative, size: F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), digits(size)))


def text(value: Column) -> Column:
    """Decimal text of a limb struct (null for null)."""
    return F.when(value.isNotNull(), limbs_text([value[name] for name in LIMBS]))


def quotient_text(limbs: list[Column], count: Column) -> Column:
    """Text of v / count, as `text.quotient_text` shows it; exact for counts below 10**18."""

    def divided(negative: Column, size: list[Column], n: Column) -> Column:
        def step(whole: list[Column], rest: Column | None) -> Column:
            if len(whole) == len(size):
                return _bound_limbs(carried([*whole[:-1], whole[-1] + 1]), lambda more: shown.rounded_quotient(
                    negative, digits(size), n, digits(whole), digits(more), rest))
            limb = size[len(whole)]
            total = _decimal(limb) if rest is None else _decimal(_decimal(rest * wide.dec(BASE)) + limb)
            return _bound(total, lambda t: _bound(wide.int_div(t, n), lambda q: _bound(_decimal(t % n), lambda r: step([*whole, q], r))))

        return step([], None)

    return _sized(limbs, lambda negative, size: _bound(count.cast("decimal(18,0)"), lambda n: divided(negative, size, n)))
