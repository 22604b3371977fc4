"""Text forms of names and numbers.

Aggregates are returned as text in the form a PostgreSQL client sees, because
grouped results are ordered by that text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import wide

# The word pattern of the naming rule, the discriminator name
# spaces and width, and the display rules of numeric division and of floats.
WORD_PATTERN = r"[\da-z]+|[A-Z]+(?![a-z])|[A-Z][\da-z]+"
INSTRUCTION_SPACE = "global:"
ACCOUNT_SPACE = "account:"
DISCRIMINATOR_BYTES = 8
MIN_SIGNIFICANT_DIGITS = 16
DIGITS_PER_GROUP = 4
FIXED_BELOW = {"double": 1e15, "float": 1e6}
FIXED_FROM = 1e-4

_FRACTION_STEP = 12
_FRACTION_STEPS = 3


def snake_case(name: Column) -> Column:
    """Table and column form of an interface name."""
    words = F.regexp_extract_all(
        F.regexp_replace(name, "['’]", ""), F.lit(WORD_PATTERN), F.lit(0)
    )
    return F.lower(F.array_join(words, "_"))


def snake_name(name: str) -> str:
    """The same rule for one name while a plan is being built."""
    return "_".join(re.findall(WORD_PATTERN, re.sub("['’]", "", name))).lower()


def camel_name(name: str) -> str:
    """Lower camel case, the key of an enum variant in decoded objects."""
    head, *rest = re.findall(WORD_PATTERN, name) or [name]
    return head.lower() + "".join(word[:1].upper() + word[1:].lower() for word in rest)


def discriminator(space: str, name: Column) -> Column:
    """Hex of the leading bytes of sha256(space + name); the name as written."""
    digest = F.sha2(F.concat(F.lit(space), name), 256)
    return F.substring(digest, 1, 2 * DISCRIMINATOR_BYTES)


def float_text(value: Column, kind: str = "double") -> Column:
    """Shortest round-trip text, fixed notation inside the display range."""
    shown = value.cast("string")
    size = F.abs(value)
    fixed = F.regexp_replace(shown.try_cast("decimal(38,22)").cast("string"), r"\.?0+$", "")
    mantissa = F.regexp_replace(F.split_part(shown, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(shown, F.lit("E"), F.lit(2)).try_cast("int")
    scientific = F.concat(
        mantissa,
        F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")),
        F.abs(power).cast("string"),
    )
    return (
        F.when(F.isnan(value) | (size == float("inf")), shown)
        .when(value == 0, F.when(shown.startswith("-"), F.lit("-0")).otherwise(F.lit("0")))
        .when((size >= FIXED_FROM) & (size < FIXED_BELOW[kind]), fixed)
        .otherwise(scientific)
    )


def _leading_group(shown: Column) -> tuple[Column, Column]:
    """Weight and leading digit of a digit string read in groups of four."""
    weight = ((F.length(shown) - 1) / DIGITS_PER_GROUP).cast("int")
    first = F.substring(shown, F.lit(1), F.length(shown) - weight * DIGITS_PER_GROUP)
    return weight, first.cast("int")


def quotient_text(negative: Column, high: Column, low: Column, count: Column) -> Column:
    """Text of +-(high * 10**19 + low) / count, count >= 1, rounded half away from zero.

    At least sixteen significant digits are shown; the number of decimals follows
    from the leading groups of both operands. All steps are exact.
    """
    n = count.cast("decimal(19,0)")
    whole_hi = wide.int_div(high, n)
    rest = (high % n).cast("decimal(38,0)") * wide.dec(wide.BASE) + low
    rest = rest.cast("decimal(38,0)")
    whole_lo = wide.int_div(rest, n)
    one_more = wide.carry(whole_hi, whole_lo + 1)
    return rounded_quotient(
        negative, wide.digits(high, low), n, wide.digits(whole_hi, whole_lo), wide.digits(*one_more),
        (rest % n).cast("decimal(38,0)"),
    )


def rounded_quotient(
    negative: Column, shown: Column, n: Column, whole: Column, one_more: Column, rest: Column
) -> Column:
    """Text of a quotient from the digits of its dividend, its whole part and what is left over.

    `one_more` holds the digits of the whole part plus one, for decimals that round up to it.
    """
    weight, first = _leading_group(shown)
    n_weight, n_first = _leading_group(n.cast("string"))
    scale = F.greatest(
        F.lit(0),
        MIN_SIGNIFICANT_DIGITS
        - DIGITS_PER_GROUP * (weight - n_weight - F.when(first <= n_first, 1).otherwise(0)),
    )
    parts = []
    for _ in range(_FRACTION_STEPS):
        rest = (rest * wide.dec(10**_FRACTION_STEP)).cast("decimal(38,0)")
        parts.append(F.lpad(wide.int_div(rest, n).cast("string"), _FRACTION_STEP, "0"))
        rest = (rest % n).cast("decimal(38,0)")
    fraction = F.concat(*parts)
    kept = F.substring(fraction, F.lit(1), scale)
    next_digit = F.coalesce(F.substring(fraction, scale + 1, F.lit(1)).try_cast("int"), F.lit(0))
    up = next_digit >= 5
    kept_up = F.lpad(
        (F.coalesce(kept.try_cast("decimal(38,0)"), F.lit(0)) + 1).cast("string"), scale, "0"
    )
    # A carry out of the decimals shows as one more digit than the scale allows.
    grew = up & (
        F.length((F.coalesce(kept.try_cast("decimal(38,0)"), F.lit(0)) + 1).cast("string")) > scale
    )
    decimals = (
        F.when(grew, F.repeat(F.lit("0"), scale)).when(up, kept_up).otherwise(kept)
    )
    sign = F.when(negative & ((whole != "0") | (fraction != "0" * 36)), "-")
    return F.concat(
        F.coalesce(sign, F.lit("")),
        F.when(grew, one_more).otherwise(whole),
        F.when(scale > 0, F.concat(F.lit("."), decimals)).otherwise(F.lit("")),
    )
