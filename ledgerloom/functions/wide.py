"""128-bit integers as pairs of decimals.

Spark decimals end at 38 digits, so a 128-bit value v is kept as
struct<hi, lo> with v = hi * 10**19 + lo and 0 <= lo < 10**19. Struct comparison
is lexicographic, so ordering, min and max work on it unchanged. Only the split of
stored bytes is an Arrow UDF: with decimals it takes ten times as long.
"""

from __future__ import annotations

import sys
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The functions travel inside the task, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE = 10**19
BYTES = 16
WIDE = T.StructType(
    [T.StructField("hi", T.DecimalType(20, 0)), T.StructField("lo", T.DecimalType(19, 0))]
)


def dec(value: int) -> Column:
    """Exact decimal literal."""
    return F.lit(Decimal(value)).cast(f"decimal({max(1, len(str(abs(value))))},0)")


def limbs(hi: Column, lo: Column) -> Column:
    return F.struct(hi.try_cast("decimal(20,0)").alias("hi"), lo.try_cast("decimal(19,0)").alias("lo"))


def literal(value: int) -> Column:
    """A Python integer as limbs; the split happens once, on the driver."""
    return limbs(dec(value // BASE), dec(value % BASE))


def int_div(left: Column, right: Column) -> Column:
    """Whole quotient of two non-negative decimals whose result may exceed a bigint."""
    wide = left.cast("decimal(38,0)")
    return ((wide - wide % right) / right).cast("decimal(38,0)")


def carry(hi: Column, lo: Column) -> tuple[Column, Column]:
    """Bring an unbounded non-negative lo back below the base."""
    lo = lo.cast("decimal(38,0)")
    rest = lo % dec(BASE)
    return hi.cast("decimal(38,0)") + int_div(lo, dec(BASE)), rest.cast("decimal(19,0)")


def magnitude(hi: Column, lo: Column) -> tuple[Column, Column, Column]:
    """(is negative, |v| div base, |v| mod base)."""
    negative = hi < 0
    borrow = negative & (lo > 0)
    high = F.when(borrow, -hi - 1).when(negative, -hi).otherwise(hi)
    low = F.when(borrow, dec(BASE) - lo).otherwise(lo)
    return negative, high, low


def digits(high: Column, low: Column) -> Column:
    """Decimal digits of a non-negative pair."""
    low_text = low.cast("decimal(19,0)").cast("string")
    return F.when(high == 0, low_text).otherwise(
        F.concat(high.cast("string"), F.lpad(low_text, 19, "0"))
    )


def pair_text(hi: Column, lo: Column) -> Column:
    negative, high, low = magnitude(hi, lo)
    return F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), digits(high, low))


def text(value: Column) -> Column:
    """Decimal text of a limb struct (null for null)."""
    return F.when(value.isNotNull(), pair_text(value["hi"], value["lo"]))


def sums(value: Column) -> tuple[Column, Column]:
    """Aggregate expressions: the limbs of the sum, null when nothing was summed."""
    return carry(F.sum(value["hi"]), F.sum(value["lo"]))


def _split(data: pa.Array, signed: bool) -> pa.Array:
    """Limbs of little-endian values of 16 bytes; null for null or for fewer bytes.

    A negative v has the limbs of ~v = -v - 1, turned over: hi is ~hi, lo is BASE - 1 - lo.
    """
    valid = pc.fill_null(pc.equal(pc.binary_length(data), BYTES), False)
    fixed = pc.if_else(valid, data, pa.scalar(bytes(BYTES), data.type)).cast(pa.binary(BYTES))
    raw = np.frombuffer(fixed.buffers()[1] or b"", dtype="<u4")[4 * fixed.offset :][: 4 * len(fixed)]
    words = raw.reshape(-1, 4).T.astype(np.uint64)
    full = np.uint64(0xFFFFFFFF)
    turned = full * ((words[3] >> np.uint64(31)) if signed else np.zeros_like(words[3]))
    words ^= turned
    low, unit = np.zeros_like(turned), 1
    # Each step leaves less than 10**9, so with 32 more bits it stays below 2**62.
    for factor in (10**9, 10**9, 10):
        rest = np.zeros_like(turned)
        for word in words[::-1]:
            rest <<= np.uint64(32)
            rest |= word
            np.floor_divide(rest, np.uint64(factor), out=word)
            rest -= word * np.uint64(factor)
        low += rest * np.uint64(unit)
        unit *= factor
    low = np.where(turned > 0, np.uint64(BASE - 1) - low, low)
    high = np.ascontiguousarray((words ^ turned).T.astype("<u4"))
    least = np.ascontiguousarray(np.stack([low, np.zeros_like(low)], axis=1).astype("<u8"))
    kinds = pa.decimal128(20, 0), pa.decimal128(19, 0)
    parts = [pa.Array.from_buffers(kind, len(data), [None, pa.py_buffer(part)]) for kind, part in zip(kinds, (high, least))]
    return pa.StructArray.from_arrays(parts, names=["hi", "lo"], mask=pc.invert(valid))


@F.arrow_udf(WIDE)
def unsigned_limbs(data: pa.Array) -> pa.Array:
    """The limbs of unsigned 128-bit integers."""
    return _split(data, False)


@F.arrow_udf(WIDE)
def signed_limbs(data: pa.Array) -> pa.Array:
    """The limbs of signed 128-bit integers."""
    return _split(data, True)
