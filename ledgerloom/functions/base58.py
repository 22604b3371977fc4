"""Base58 text <-> bytes as Arrow UDFs.

Base58 is positional arithmetic over the whole string, so no substring of the
text gives a substring of the bytes and no Spark built-in expresses it. Both
directions work on one Arrow batch at a time: rows are grouped by padded length
and every step of the base conversion is one numpy operation over all rows of
the group, so the cost per row does not depend on Python.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The functions travel inside the task, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The base58 alphabet.
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

# Five base58 digits fit a 30-bit factor, so a 32-bit limb times it plus a carry
# stays below 2**63.
_STEP = 5
_FACTOR = np.uint64(58**_STEP)
_MASK = np.uint64(0xFFFFFFFF)
_WORD = np.uint64(32)

_DIGIT = np.full(256, 255, dtype=np.uint8)
_DIGIT[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.arange(58, dtype=np.uint8)
_LETTER = np.frombuffer(ALPHABET.encode(), dtype=np.uint8)

# Widths up to which a base conversion is one product with a matrix; wider ones go limb by limb.
_DENSE = 1024
_MATRICES: dict[tuple[int, int], np.ndarray] = {}

# Rows converted at once. The steps hold several 64-bit numbers for each byte of a row, so
# a whole Arrow batch at once would take many times its own size.
_ROWS = 4000


def _flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string/binary array, one value after the other, and their lengths (null: 0)."""
    array = pc.fill_null(array.cast(pa.large_binary()), b"")
    _, offsets, data = array.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], np.diff(bounds)


def _tail(width: int, lengths: np.ndarray) -> np.ndarray:
    """Which places of right-aligned rows belong to the values."""
    return np.arange(width, dtype=np.int32) >= (width - lengths).astype(np.int32)[:, None]


def _right_aligned(values: pa.Array, width: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """One row per value, right aligned to `width`, `fill` on the left; and which places are the value's."""
    raw, lengths = _flat(values)
    inside = _tail(width, lengths)
    rows = np.full(inside.shape, fill, dtype=np.uint8)
    rows[inside] = raw
    return rows, inside


def _leading(rows: np.ndarray, inside: np.ndarray, lengths: np.ndarray, symbol: int) -> np.ndarray:
    """How many leading bytes of each value (not of its padding) equal `symbol`."""
    width = rows.shape[1]
    other = (rows != symbol) & inside
    first = np.where(other.any(axis=1), other.argmax(axis=1), width)
    return first - (width - lengths)


def _assemble(pieces, count, valid, kind) -> pa.Array:
    """Rebuild one Arrow array from (row numbers, right-aligned rows, lengths) groups."""
    parts, place, begin = [pa.nulls(1, pa.binary())], np.zeros(count, dtype=np.int64), 1
    for index, rows, lengths in pieces:
        bounds = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        data = rows[_tail(rows.shape[1], lengths)]
        parts.append(pa.Array.from_buffers(pa.binary(), len(index), [None, pa.py_buffer(bounds), pa.py_buffer(data)]))
        place[index] = np.arange(begin, begin + len(index))
        begin += len(index)
    place[~valid] = 0  # the null that comes first
    return pa.concat_arrays(parts).take(pa.array(place)).cast(kind)


def _lengths(array: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _groups(lengths: np.ndarray, valid: np.ndarray):
    """Row numbers per padded length; padding to 16 keeps the groups few and large."""
    padded = np.maximum(16, -(-lengths // 16) * 16)
    for width in np.unique(padded[valid]):
        yield int(width), np.flatnonzero(valid & (padded == width))


def _powers(base: int, width: int, radix: int, count: int) -> np.ndarray:
    """Powers of `base`, the highest first, each as `count` digits of a radix, the lowest first.

    A base conversion is the product of a value's digits with this matrix, and one run of
    carries over the sums. Digits of at most 8 bits, radix digits of at most 32 and _DENSE
    of them make sums below 2**53, so doubles hold them exactly.
    """
    key = base, width
    if key not in _MATRICES:
        if len(_MATRICES) >= 16:
            _MATRICES.clear()
        matrix = np.zeros((width, count))
        power = 1
        for place in range(width - 1, -1, -1):
            rest, digit = power, 0
            while rest:
                rest, matrix[place, digit] = divmod(rest, radix)
                digit += 1
            power *= base
        _MATRICES[key] = matrix
    return _MATRICES[key]


def _sums(digits: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Sums of the products, as whole numbers, one column per value."""
    return (powers.T @ digits.T.astype(np.float64)).astype(np.uint64)


def _limbs_of(digits: np.ndarray) -> np.ndarray:
    """32-bit limbs, the lowest first, of rows of base58 digits."""
    width = digits.shape[1]
    count = int(np.ceil(width * np.log2(58) / 32))
    if width <= _DENSE:
        limbs = _sums(digits, _powers(58, width, 1 << 32, count))
        carry = np.zeros(len(digits), dtype=np.uint64)
        for limb in limbs:
            limb += carry
            np.right_shift(limb, _WORD, out=carry)
            limb &= _MASK
        return limbs
    digits = np.ascontiguousarray(digits.T)
    limbs = np.zeros((count, digits.shape[1]), dtype=np.uint64)
    head = width % _STEP
    bounds = [0] * (head > 0) + list(range(head, width, _STEP))
    for begin, end in zip(bounds, bounds[1:] + [width]):
        carry = digits[begin].astype(np.uint64)
        for position in range(begin + 1, end):
            carry = carry * np.uint64(58) + digits[position]
        used = min(len(limbs), int(np.ceil(end * np.log2(58) / 32)))
        for limb in range(used):
            product = limbs[limb] * _FACTOR + carry
            limbs[limb] = product & _MASK
            carry = product >> _WORD
    return limbs


def _decode(array: pa.Array) -> pa.Array:
    valid = array.is_valid().to_numpy(zero_copy_only=False).copy()
    lengths = _lengths(array)
    pieces = []
    for width, index in _groups(lengths, valid):
        size = lengths[index]
        text, inside = _right_aligned(array.take(pa.array(index)), width, ord(ALPHABET[0]))
        digits = _DIGIT[text]
        bad = (digits == 255).any(axis=1)
        valid[index[bad]] = False
        zeros = _leading(text, inside, size, ord(ALPHABET[0]))
        digits[bad] = 0
        limbs = _limbs_of(digits)
        number = np.ascontiguousarray(limbs[::-1].T.astype(">u4")).view(np.uint8)
        pad = max(0, width - number.shape[1])
        rows = np.pad(number.reshape(len(index), -1), ((0, 0), (pad, 0)))
        total = rows.shape[1]
        nonzero = rows != 0
        significant = np.where(nonzero.any(axis=1), total - nonzero.argmax(axis=1), 0)
        pieces.append((index, rows, np.where(bad, 0, zeros + significant)))
    return _assemble(pieces, len(array), valid, pa.binary())


def _fives_of(value: np.ndarray) -> np.ndarray:
    """Groups of five base58 digits, the lowest first, of rows of bytes."""
    width = value.shape[1]
    count = int(np.ceil(width * 8 / np.log2(58) / _STEP))
    if width <= _DENSE:
        fives = _sums(value, _powers(256, width, 58**_STEP, count))
        carry = np.zeros(len(value), dtype=np.uint64)
        for five in fives:
            five += carry
            np.floor_divide(five, _FACTOR, out=carry)
            five -= carry * _FACTOR
        return fives
    limbs = np.ascontiguousarray(np.ascontiguousarray(value).view(">u4").reshape(len(value), -1).T, dtype=np.uint64)
    fives = np.zeros((count, len(value)), dtype=np.uint64)
    for part in range(count):
        rest = np.zeros(len(value), dtype=np.uint64)
        # Each division takes off more than 29 bits, so the leading limbs are zero by now.
        # A remainder from the quotient is cheaper than one by division.
        for limb in range(int(part * _STEP * np.log2(58) / 32), len(limbs)):
            rest <<= _WORD
            rest |= limbs[limb]
            np.floor_divide(rest, _FACTOR, out=limbs[limb])
            rest -= limbs[limb] * _FACTOR
        fives[part] = rest
    return fives


def _encode(array: pa.Array) -> pa.Array:
    valid = array.is_valid().to_numpy(zero_copy_only=False)
    lengths = _lengths(array)
    pieces = []
    for width, index in _groups(lengths, valid):
        size = lengths[index]
        value, inside = _right_aligned(array.take(pa.array(index)), width, 0)
        zeros = _leading(value, inside, size, 0)
        rest = _fives_of(value)[::-1].astype(np.uint32)
        digits = np.empty((len(rest), _STEP, len(index)), dtype=np.uint8)
        for position in range(_STEP - 1, -1, -1):
            quotient = rest // np.uint32(58)
            digits[:, position] = rest - quotient * np.uint32(58)
            rest = quotient
        digits = np.ascontiguousarray(digits.reshape(-1, len(index)).T)
        total = digits.shape[1]
        nonzero = digits != 0
        significant = np.where(nonzero.any(axis=1), total - nonzero.argmax(axis=1), 0)
        pieces.append((index, _LETTER[digits], zeros + significant))
    return _assemble(pieces, len(array), valid, pa.string())


def _by_parts(convert, array: pa.Array) -> pa.Array:
    """A conversion, some rows at a time."""
    if len(array) <= _ROWS:
        return convert(array)
    return pa.concat_arrays([convert(array.slice(begin, _ROWS)) for begin in range(0, len(array), _ROWS)])


@F.arrow_udf(T.BinaryType())
def base58_to_bytes(text: pa.Array) -> pa.Array:
    """Decoded bytes; null for null or for text outside the alphabet."""
    return _by_parts(_decode, text)


@F.arrow_udf(T.StringType())
def bytes_to_base58(data: pa.Array) -> pa.Array:
    """Base58 text of a binary column."""
    return _by_parts(_encode, data)
