"""Codecs, number text and names against plain Python."""

import json
import os
import random
import struct
from decimal import ROUND_HALF_UP, Decimal, getcontext

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text, wide
from ledgerloom.functions.base58 import _decode, _encode
from ledgerloom.functions.borsh import At, Layout, key_text
from tests import sample

getcontext().prec = 80


def test_base58_both_ways():
    rng = random.Random(1)
    values = [bytes(rng.choice([0, 0, 1, 255, rng.randrange(256)]) for _ in range(rng.randrange(120)))
              for _ in range(2000)] + [b"", b"\0" * 40, None, b"\xff" * 1232]
    texts = [None if v is None else sample.base58(v) for v in values]
    encoded, decoded = _encode(pa.array(values, pa.binary())), _decode(pa.array(texts, pa.string()))
    encoded.validate(full=True)
    decoded.validate(full=True)
    assert encoded.to_pylist() == texts and decoded.to_pylist() == values
    assert _decode(pa.array(texts, pa.string()).slice(7, 50)).to_pylist() == values[7:57]
    assert _decode(pa.array(["0OIl", "11", None, "2g"])).to_pylist() == [None, b"\0\0", None, b"a"]


def test_key_text_without_udf(spark):
    keys = [os.urandom(32), b"\0" * 32, b"\0\0\1" + os.urandom(29), b"\xff" * 32]
    rows = spark.createDataFrame([(k,) for k in keys], "k binary").select(F.expr(key_text("k"))).collect()
    assert [r[0] for r in rows] == [sample.base58(k) for k in keys]


def decoded(spark, kind, payloads, types=None):
    layout = Layout(types or {})
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p binary")
    rows = frame.select("i", layout.column(kind, "p", At()).alias("v"),
                        F.expr(layout.advance(kind, "p", At())).alias("n")).orderBy("i").collect()
    return [r.v for r in rows], [r.n for r in rows]


INTEGERS = [("u8", 1, 0), ("i8", 1, 1), ("u16", 2, 0), ("i16", 2, 1), ("u32", 4, 0), ("i32", 4, 1),
            ("u64", 8, 0), ("i64", 8, 1), ("u128", 16, 0), ("i128", 16, 1)]


@pytest.mark.parametrize("kind, size, signed", INTEGERS)
def test_integers(spark, kind, size, signed):
    top = 1 << (8 * size - 1)
    values = [0, -1, 1, top - 1, -top] if signed else [0, 1, top, 2 * top - 1]
    if size == 16:
        values += [10**19, 10**19 - 1] + ([-(10**19), -(10**19) - 1] if signed else [])
    found, _ = decoded(spark, kind, [v.to_bytes(size, "little", signed=bool(signed)) for v in values])
    if size == 16:
        found = [int(v.hi) * 10**19 + int(v.lo) for v in found]
    assert [int(v) for v in found] == values


def test_floats(spark):
    values = [0.0, -0.0, 1.5, -2.25e300, 5e-324, 2.2250738585072014e-308, float("inf"), 1 / 3]
    found, _ = decoded(spark, "f64", [struct.pack("<d", v) for v in values])
    assert [struct.pack("<d", v) for v in found] == [struct.pack("<d", v) for v in values]
    raw = [struct.pack("<f", v) for v in (1.5, -0.1, 1e-45, 3.4e38)]
    found, _ = decoded(spark, "f32", raw)
    assert [struct.pack("<f", v) for v in found] == raw


TYPES = {
    "Meta": {"kind": "struct", "fields": [{"name": "level", "type": "u64"}, {"name": "tag", "type": "string"},
                                          {"name": "on", "type": "bool"}]},
    "Side": {"kind": "enum", "variants": [
        {"name": "Buy"}, {"name": "SellAll", "fields": [{"name": "px", "type": "u16"}, {"name": "who", "type": "pubkey"}]},
        {"name": "T", "fields": ["u8", "string"]}]},
    "Pair": {"kind": "struct", "fields": ["u64", "u8"]},
}
KEY = bytes(range(32))
COUNT = lambda n: struct.pack("<I", n)
NESTED = [
    ({"vec": {"defined": {"name": "Meta"}}},
     COUNT(2) + struct.pack("<Q", 9) + sample.text('a"b') + b"\1" + struct.pack("<Q", 2**63) + sample.text("") + b"\0",
     [{"level": "9", "tag": 'a"b', "on": True}, {"level": str(2**63), "tag": "", "on": False}]),
    ({"defined": "Side"}, b"\0", {"buy": {}}),
    ({"defined": "Side"}, b"\1" + struct.pack("<H", 700) + KEY, {"sellAll": {"px": 700, "who": sample.base58(KEY)}}),
    ({"defined": "Side"}, b"\2\7" + sample.text("é"), {"t": {"0": 7, "1": "é"}}),
    ({"array": ["u8", 4]}, b"\1\2\3\xff", [1, 2, 3, 255]),
    ({"vec": "bytes"}, COUNT(1) + COUNT(2) + b"\1\2", [[1, 2]]),
    ({"vec": "u64"}, COUNT(0), []),
    ({"vec": "pubkey"}, COUNT(1) + KEY, [sample.base58(KEY)]),
    ({"option": {"vec": "u16"}}, b"\0", None),
    ({"vec": {"option": "i128"}}, COUNT(2) + b"\0\1" + (-5).to_bytes(16, "little", signed=True), [None, "-5"]),
    ({"defined": "Pair"}, struct.pack("<Q", 1) + b"\2", {"0": "1", "1": 2}),
    ({"vec": "f64"}, COUNT(1) + struct.pack("<d", 2.5), [2.5]),
]


def test_nested_values_as_json(spark):
    layout = Layout(TYPES)
    columns, want = [], []
    for i, (kind, payload, value) in enumerate(NESTED):
        hexed = f"unhex('{payload.hex()}')"
        columns += [layout.column(kind, hexed, At()).alias(f"v{i}"),
                    F.expr(layout.advance(kind, hexed, At())).alias(f"n{i}")]
        want.append((value, len(payload)))
    row = spark.range(1).select(*columns).first()
    found = [(None if row[f"v{i}"] is None else json.loads(row[f"v{i}"]), row[f"n{i}"]) for i in range(len(NESTED))]
    assert found == want


def test_cut_and_malformed_payloads_have_no_end(spark):
    for kind, payload in [("bool", b"\2"), ({"option": "u8"}, b"\2\1"), ({"defined": "Side"}, b"\x09"),
                          ({"vec": "u64"}, COUNT(2**32 - 1))]:
        _, (end,) = decoded(spark, kind, [payload], TYPES)
        assert end is None
    _, (end,) = decoded(spark, "string", [COUNT(50) + b"abc"])
    assert end == 54


def test_wide_text(spark):
    values = [0, 1, -1, 10**19, 10**19 - 1, -(10**19), -(10**19) - 5, 2**128 - 1, -(2**127)]
    row = spark.range(1).select(*(wide.text(wide.literal(v)) for v in values)).first()
    assert list(row) == [str(v) for v in values]


def expected_average(total: int, count: int) -> str:
    group = lambda n: ((len(str(n)) - 1) // 4, int(str(n)[: len(str(n)) - 4 * ((len(str(n)) - 1) // 4)]))
    (tw, tf), (cw, cf) = group(abs(total)), group(count)
    scale = max(0, 16 - 4 * (tw - cw - (tf <= cf)))
    return f"{(Decimal(total) / count).quantize(Decimal(1).scaleb(-scale), ROUND_HALF_UP):f}"


def test_average_text(spark):
    rng = random.Random(2)
    cases = [(8, 4), (2, 4), (0, 3), (10, 3), (-10, 3), (2, 3), (30000, 1), (10**20 - 1, 7), (2**128 * 5, 3), (1, 10**15)]
    cases += [(rng.randrange(-10**rng.randrange(1, 30), 10**rng.randrange(1, 30)), rng.randrange(1, 10**rng.randrange(1, 9)))
              for _ in range(60)]
    rows = [(i, "-" if t < 0 else "", str(abs(t) // wide.BASE), str(abs(t) % wide.BASE), n) for i, (t, n) in enumerate(cases)]
    frame = spark.createDataFrame(rows, "i int, s string, h string, l string, n bigint")
    shown = text.quotient_text(F.col("s") == "-", F.col("h").cast("decimal(38,0)"), F.col("l").cast("decimal(19,0)"), F.col("n"))
    found = [r.t for r in frame.select("i", shown.alias("t")).orderBy("i").collect()]
    assert found == [expected_average(t, n) for t, n in cases]
    assert found[:3] == ["2.0000000000000000", "0.50000000000000000000", "0.00000000000000000000"]


def test_float_text(spark):
    cases = {5.0: "5", 496306.57: "496306.57", 1e15: "1e+15", 123456789012345.0: "123456789012345", 1e-5: "1e-05",
             0.0001: "0.0001", 1.5e300: "1.5e+300", 0.1: "0.1", 1e7: "10000000", -12.25: "-12.25"}
    frame = spark.createDataFrame([(v,) for v in cases], "v double")
    assert {r.v: r.t for r in frame.select("v", text.float_text(F.col("v")).alias("t")).collect()} == cases


def test_names(spark):
    cases = {"VaultAccount": "vault_account", "placeOrder": "place_order", "HTTPServer2x": "http_server2x",
             "u64Value": "u64_value", "already_snake": "already_snake", "it's": "its"}
    frame = spark.createDataFrame([(v,) for v in cases], "v string")
    assert {r.v: r.t for r in frame.select("v", text.snake_case(F.col("v")).alias("t")).collect()} == cases
    assert {v: text.snake_name(v) for v in cases} == cases
    assert [text.camel_name(n) for n in ("Buy", "SellAll", "USDC", "A")] == ["buy", "sellAll", "usdc", "a"]
    row = spark.range(1).select(text.discriminator("global:", F.lit("deposit")),
                                text.discriminator("account:", F.lit("VaultAccount"))).first()
    assert tuple(row) == ("f223c68952e1f2b6", "e6fbf1538bca5d1c")


@pytest.mark.parametrize("signed", [False, True])
def test_stored_128_bits_as_limbs(signed):
    rng = random.Random(3)
    low, high = (-(2**127), 2**127 - 1) if signed else (0, 2**128 - 1)
    near = [n * 10**e + d for n in (-17, -1, 0, 1, 17) for e in (0, 9, 18, 19) for d in (-1, 0, 1)]
    values = [v for v in [low, high, *near, *(rng.randrange(low, high) >> rng.randrange(120) for _ in range(500))] if low <= v <= high]
    stored = [None, b"", b"\1" * 15, *(v.to_bytes(16, "little", signed=signed) for v in values)]
    for data in (pa.array(stored, pa.binary()), pa.array([b"\2" * 16, *stored, None], pa.binary()).slice(1, len(stored))):
        found = wide._split(data, signed)
        found.validate(full=True)
        assert [None if v is None else int(v["hi"]) * 10**19 + int(v["lo"]) for v in found.to_pylist()] == [None] * 3 + values
        assert all(0 <= v["lo"] < 10**19 for v in found.to_pylist()[3:])
    assert wide._split(pa.array([], pa.binary()), signed).to_pylist() == []


def test_no_lambda_where_a_value_is_used_once():
    layout = Layout({"Detail": {"kind": "struct", "fields": [{"name": "marks", "type": {"vec": "u32"}}, {"name": "n", "type": "u8"}]}})
    assert "->" not in layout.advance({"vec": "u32"}, "p", At())
    assert "->" not in layout.advance({"defined": "Detail"}, "p", At("_end1"))
    assert layout.json_text({"vec": "u32"}, "p", At()).count("->") == 1
    # what an element needs is never worked out anew for each element of another list
    assert layout.json_text({"vec": {"vec": "u32"}}, "p", At()).count("aggregate(") == 1
    assert Layout({}).column("u128", "p", At())._jc.toString().startswith("unsigned_limbs(")
