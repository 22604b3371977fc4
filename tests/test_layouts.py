"""256-bit integers and generic types."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import quad
from ledgerloom.functions.borsh import At, Layout, filled
from ledgerloom.operators import query as q
from ledgerloom.operators.catalog import Program
from ledgerloom.sources.tables import FrameTables

EDGES = [0, 1, -1, 10**20 - 1, 10**20, -(10**20), 10**40, -(10**40), 10**60 + 7, -(10**60) - 7, 2**64, -(2**64), 2**128, -(2**128),
         2**192 - 1, 2**255 - 1, -(2**255), 2**256 - 1, 2**255]


def random_values(n=60):
    rnd = random.Random(9)
    return EDGES + [rnd.choice([1, -1]) * rnd.getrandbits(rnd.randint(1, 255)) for _ in range(n)]


def decoded(spark, kind, values):
    rows = spark.createDataFrame([(i, b"\xff" + v.to_bytes(32, "little", signed=kind == "i256")) for i, v in enumerate(values)], "i int, p binary")
    layout = Layout({})
    value = layout.column(kind, "p", At(plus=1))
    return rows.select("i", value.alias("v"), F.expr(layout.json_text(kind, "p", At(plus=1))).alias("json"))


@pytest.mark.parametrize("kind", ["u256", "i256"])
def test_256_bits(spark, kind):
    low, high = (0, 2**256 - 1) if kind == "u256" else (-(2**255), 2**255 - 1)
    values = [v for v in random_values() if low <= v <= high]
    rows = decoded(spark, kind, values)
    assert rows.schema["v"].dataType == quad.QUAD
    got = {r.i: (r.text, r.json) for r in rows.select("i", quad.text(F.col("v")).alias("text"), "json").collect()}
    assert got == {i: (str(v), f'"{v}"') for i, v in enumerate(values)}
    ordered = [values[r.i] for r in rows.orderBy("v").collect()]
    assert ordered == sorted(values)
    one = rows.agg(quad.limbs_text(quad.sums(F.col("v"))).alias("s"), quad.text(F.min("v")).alias("a"), quad.text(F.max("v")).alias("b")).first()
    assert (one.s, one.a, one.b) == (str(sum(values)), str(min(values)), str(max(values)))


def test_literals_and_limbs(spark):
    values = random_values()
    shown = spark.range(1).select(*(quad.text(quad.literal(v)).alias(f"c{i}") for i, v in enumerate(values))).first()
    assert list(shown) == [str(v) for v in values]
    for v in values:
        a, b, c, d = quad.split(v)
        assert ((a * quad.BASE + b) * quad.BASE + c) * quad.BASE + d == v and all(0 <= x < quad.BASE for x in (b, c, d))


IDL = {"address": "P", "instructions": [{"name": "pay", "args": [{"name": "big", "type": "i256"}]}], "types": []}


def tables(spark, values):
    program = Program.from_idl(IDL)
    rows = decoded(spark, "i256", values).select(
        F.col("i").cast("long").alias("slot"), F.concat(F.lit("tx"), "i").alias("tx_signature"),
        F.when(F.col("i") % 2 == 0, "even").otherwise("odd").alias("signer"), F.col("v").alias("big"))
    return FrameTables(spark, {"pay": rows}), program


def test_requests_on_256_bits(spark):
    values = [v for v in random_values() if -(2**255) <= v < 2**255]
    source, program = tables(spark, values)
    for operator, keep in (("gte", lambda v, b: v >= b), ("lte", lambda v, b: v <= b), ("eq", lambda v, b: v == b)):
        for bound in (0, 10**40, -(2**128), 2**254):
            name = "arg.big" if operator == "eq" else f"arg.big.{operator}"
            rows = q.as_text(q.list_instructions(source, program, "pay", {name: str(bound), "order": "asc", "limit": "200"})).collect()
            assert [r.big for r in rows] == [str(v) for v in values if keep(v, bound)]
    assert q.list_instructions(source, program, "pay", {"arg.big.gte": str(2**255)}).isEmpty()
    for metric, best in (("sum", sum), ("min", min), ("max", max)):
        assert q.aggregate(source, program, "pay", {"metric": metric, "field": "big"}).first().value == str(best(values))
    by = {r.signer: r.value for r in q.aggregate(source, program, "pay", {"metric": "sum", "field": "big", "group_by": "signer"}, numeric_order=True).collect()}
    assert by == {"even": str(sum(values[::2])), "odd": str(sum(values[1::2]))}


def test_averages_of_256_bits(spark):
    cases = {(2**255 - 1, -(2**255), 7): None, (10**60, 10**60 + 1): f"1{'0' * 59}1", (5, 6): "5.5000000000000000", (-7, -7, -6): "-6.6666666666666667", (0, 0): "0.0000000000000000", (-(10**50), 10**50 - 3): "-1.5000000000000000"}
    for values, want in cases.items():
        source, program = tables(spark, list(values))
        got = q.aggregate(source, program, "pay", {"metric": "avg", "field": "big"}).first().value
        assert want is None or float(got) == pytest.approx(float(want)) and got.split(".")[0] == want.split(".")[0]


# --- generic types ---------------------------------------------------------------------

TYPES = [
    {"name": "Box", "generics": [{"kind": "type", "name": "T"}], "type": {"kind": "struct", "fields": [{"name": "value", "type": {"generic": "T"}}]}},
    {"name": "Pair", "generics": [{"kind": "type", "name": "A"}, {"kind": "type", "name": "B"}, {"kind": "const", "name": "N", "type": "usize"}],
     "type": {"kind": "struct", "fields": [{"name": "a", "type": {"array": [{"generic": "A"}, {"generic": "N"}]}}, {"name": "b", "type": {"option": {"defined": {"name": "Box", "generics": [{"kind": "type", "type": {"generic": "B"}}]}}}}]}},
    {"name": "Same", "generics": [{"kind": "type", "name": "T"}], "type": {"kind": "type", "alias": {"vec": {"generic": "T"}}}},
    {"name": "Either", "generics": [{"kind": "type", "name": "L"}, {"kind": "type", "name": "R"}],
     "type": {"kind": "enum", "variants": [{"name": "Left", "fields": [{"generic": "L"}]}, {"name": "Right", "fields": [{"name": "r", "type": {"generic": "R"}}]}]}},
    {"name": "Chain", "type": {"kind": "struct", "fields": [{"name": "next", "type": {"option": {"defined": {"name": "Chain"}}}}]}},
    {"name": "Grow", "generics": [{"kind": "type", "name": "T"}], "type": {"kind": "struct", "fields": [{"name": "more", "type": {"vec": {"defined": {"name": "Grow", "generics": [{"kind": "type", "type": {"defined": {"name": "Box", "generics": [{"kind": "type", "type": {"generic": "T"}}]}}}]}}}}]}},
    {"name": "Open", "type": {"kind": "struct", "fields": [{"name": "x", "type": {"generic": "T"}}]}},
    {"name": "Long", "type": {"kind": "struct", "fields": [{"name": "x", "type": {"array": ["u8", {"generic": "N"}]}}]}},
]


def of(name, *arguments):
    given = [{"kind": "const", "value": str(a)} if isinstance(a, int) else {"kind": "type", "type": a} for a in arguments]
    return {"defined": {"name": name, "generics": given}}


def layout():
    return Layout(Program.from_idl({"address": "P", "instructions": [], "types": TYPES}).types)


def text_of(spark, kind, data):
    rows = spark.createDataFrame([(data,)], "p binary")
    found = rows.select(F.expr(layout().json_text(kind, "p", At())).alias("json"), F.expr(layout().advance(kind, "p", At())).alias("end")).first()
    assert found.end == len(data)
    return json.loads(found.json)


def test_generics(spark):
    u16, u64 = "u16", "u64"
    assert text_of(spark, of("Box", u64), struct.pack("<Q", 7)) == {"value": "7"}
    nested = of("Box", of("Box", of("Box", u16)))
    assert text_of(spark, nested, struct.pack("<H", 9)) == {"value": {"value": {"value": 9}}}
    pair = of("Pair", of("Box", "u8"), "string", 3)
    data = bytes([1, 2, 3, 1]) + struct.pack("<I", 2) + b"hi"
    assert text_of(spark, pair, data) == {"a": [{"value": 1}, {"value": 2}, {"value": 3}], "b": {"value": "hi"}}
    assert text_of(spark, of("Pair", u16, u64, 0), b"\0") == {"a": [], "b": None}
    assert text_of(spark, of("Same", of("Same", "u8")), struct.pack("<IIBBI", 2, 2, 5, 6, 0)) == [[5, 6], []]
    either = of("Either", u16, of("Pair", "u8", "u8", 1))
    assert text_of(spark, either, struct.pack("<BH", 0, 300)) == {"left": {"0": 300}}
    assert text_of(spark, either, bytes([1, 4, 1, 5])) == {"right": {"r": {"a": [4], "b": {"value": 5}}}}
    # instances do not mix
    both = layout()
    assert both.width(of("Box", "u8")) == 1 and both.width(of("Box", u64)) == 8 and both.width(of("Pair", u16, u64, 2)) is None


@pytest.mark.parametrize(("kind", "message"), [
    (of("Box"), "parameter 'T' of 'Box' is not filled"),
    (of("Pair", "u8", "u8"), "parameter 'N' of 'Pair' is not filled"),
    ({"defined": "Box"}, "parameter 'T' of 'Box' is not filled"),
    (of("Box", "u8", "u8"), "has 1 type parameters, not 2"),
    ({"generic": "T"}, "parameter 'T' is not filled"),
    ({"defined": {"name": "Open"}}, "parameter 'T' is not filled"),
    ({"defined": {"name": "Long"}}, "'N' is not filled"),
    ({"defined": {"name": "Chain"}}, "'Chain' contains itself"),
    (of("Grow", "u8"), "contains itself"),
    (of("Box", {"defined": {"name": "Nowhere"}}), "'Nowhere' has no definition"),
])
def test_what_cannot_be_filled_is_named(kind, message):
    with pytest.raises(ValueError, match=message):
        layout().json_text(kind, "p", At())
    with pytest.raises(ValueError, match=message):
        layout().advance(kind, "p", At())


def test_filling_leaves_names_alone():
    body = {"kind": "struct", "fields": [{"name": "generic", "type": "u8"}, {"name": "x", "type": {"vec": {"generic": "T"}}}]}
    assert filled(body, {"T": "u64"})["fields"] == [{"name": "generic", "type": "u8"}, {"name": "x", "type": {"vec": "u64"}}]
