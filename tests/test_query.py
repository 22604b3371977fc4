import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import wide
from ledgerloom.operators import query as q
from ledgerloom.operators.catalog import Program
from ledgerloom.sources.tables import FrameTables
from tests import sample


@pytest.fixture(scope="module")
def program():
    return Program.from_idl(sample.IDL)


@pytest.fixture(scope="module")
def tables(spark, program):
    rows = [
        (15, "sig-1", "signer-1", 11, "hi", True, "{}"),
        (12, "sig-1", "signer-1", 4, "lo", True, "{}"),
        (90, "sig-2", "alice", 5, "hi", False, "{}"),
        (30, "sig-3", "bob", 2, "hi", True, "{}"),
    ]
    deposit = spark.createDataFrame(
        rows, "slot bigint, tx_signature string, signer string, amount bigint, memo string, flag boolean, metadata string"
    ).withColumn("amount", F.col("amount").cast("decimal(20,0)"))
    withdraw = spark.sql(
        "SELECT * FROM VALUES (100L, 'sig-9', 'alice', 18446744073709551615BD), (99L, 'sig-8', 'carol', 9BD),"
        " (98L, 'sig-7', 'dave', 10BD) AS t(slot, tx_signature, signer, amount)"
    ).withColumn("amount", F.col("amount").cast("decimal(20,0)"))
    return FrameTables(spark, {"deposit": deposit, "withdraw": withdraw})


def test_list_with_every_filter(tables, program):
    request = {
        "arg.amount": "11", "arg.amount.gte": "5", "arg.amount.lte": "19", "arg.flag": "true",
        "from_slot": "10", "limit": "5", "order": "asc", "signer": "signer-1", "to_slot": "20",
        "tx_signature": "sig-1",
    }
    rows = q.as_text(q.list_instructions(tables, program, "deposit", request)).collect()
    assert [(r.amount, r.flag, r.memo, r.slot) for r in rows] == [("11", True, "hi", "15")]


@pytest.mark.parametrize("name, request_, message", [
    ("deposit", {"limit": "0"}, "limit must be an integer between 1 and 200"),
    ("deposit", {"limit": "201"}, "limit must be an integer between 1 and 200"),
    ("deposit", {"limit": "1.5"}, "limit must be an integer between 1 and 200"),
    ("deposit", {"limit": "ten"}, "limit must be an integer between 1 and 200"),
    ("deposit", {"order": "sideways"}, "order must be 'asc' or 'desc'"),
    ("deposit", {"from_slot": "abc"}, "from_slot must be a valid integer"),
    ("deposit", {"to_slot": "1.5"}, "to_slot must be a valid integer"),
    ("deposit", {"arg.memo.gte": "x"}, "Only equality filters are supported for argument 'memo'"),
    ("deposit", {"arg.metadata": "{}"}, "Filtering is not supported for argument 'metadata'"),
    ("deposit", {"arg.flag": "wat"}, "Argument 'flag' expects a boolean value"),
    ("deposit", {"arg.amount": "abc"}, "Argument 'amount' expects a numeric value"),
    ("deposit", {"arg.amount": ""}, "Argument 'amount' expects a numeric value"),
    ("deposit", {"arg.missing": "1"}, "Unknown instruction argument 'missing'"),
    ("deposit", {"arg.": "1"}, "Invalid filter 'arg.'"),
    ("deposit", {"arg.amount.gte.x": "1"}, "Invalid filter 'arg.amount.gte.x'"),
    ("deposit", {"arg.amount.": "1"}, "Unsupported operator '' for filter 'arg.amount.'"),
    ("deposit", {"arg.amount.gt": "1"}, "Unsupported operator 'gt' for filter 'arg.amount.gt'"),
    ("missing", {}, "Unknown instruction 'missing'"),
])
def test_list_rejections(tables, program, name, request_, message):
    with pytest.raises(q.QueryError) as error:
        q.list_instructions(tables, program, name, request_)
    assert str(error.value) == message
    assert error.value.status == (404 if name == "missing" else 400)


@pytest.mark.parametrize("request_, message", [
    ({}, "metric must be one of count, sum, avg, min, max"),
    ({"metric": "median"}, "metric must be one of count, sum, avg, min, max"),
    ({"metric": "sum", "field": "memo"}, "Metric 'sum' requires a numeric argument"),
    ({"metric": "sum"}, "field is required for sum, avg, min, and max metrics"),
    ({"metric": "sum", "field": "nope"}, "Unknown instruction argument 'nope'"),
    ({"metric": "sum", "field": "amount", "group_by": "slot"}, "group_by must be 'signer'"),
])
def test_aggregate_rejections(tables, program, request_, message):
    with pytest.raises(q.QueryError, match=message):
        q.aggregate(tables, program, "deposit", request_)


def slots(tables, program, request):
    return [r.slot for r in q.list_instructions(tables, program, "deposit", request).collect()]


def test_order_and_limit_rules(tables, program):
    assert slots(tables, program, {}) == [90, 30, 15, 12]
    assert slots(tables, program, {"order": "ASC"}) == [12, 15, 30, 90]
    assert slots(tables, program, {"order": ""}) == [12, 15, 30, 90]
    assert slots(tables, program, {"limit": "1e0"}) == [90]
    assert slots(tables, program, {"limit": "", "from_slot": "", "signer": ""}) == [90, 30, 15, 12]
    assert slots(tables, program, {"from_slot": "-5", "to_slot": "15"}) == [15, 12]


def test_fractional_and_out_of_range_bounds(tables, program):
    assert slots(tables, program, {"arg.amount.gte": "4.5"}) == [90, 15]
    assert slots(tables, program, {"arg.amount.lte": "4.5"}) == [30, 12]
    assert slots(tables, program, {"arg.amount": "4.5"}) == []
    assert slots(tables, program, {"arg.amount": "4.0"}) == [12]
    assert slots(tables, program, {"arg.amount.lte": "1" + "0" * 40}) == [90, 30, 15, 12]
    assert slots(tables, program, {"arg.amount.gte": "-1" + "0" * 40, "to_slot": "9" * 30}) == [90, 30, 15, 12]


def value(tables, program, name, **request):
    return q.aggregate(tables, program, name, request).first().value


def test_global_metrics_are_exact_text(tables, program):
    assert value(tables, program, "deposit", metric="COUNT") == "4"
    assert value(tables, program, "withdraw", metric="sum", field="amount") == str(2**64 - 1 + 19)
    assert value(tables, program, "withdraw", metric="max", field="amount") == str(2**64 - 1)
    assert value(tables, program, "deposit", metric="avg", field="amount") == "5.5000000000000000"
    nothing = {"signer": "nobody"}
    assert value(tables, program, "deposit", metric="count", **nothing) == "0"
    assert value(tables, program, "deposit", metric="sum", field="amount", **nothing) == "0"
    assert value(tables, program, "deposit", metric="avg", field="amount", **nothing) is None
    assert value(tables, program, "deposit", metric="min", field="amount", **nothing) is None


def test_groups_are_ordered_by_text(tables, program):
    request = {"metric": "sum", "field": "amount", "group_by": "signer"}
    rows = q.aggregate(tables, program, "withdraw", request).collect()
    assert [(r.signer, r.value) for r in rows] == [("carol", "9"), ("alice", str(2**64 - 1)), ("dave", "10")]
    numeric = q.aggregate(tables, program, "withdraw", request, numeric_order=True).collect()
    assert [r.signer for r in numeric] == ["alice", "dave", "carol"]


def test_statistics(spark, tables, program):
    rows = {r.instruction: tuple(r)[1:] for r in q.instruction_stats(tables, program).collect()}
    assert rows == {"deposit": ("4", "3", "90"), "withdraw": ("3", "3", "100")}
    assert tuple(q.program_stats(tables, program).first()) == (sample.PROGRAM, "7", "5", "100")
    empty = FrameTables(spark, {n: f.limit(0) for n, f in tables.frames.items()})
    rows = {r.instruction: tuple(r)[1:] for r in q.instruction_stats(empty, program).collect()}
    assert rows == {"deposit": ("0", "0", None), "withdraw": ("0", "0", None)}
    assert tuple(q.program_stats(empty, program).first()) == (sample.PROGRAM, "0", "0", None)


def test_wide_values(spark):
    wide_program = Program.from_idl({"address": "p", "instructions": [
        {"name": "w", "args": [{"name": "n", "type": "i128"}]}], "types": []})
    values = [-(2**127), -1, 0, 10**19, 2**127 - 1]
    rows = spark.range(1).select(F.explode(F.array(*(wide.literal(v) for v in values))).alias("n")).select(
        F.lit(1).cast("bigint").alias("slot"), F.lit("t").alias("tx_signature"), F.lit("s").alias("signer"), "n")
    held = FrameTables(spark, {"w": rows})
    assert value(held, wide_program, "w", metric="sum", field="n") == str(sum(values))
    assert value(held, wide_program, "w", metric="min", field="n") == str(min(values))
    assert value(held, wide_program, "w", metric="count", **{"arg.n.gte": "0"}) == "3"
    assert value(held, wide_program, "w", metric="count", **{"arg.n": str(-(2**127))}) == "1"


def test_plans(spark, tmp_path, program):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    path = str(tmp_path / "rows")
    spark.range(1000).selectExpr(
        "id AS slot", "string(id) AS tx_signature", "string(id % 7) AS signer",
        "CAST(id AS DECIMAL(20,0)) AS amount", "'m' AS memo", "true AS flag", "'{}' AS metadata",
    ).write.parquet(path)
    stored = FrameTables(spark, {"deposit": spark.read.parquet(path)})
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    listed = plan(q.list_instructions(stored, program, "deposit", {
        "signer": "3", "from_slot": "10", "arg.amount.gte": "1.5"}))
    assert "TakeOrderedAndProject" in listed
    for pushed in ("EqualTo(signer,3)", "GreaterThanOrEqual(slot,10)", "GreaterThanOrEqual(amount,2)"):
        assert pushed in listed
    summed = plan(q.aggregate(stored, program, "deposit", {
        "metric": "sum", "field": "amount", "group_by": "signer"}))
    assert "ReadSchema: struct<signer:string,amount:decimal(20,0)>" in summed
    assert "partial_sum" in summed
