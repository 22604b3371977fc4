"""Registered queries of 256-bit integers, generic types, byte arguments and interface versions."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.functions.base58 import bytes_to_base58
from ledgerloom.operators import instructions as ins
from ledgerloom.operators import query as q
from ledgerloom.operators.catalog import Program
from ledgerloom.plans.ingest import ingest, replay
from ledgerloom.plans.store import Store
from ledgerloom.session import shared_folder
from ledgerloom.sources.tables import FrameTables
from workload import inputs as inp
from workload.queries import EVENTS_SQL, register

SHIFT = 192  # values are (k + 1) * 2**SHIFT + slot: three 64-bit words above the slot
LIMB = 10**19


def _type(kind) -> dict:
    return {"kind": "type", "type": kind}


MEASURE_IDL = {
    "address": inp.PROGRAM,
    "instructions": [{"name": "measure", "args": [
        {"name": "big", "type": "u256"},
        {"name": "delta", "type": "i256"},
        {"name": "raw", "type": "bytes"},
        {"name": "pair", "type": {"defined": {"name": "Pair", "generics": [
            _type({"defined": {"name": "Box", "generics": [_type("u64")]}}), {"kind": "const", "value": "2"}]}}},
        {"name": "named", "type": {"defined": {"name": "Named", "generics": [_type("u256")]}}},
    ]}],
    "types": [
        {"name": "Box", "generics": [{"kind": "type", "name": "T"}],
         "type": {"kind": "struct", "fields": [{"name": "value", "type": {"option": {"generic": "T"}}}]}},
        {"name": "Pair", "generics": [{"kind": "type", "name": "T"}, {"kind": "const", "name": "N", "type": "usize"}],
         "type": {"kind": "struct", "fields": [
             {"name": "first", "type": {"generic": "T"}},
             {"name": "rest", "type": {"array": [{"generic": "T"}, {"generic": "N"}]}}]}},
        {"name": "Named", "generics": [{"kind": "type", "name": "V"}],
         "type": {"kind": "enum", "variants": [{"name": "None"}, {"name": "Some", "fields": [
             {"name": "label", "type": "string"}, {"name": "boxed", "type": {"defined": {"name": "Box", "generics": [_type({"generic": "V"})]}}}]}]}},
    ],
}


def measure_program() -> Program:
    return Program.from_idl(MEASURE_IDL)


def _words(number: Column) -> Column:
    """(k + 1) * 2**SHIFT + slot as 32 little-endian bytes."""
    return F.concat(inp.le(F.col("event_id"), 8), F.lit("0" * 32), inp.le(number + 1, 8))


def _payload() -> Column:
    """A negative delta is -(big + 1), whose bits are those of big turned over."""
    number = inp.k()
    big = _words(number)
    delta = F.when(number % 2 == 1, F.translate(big, "0123456789ABCDEF", "FEDCBA9876543210")).otherwise(big)
    box = lambda held, value: F.when(held, F.concat(F.lit("01"), inp.le(value, 8))).otherwise(F.lit("00"))
    pair = F.concat(box(number % 3 != 0, number), box(number % 2 == 0, F.col("event_id")), box(F.lit(True), F.col("user_id")))
    named = F.when(number % 4 == 0, F.lit("00")).otherwise(F.concat(F.lit("01"), inp.le_text(F.col("event_type")), F.lit("01"), big))
    disc = F.upper(text.discriminator(text.INSTRUCTION_SPACE, F.lit("measure")))
    return F.unhex(F.concat(disc, big, delta, inp.le_text(F.col("props")), pair, named))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one decoded instruction."""
    rows = inp.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("slot"), F.lit(0).cast("bigint").alias("tx_pos"), F.concat(F.lit("tx"), "event_id").alias("tx_signature"),
        F.col("user_id").cast("string").alias("signer"), F.lit(0).alias("ix_ordinal"), bytes_to_base58(_payload()).alias("data"))
    program = measure_program()
    return ins.decode_instructions(ins.match_instructions(rows, program), program, "measure")


def _tables(spark, sf_dir) -> FrameTables:
    return FrameTables(spark, {"measure": measured(spark, sf_dir)})


def _digits_sql(times: str, plus: str) -> str:
    """Digits of times * 2**SHIFT + plus, times > 0, from limbs of 19 digits."""
    parts = [(2**SHIFT // LIMB**i) % LIMB for i in range(4)]
    total, shown = f"({parts[0]}::HUGEINT * ({times}) + ({plus}))", []
    for part in parts[1:]:
        shown.insert(0, f"lpad(CAST(({total}) % {LIMB}::HUGEINT AS VARCHAR), 19, '0')")
        total = f"({part}::HUGEINT * ({times}) + ({total}) // {LIMB}::HUGEINT)"
    return "ltrim(concat(" + ", ".join([f"CAST({total} AS VARCHAR)", *shown]) + "), '0')"


_BIG_SQL = _digits_sql("k + 1", "slot")
_DELTA_SQL = f"CASE WHEN k % 2 = 1 THEN '-' || {_digits_sql('k + 1', 'slot + 1')} ELSE {_BIG_SQL} END"


@register(f"""{EVENTS_SQL} SELECT CAST(slot AS VARCHAR) AS slot, tx_signature, signer, {_BIG_SQL} AS big, {_DELTA_SQL} AS delta
FROM e WHERE k >= 50 ORDER BY e.slot LIMIT 200""")
def q_u256_list(spark, sf_dir):
    """The oldest rows whose value reaches a bound past 128 bits."""
    request = {"arg.big.gte": str(51 * 2**SHIFT), "order": "asc", "limit": "200"}
    rows = q.list_instructions(_tables(spark, sf_dir), measure_program(), "measure", request)
    return q.as_text(rows.select("slot", "tx_signature", "signer", "big", "delta"))


@register(f"""{EVENTS_SQL}, s AS (SELECT signer, sum(CASE WHEN k % 2 = 1 THEN -(k + 1) ELSE k + 1 END)::HUGEINT AS t,
  sum(CASE WHEN k % 2 = 1 THEN -(slot + 1) ELSE slot END)::HUGEINT AS p FROM e GROUP BY signer)
SELECT signer, CASE WHEN t = 0 THEN CAST(p AS VARCHAR) WHEN t < 0 THEN '-' || {_digits_sql('-t', '-p')} ELSE {_digits_sql('t', 'p')} END AS value FROM s""")
def q_i256_sum_by_signer(spark, sf_dir):
    """Signed 256-bit sums, with carries over all limbs and sums around zero."""
    return q.aggregate(_tables(spark, sf_dir), measure_program(), "measure", {"metric": "sum", "field": "delta", "group_by": "signer"})


def _bound(metric: str):
    def run(spark, sf_dir):
        return q.aggregate(_tables(spark, sf_dir), measure_program(), "measure", {"metric": metric, "field": "delta", "group_by": "signer"})

    return run


for _metric, _order in (("min", "t, p"), ("max", "t DESC, p DESC")):
    register(f"""{EVENTS_SQL}, s AS (SELECT *, CASE WHEN k % 2 = 1 THEN -(k + 1) ELSE k + 1 END AS t, CASE WHEN k % 2 = 1 THEN -(slot + 1) ELSE slot END AS p FROM e),
one AS (SELECT *, row_number() OVER (PARTITION BY signer ORDER BY {_order}) AS n FROM s)
SELECT signer, {_DELTA_SQL} AS value FROM one WHERE n = 1""", f"q_i256_{_metric}_by_signer")(_bound(_metric))


@register(f"""{EVENTS_SQL}, u AS (SELECT *, signer::BIGINT AS id FROM e)
SELECT slot, upper(hex(encode(props))) AS raw,
  '{{"first":{{"value":' || CASE WHEN k % 3 <> 0 THEN '"' || k || '"' ELSE 'null' END || '}},"rest":[{{"value":'
  || CASE WHEN k % 2 = 0 THEN '"' || slot || '"' ELSE 'null' END || '}},{{"value":"' || id || '"}}]}}' AS pair,
  CASE WHEN k % 4 = 0 THEN '{{"none":{{}}}}' ELSE '{{"some":{{"label":"' || instruction || '","boxed":{{"value":"' || {_BIG_SQL} || '"}}}}}}' END AS named
FROM u""")
def q_decode_generics(spark, sf_dir):
    """Nested type parameters, a constant length, a generic enum, and a bytes argument."""
    return measured(spark, sf_dir).select("slot", F.hex("raw").alias("raw"), "pair", "named")


# -- versions of an interface --------------------------------------------

OLD_ARGS = [{"name": "eventId", "type": "u32"}, {"name": "userId", "type": "u32"}, {"name": "delta", "type": "i32"}]
NEW_ARGS = [{"name": "eventId", "type": "u64"}, {"name": "userId", "type": "u32"}, {"name": "delta", "type": "i64"}, {"name": "label", "type": "string"}]


def _version(args: list, names: list[str]) -> dict:
    return {"address": inp.PROGRAM, "instructions": [{"name": n, "args": args} for n in names], "types": []}


def _versioned_store(spark: SparkSession, sf_dir: str) -> Store:
    """Two versions of an interface: older events are written by the first one, which has
    narrower types, no label and no signup; newer ones by the second."""
    events = inp.table(spark, sf_dir, "events")
    first = events.agg(F.max("event_id")).first()[0] // 2 + 1
    disc = F.upper(text.discriminator(text.INSTRUCTION_SPACE, F.col("event_type")))
    delta = inp.cents() - 5000
    old = F.concat(disc, inp.le(F.col("event_id"), 4), inp.le(F.col("user_id"), 4), inp.le(delta, 4))
    new = F.concat(disc, inp.le(F.col("event_id"), 8), inp.le(F.col("user_id"), 4), inp.le(delta, 8), inp.le_text(F.col("event_type")))
    payload = F.unhex(F.when(F.col("event_id") < first, old).otherwise(new))
    replies = inp.replies_of(events.withColumn("data", bytes_to_base58(payload)))
    versions = [_version(OLD_ARGS, [n for n in inp.EVENT_TYPES if n != "signup"]), _version(NEW_ARGS, inp.EVENT_TYPES)]
    store = Store(spark, shared_folder(spark, "versions"), Program.from_idl(versions[0]), slots_per_bucket=1000)
    store.open(json.dumps(versions[0]))
    # what is committed before the second version is known keeps its narrow files
    ingest(store, replies.where(F.col("slot") < first // 2), None, "early", on_error="quarantine")
    store.open(json.dumps(versions[1]), from_slot=first)
    ingest(store, replies.where(F.col("slot") >= first // 2), None, "late", on_error="quarantine")
    return store


_FIRST_SQL = "(SELECT max(event_id) // 2 + 1 FROM events)"


@register(f"""{EVENTS_SQL} SELECT instruction, slot, CAST(slot AS VARCHAR) AS event_id, CAST(signer AS BIGINT) AS user_id,
  cents - 5000 AS delta, CASE WHEN slot >= {_FIRST_SQL} THEN instruction END AS label
FROM e WHERE instruction <> 'signup' OR slot >= {_FIRST_SQL}""")
def q_store_versions(spark, sf_dir):
    """A slot range over two versions is one table, with the types of the wider one."""
    store = _versioned_store(spark, sf_dir)
    rows = [store.instruction(n).select(F.lit(n).alias("instruction"), "slot", F.col("event_id").cast("string").alias("event_id"), "user_id", "delta", "label")
            for n in store.program.instructions]
    return reduce(DataFrame.unionAll, rows)


@register(f"{EVENTS_SQL} SELECT slot, 'unknown_discriminator' AS reason FROM e WHERE instruction = 'signup' AND slot < {_FIRST_SQL}")
def q_store_versions_undecoded(spark, sf_dir):
    """What the version in force did not know stays open, with its payload."""
    return _versioned_store(spark, sf_dir).undecoded().where("payload IS NOT NULL").select("slot", "reason")


# -- rejects that are tried again ----------------------------------------


@register(f"{EVENTS_SQL} SELECT instruction, slot, tx_signature, CAST(slot AS VARCHAR) AS event_id, cents - 5000 AS delta, instruction AS label FROM e")
def q_replayed(spark, sf_dir):
    """An interface that knows two of five instructions, then one that knows all: every row once."""
    events = inp.in_order(inp.table(spark, sf_dir, "events"), "event_id")
    disc = F.upper(text.discriminator(text.INSTRUCTION_SPACE, F.col("event_type")))
    body = F.concat(disc, inp.le(F.col("event_id"), 8), inp.le(F.col("user_id"), 4), inp.le(inp.cents() - 5000, 8), inp.le_text(F.col("event_type")))
    replies = inp.replies_of(events.withColumn("data", bytes_to_base58(F.unhex(body))))
    less, all_ = _version(NEW_ARGS, inp.EVENT_TYPES[:2]), _version(NEW_ARGS, inp.EVENT_TYPES)
    root = shared_folder(spark, "replay")
    store = Store(spark, root, Program.from_idl(less), slots_per_bucket=1000)
    store.open(json.dumps(less))
    ingest(store, replies, None, "all", on_error="quarantine")
    store = Store(spark, root, Program.from_idl(all_))
    store.open(json.dumps(all_))
    replay(store, "again")
    rows = [store.instruction(n).select(F.lit(n).alias("instruction"), "slot", "tx_signature", F.col("event_id").cast("string").alias("event_id"), "delta", "label")
            for n in store.program.instructions]
    return reduce(DataFrame.unionAll, rows)
