"""The driver's tables in the shape of landed replies.

Every input is a narrow Spark expression over whole tables, so it grows with
them: events are instruction rows, payloads and notifications; line items are
raw transactions; orders are the signature feed; customers and suppliers are
account states and interfaces.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text, wide
from ledgerloom.functions.base58 import bytes_to_base58
from ledgerloom.operators.catalog import Program
from ledgerloom.sources.tables import FrameTables

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
PROGRAM = "LedgerProgram"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The same rows over all cores. A table may be a few large row groups, and each of them
    would be encoded by one task. Without a number Spark puts what is small in bytes together again."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def in_order(rows: DataFrame, key: str) -> DataFrame:
    """The same rows over all cores, neighbours together: files landed from them hold few slots
    each, as those of a landing job do, and a range of slots is found without reading the rest."""
    return rows.repartitionByRange(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


# -- events as instruction tables ---------------------------------------

EVENT_ARGS = [
    {"name": "value", "type": "f64"},
    {"name": "cents", "type": "i64"},
    {"name": "k", "type": "u64"},
    {"name": "bigAmount", "type": "u128"},
    {"name": "isEven", "type": "bool"},
    {"name": "label", "type": "string"},
    {"name": "props", "type": {"vec": "u8"}},
]
EVENT_IDL = {
    "address": PROGRAM,
    "instructions": [{"name": n, "args": EVENT_ARGS} for n in [*EVENT_TYPES, "refund"]],
    "types": [],
}


def event_program() -> Program:
    return Program.from_idl(EVENT_IDL)


def cents() -> Column:
    return F.round(F.col("value") * 100).cast("bigint")


def k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction rows of all types, told apart by `instruction`.

    bigAmount is (k + 1) * 10**30 + event_id, past what 64 bits hold.
    """
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("instruction"),
        F.col("event_id").alias("slot"),
        F.concat(F.lit("tx"), F.col("event_id")).alias("tx_signature"),
        F.col("user_id").cast("string").alias("signer"),
        F.col("ts").alias("created_at"),
        "value",
        cents().alias("cents"),
        k().cast("decimal(20,0)").alias("k"),
        wide.limbs((k() + 1) * F.lit(10**11), F.col("event_id").cast("decimal(19,0)")).alias("big_amount"),
        (k() % 2 == 0).alias("is_even"),
        F.concat(F.col("event_type"), F.lit("-"), k()).alias("label"),
        "props",
    )


def event_tables(spark: SparkSession, sf_dir: str) -> FrameTables:
    rows = event_rows(spark, sf_dir)
    frames = {n: rows.where(F.col("instruction") == n).drop("instruction")
              for n in [*EVENT_TYPES, "refund"]}
    return FrameTables(spark, frames, combined=rows)


# -- encoding, the inverse of what is under test -------------------------


def le(value: Column, size: int) -> Column:
    """Little-endian bytes of a bigint as hex text."""
    number = value.cast("bigint")
    byte = lambda i: F.shiftright(number, 8 * i).bitwiseAND(F.lit(255).cast("bigint"))
    turned = reduce(Column.bitwiseOR, [F.shiftleft(byte(i), 8 * (size - 1 - i)) for i in range(size)])
    return F.lpad(F.hex(turned), 2 * size, "0")


def le_text(value: Column) -> Column:
    return F.concat(le(F.octet_length(value), 4), F.hex(F.encode(value, "UTF-8")))


LEDGER_IDL = {
    "address": PROGRAM,
    "instructions": [
        {"name": n, "args": [
            {"name": "eventId", "type": "u64"},
            {"name": "userId", "type": "u32"},
            {"name": "delta", "type": "i64"},
            {"name": "label", "type": "string"},
            {"name": "amount", "type": "u128"},
            {"name": "note", "type": {"option": "string"}},
            {"name": "isEven", "type": "bool"},
            {"name": "owner", "type": "pubkey"},
            {"name": "detail", "type": {"defined": {"name": "Detail"}}},
            {"name": "side", "type": {"defined": {"name": "Side"}}},
        ]} for n in EVENT_TYPES
    ],
    "accounts": [{"name": "Customer"}],
    "types": [
        {"name": "Detail", "type": {"kind": "struct", "fields": [
            {"name": "k", "type": "u16"},
            {"name": "marks", "type": {"vec": "u32"}},
            {"name": "total", "type": "u64"},
        ]}},
        {"name": "Side", "type": {"kind": "enum", "variants": [{"name": "Buy"}, {"name": "Sell"}]}},
        {"name": "Customer", "type": {"kind": "struct", "fields": [
            {"name": "custKey", "type": "u64"},
            {"name": "fullName", "type": "string"},
            {"name": "nation", "type": "u8"},
            {"name": "balance", "type": "i64"},
            {"name": "segment", "type": {"option": "string"}},
        ]}},
    ],
}


def ledger_program() -> Program:
    return Program.from_idl(LEDGER_IDL)


def with_event_payload(events: DataFrame) -> DataFrame:
    """Events with `payload`, their record. k = 0 carries an unknown discriminator; k = 1 is cut
    short. What the record uses several times is a column first."""
    number, label = F.col("_k"), F.col("_label")
    disc = F.when(number == 0, F.lit("DEADBEEFDEADBEEF")).otherwise(
        F.upper(text.discriminator(text.INSTRUCTION_SPACE, F.col("event_type")))
    )
    note = F.when(number % 3 == 0, F.lit("00")).otherwise(F.concat(F.lit("01"), le_text(F.col("props"))))
    marks = F.concat(le(F.lit(2), 4), le(number, 4), le(F.col("user_id"), 4))
    body = F.concat(
        disc,
        le(F.col("event_id"), 8),
        le(F.col("user_id"), 4),
        le(F.col("_delta"), 8),
        le_text(label),
        le(F.col("event_id"), 8), le(number + 1, 8),
        note,
        F.when(number % 2 == 0, F.lit("01")).otherwise(F.lit("00")),
        F.sha2(F.col("user_id").cast("string"), 256),
        le(number, 2), marks, le(F.col("event_id"), 8),
        F.when(number % 2 == 0, F.lit("00")).otherwise(F.lit("01")),
    )
    whole = (
        events.withColumns({"_k": k(), "_delta": cents() - 5000})
        .withColumn("_label", F.concat(F.col("event_type"), F.lit("-"), number)).withColumn("_body", body)
    )
    cut = F.when(number == 1, F.substring("_body", 1, 60)).otherwise(F.col("_body"))
    return whole.withColumn("payload", F.unhex(cut)).drop("_k", "_delta", "_label", "_body")


def _instruction(index: Column | int, accounts: list, data: Column) -> Column:
    number = index if isinstance(index, Column) else F.lit(index)
    return F.struct(
        number.cast("int").alias("programIdIndex"),
        F.array(*(F.lit(a) if isinstance(a, int) else a for a in accounts)).cast("array<int>").alias("accounts"),
        data.cast("string").alias("data"),
    )


def _reply(signature, feed_pos, slot, keys, header, top, writable, readonly, inner, err=None) -> list[Column]:
    required, ro_signed, ro_unsigned = header
    return [
        signature.alias("signature"), feed_pos.cast("bigint").alias("feed_pos"), slot.cast("bigint").alias("slot"),
        F.struct(F.struct(
            F.array(*keys).alias("accountKeys"),
            F.struct(required.cast("int").alias("numRequiredSignatures"),
                     ro_signed.cast("int").alias("numReadonlySignedAccounts"),
                     ro_unsigned.cast("int").alias("numReadonlyUnsignedAccounts")).alias("header"),
            F.array(*top).alias("instructions"),
        ).alias("message")).alias("transaction"),
        F.struct(
            (err if err is not None else F.lit(None)).cast("string").alias("err"),
            F.struct(F.array(*writable).alias("writable"), F.array(*readonly).alias("readonly")).alias("loadedAddresses"),
            F.array(*(F.struct(F.array(*g).alias("instructions")) for g in inner)).alias("innerInstructions"),
        ).alias("meta"),
    ]


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per event; its program instruction carries the encoded event."""
    events = in_order(table(spark, sf_dir, "events"), "event_id")
    return replies_of(with_event_payload(events).withColumn("data", bytes_to_base58("payload")))


def replies_of(rows: DataFrame) -> DataFrame:
    """One transaction per event; its program instruction carries the column `data`."""
    user = F.concat(F.lit("user"), F.col("user_id"))
    return rows.select(*_reply(
        F.concat(F.lit("tx"), F.col("event_id")), -F.col("event_id"), F.col("event_id"),
        [user, F.lit(PROGRAM), F.lit("vault")], (F.lit(1), F.lit(0), F.lit(1)),
        [_instruction(1, [2], F.col("data")), _instruction(3, [0], F.lit("x"))],
        [F.lit("pool")], [F.lit("clock")], [[_instruction(4, [0], F.lit("y"))]],
    ))


def event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature feed of the event transactions, newest first."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("tx"), F.col("event_id")).alias("signature"),
        F.col("event_id").alias("slot"), (-F.col("event_id")).alias("feed_pos"),
    )


# -- line items as raw transactions --------------------------------------


def line_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per line item: three top-level and two inner instructions.

    Keys: 0 user, 1 progA, 2 progN, 3 vault, 4 clock, 5 pool (loaded, writable),
    6 progR (loaded, read-only). Program indexes run up to 7, past the end.
    """
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(6)
    line = F.col("l_linenumber")
    status = F.when(F.col("l_linestatus") == "O", 1).otherwise(2)
    data = lambda tag: F.concat(F.lit(tag), F.col("l_quantity").cast("int"))
    signature = F.concat_ws("-", F.lit("li"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(*_reply(
        signature, line, F.col("l_orderkey"),
        [F.concat(F.lit("user"), F.col("l_partkey")), F.lit("progA"), F.lit("progN"),
         F.concat(F.lit("vault"), F.col("l_suppkey")), F.lit("clock")],
        (1 + line % 2, line % 2, 1 + F.col("l_suppkey") % 2),
        [_instruction(flag, [0, 3, 5], data("a")), _instruction(line, [3, 4, 0], data("b")),
         _instruction(status, [1, 2, 9], data("c"))],
        [F.concat(F.lit("pool"), line)], [F.lit("progR")],
        [[_instruction(flag, [2, 5], data("d"))], [_instruction(1, [3, 6], data("e"))]],
        F.when(F.col("l_tax") == 0, F.lit("failed")),
    ))


# -- orders as the signature feed ----------------------------------------

ORDERS_PER_SLOT = 4


def order_signature() -> Column:
    return F.concat(F.lit("ord"), F.col("o_orderkey"))


def order_slot() -> Column:
    return F.floor(F.col("o_orderkey") / ORDERS_PER_SLOT)


def order_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature feed, newest first: larger order keys are newer."""
    return table(spark, sf_dir, "orders").select(
        order_signature().alias("signature"), order_slot().alias("slot"),
        (-F.col("o_orderkey")).alias("feed_pos"),
    )


def order_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed transactions of the orders that are not pending."""
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(
        order_signature().alias("signature"), order_slot().alias("slot")
    )


# -- customers and suppliers as account states ---------------------------


def customer_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reply per customer: its own account, and one owned by another program.

    By nation, replies are parsed objects (0), without a known discriminator (1),
    cut short (2) or absent (3).
    """
    nation = F.col("c_nationkey")
    known = F.upper(text.discriminator(text.ACCOUNT_SPACE, F.lit("Customer")))
    disc = F.when(nation == 1, F.lit("0" * 16)).otherwise(known)
    segment = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("00")).otherwise(
        F.concat(F.lit("01"), le_text(F.col("c_mktsegment")))
    )
    body = F.concat(
        disc, le(F.col("c_custkey"), 8), le_text(F.col("c_name")), le(nation, 1),
        le(F.round(F.col("c_acctbal") * 100), 8), segment,
    )
    raw = F.unhex(F.when(nation == 2, F.substring(body, 1, 40)).otherwise(body))
    data = F.when(nation == 0, F.lit('{"program":"parsed"}')).otherwise(
        F.to_json(F.array(F.base64(raw), F.lit("base64")))
    )
    own = F.when(nation != 3, F.struct(F.lit(PROGRAM).alias("owner"), data.alias("data")))
    other = F.struct(F.lit("OtherProgram").alias("owner"), data.alias("data"))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("ctx"), F.col("c_custkey")).alias("tx_signature"),
        F.array(F.concat(F.lit("acct"), F.col("c_custkey")), F.concat(F.lit("foreign"), F.col("c_custkey"))).alias("pubkeys"),
        F.array(own, other).alias("value"),
    )


def customer_writable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The writable accounts of each customer's transaction."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("slot"),
        F.concat(F.lit("ctx"), F.col("c_custkey")).alias("tx_signature"),
        F.explode(F.array(F.concat(F.lit("acct"), F.col("c_custkey")), F.concat(F.lit("foreign"), F.col("c_custkey")))).alias("pubkey"),
    )


def customer_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per customer; its program instruction touches both accounts."""
    unknown = bytes_to_base58(F.unhex(F.lit("DEADBEEFDEADBEEF")))
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(*_reply(
        F.concat(F.lit("ctx"), key), -key, key,
        [F.concat(F.lit("user"), key), F.lit(PROGRAM), F.concat(F.lit("acct"), key), F.concat(F.lit("foreign"), key)],
        (F.lit(1), F.lit(0), F.lit(0)), [_instruction(1, [2, 3], unknown)], [F.lit("pool")], [F.lit("clock")],
        [[_instruction(5, [0], F.lit("y"))]],
    ))


# -- customers as interface documents ------------------------------------

ARG_TYPES = [
    "bool", "u8", "i16", "u32", "u64", "i128", "f32", "f64", "string", "pubkey", "bytes",
    {"option": "u64"}, {"option": {"option": "string"}}, {"vec": "u8"}, {"array": ["u8", 4]},
    {"defined": "Mode"}, {"defined": {"name": "Rich"}}, {"defined": {"name": "Shape"}},
    {"defined": {"name": "Nowhere"}}, {"option": {"defined": {"name": "Mode"}}},
]


def _choice(values: list, index: Column) -> Column:
    return F.get(F.array(*(F.lit(json.dumps(v)) for v in values)), index.cast("int"))


def customer_idls(spark: SparkSession, sf_dir: str, revision: int = 0) -> DataFrame:
    """One interface per customer. Types depend on the nation; a later revision
    moves every type on by one and drops the second argument of some."""
    nation, key = F.col("c_nationkey"), F.col("c_custkey")
    kind = lambda shift: _choice(ARG_TYPES, (nation + shift) % len(ARG_TYPES))
    shape = F.when(key % 3 == 0, F.lit('{"kind":"struct","fields":[{"name":"totalPaid","type":"u64"},{"name":"alias","type":{"option":"string"}}]}')).when(
        key % 3 == 1, F.lit('{"kind":"struct","fields":["u64","string"]}')
    ).otherwise(F.lit('{"kind":"enum","variants":[{"name":"Only"}]}'))
    second = F.concat(F.lit(',{"name":"argTwo","type":'), kind(7), F.lit("}"))
    if revision:
        second = F.when(nation == 5, F.lit("")).otherwise(second)
    doc = F.concat(
        F.lit('{"address":"prog'), key, F.lit('","instructions":[{"name":"pay'), F.initcap("c_mktsegment"),
        F.lit('","args":[{"name":"argOne","type":'), kind(revision), F.lit("}"), second,
        F.lit(']},{"name":"close","args":[]}],"accounts":[{"name":"Vault'), key,
        F.lit('"}],"types":[{"name":"Mode","type":{"kind":"enum","variants":[{"name":"A"},{"name":"B","fields":[]}]}},'
              '{"name":"Rich","type":{"kind":"enum","variants":[{"name":"A","fields":["u64"]}]}},'
              '{"name":"Shape","type":{"kind":"struct","fields":[]}},{"name":"Vault'), key,
        F.lit('","type":'), shape, F.lit("}]}"),
    )
    return table(spark, sf_dir, "customer").select(doc.alias("idl"))


# -- events as notifications ---------------------------------------------


def event_notifications(events: DataFrame) -> DataFrame:
    """Three events in a row announce the same signature; k = 0 announces none."""
    first = F.col("event_id") - F.col("event_id") % 3
    return _notices(events, F.when(k() != 0, F.concat(F.lit("tx"), first)))


def own_notifications(events: DataFrame) -> DataFrame:
    """Every event announces its own signature; k = 0 announces none."""
    return _notices(events, F.when(k() != 0, F.concat(F.lit("tx"), F.col("event_id"))))


def _notices(events: DataFrame, signature: Column) -> DataFrame:
    return events.select(
        F.struct(F.col("event_id").alias("slot")).alias("context"),
        F.struct(signature.alias("signature")).alias("value"),
        F.col("ts").cast("timestamp").alias("received_at"),
    )
