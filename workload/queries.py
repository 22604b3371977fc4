"""Registered queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text, wide
from ledgerloom.functions.base58 import base58_to_bytes
from ledgerloom.functions.borsh import At, Layout
from ledgerloom.operators import accounts as acc
from ledgerloom.operators import catalog as cat
from ledgerloom.operators import instructions as ins
from ledgerloom.operators import query as q
from ledgerloom.operators import selection as sel
from ledgerloom.operators import transactions as tx
from ledgerloom.plans import ingest as ingestion
from ledgerloom.plans import store as st
from ledgerloom.plans.ingest import ingest
from ledgerloom.session import shared_folder
from ledgerloom.sources import readers
from ledgerloom.sources.documents import document_key, land_documents
from ledgerloom.streaming import realtime as rt
from workload import inputs as inp

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    def keep(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            ORACLES[key] = sql
        return function

    return keep


# -- list and aggregate --------------------------------------------------

EVENTS_SQL = """
WITH e AS (
  SELECT event_type AS instruction, event_id AS slot, 'tx' || event_id AS tx_signature,
         CAST(user_id AS VARCHAR) AS signer, ts AS created_at, value,
         CAST(round(value * 100) AS BIGINT) AS cents,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props
  FROM events)
"""


def _listed(instruction: str, request: dict) -> Query:
    def run(spark, sf_dir):
        rows = q.list_instructions(inp.event_tables(spark, sf_dir), inp.event_program(), instruction, request)
        return rows.select("slot", "tx_signature", "signer", "created_at", "value", "cents", "is_even", "props")

    return run


def _list_sql(where: str, order: str) -> str:
    return f"""{EVENTS_SQL} SELECT slot, tx_signature, signer, created_at, value, cents,
      k % 2 = 0 AS is_even, props FROM e WHERE {where} ORDER BY slot {order}"""


LIST_CASES = {
    "q_list_desc": ("purchase", {}, "instruction = 'purchase'", "DESC LIMIT 50"),
    "q_list_asc": ("view", {"order": "ASC", "limit": "200"}, "instruction = 'view'", "ASC LIMIT 200"),
    "q_list_filters": (
        "click",
        {"from_slot": "100", "to_slot": "900000", "arg.k.gte": "9.5", "arg.k.lte": "90",
         "arg.isEven": "true", "arg.value.lte": "60.25", "arg.cents.gte": "100", "limit": "120"},
        "instruction = 'click' AND slot BETWEEN 100 AND 900000 AND k BETWEEN 10 AND 90 "
        "AND k % 2 = 0 AND value <= 60.25 AND cents >= 100", "DESC LIMIT 120",
    ),
    "q_list_by_signer": ("error", {"signer": "7", "arg.isEven": "false"},
                         "instruction = 'error' AND signer = '7' AND k % 2 = 1", "DESC LIMIT 50"),
    "q_list_by_label": ("error", {"arg.label": "error-9", "order": "asc", "limit": "200"},
                        "instruction = 'error' AND k = 9", "ASC LIMIT 200"),
    "q_list_by_tx_signature": ("error", {"tx_signature": "tx0"},
                               "instruction = 'error' AND tx_signature = 'tx0'", "DESC LIMIT 50"),
    "q_list_wide_filter": (
        "signup", {"arg.bigAmount.gte": "80000000000000000000000000000000", "order": "asc", "limit": "200"},
        "instruction = 'signup' AND k + 1 >= 80", "ASC LIMIT 200",
    ),
}
for _name, (_ix, _request, _where, _order) in LIST_CASES.items():
    register(_list_sql(_where, _order), _name)(_listed(_ix, _request))


def _aggregated(instruction: str, request: dict, **options) -> Query:
    def run(spark, sf_dir):
        return q.aggregate(
            inp.event_tables(spark, sf_dir), inp.event_program(), instruction, request, **options
        )

    return run


def average_sql(total: str, count: str) -> str:
    """Text of an exact average with at least sixteen significant digits."""
    weight = lambda x: f"((length(CAST({x} AS VARCHAR)) - 1) // 4)"
    first = lambda x: f"CAST(left(CAST({x} AS VARCHAR), CAST(length(CAST({x} AS VARCHAR)) - 4 * {weight(x)} AS BIGINT)) AS BIGINT)"
    scale = (f"greatest(0, 16 - 4 * ({weight(total)} - {weight(count)} - "
             f"CASE WHEN {first(total)} <= {first(count)} THEN 1 ELSE 0 END))")
    power = f"CAST('1' || repeat('0', CAST({scale} AS BIGINT)) AS HUGEINT)"
    scaled = f"((CAST({total} AS HUGEINT) * {power} * 2 + {count}) // (2 * CAST({count} AS HUGEINT)))"
    return (f"CAST({scaled} // {power} AS VARCHAR) || '.' || "
            f"lpad(CAST({scaled} % {power} AS VARCHAR), CAST({scale} AS INTEGER), '0')")


FLOAT_TEXT = "regexp_replace(CAST({0} AS VARCHAR), '\\.0$', '')"
AGGREGATES = {
    "count": ({"metric": "count"}, "CAST(count(*) AS VARCHAR)"),
    "sum": ({"metric": "sum", "field": "cents"}, "CAST(sum(CAST(cents AS HUGEINT)) AS VARCHAR)"),
    "avg": ({"metric": "avg", "field": "k"}, average_sql("CAST(sum(k) AS HUGEINT)", "count(k)")),
    "min": ({"metric": "min", "field": "value"}, FLOAT_TEXT.format("min(value)")),
    "max": ({"metric": "max", "field": "k"}, "CAST(max(k) AS VARCHAR)"),
    "sum_wide": ({"metric": "sum", "field": "bigAmount"},
                 "CAST(sum(CAST(k + 1 AS HUGEINT) * 1000000000000000000000000000000 + slot) AS VARCHAR)"),
    "min_wide": ({"metric": "min", "field": "bigAmount"},
                 "CAST(min(CAST(k + 1 AS HUGEINT) * 1000000000000000000000000000000 + slot) AS VARCHAR)"),
}
for _metric, (_request, _sql) in AGGREGATES.items():
    register(f"{EVENTS_SQL} SELECT {_sql} AS value FROM e WHERE instruction = 'purchase'", f"q_{_metric}")(
        _aggregated("purchase", _request))
    register(
        f"{EVENTS_SQL} SELECT signer, {_sql} AS value FROM e WHERE instruction = 'view' GROUP BY signer",
        f"q_by_signer_{_metric}",
    )(_aggregated("view", {**_request, "group_by": "signer"}))

register(
    f"{EVENTS_SQL} SELECT CAST(count(*) AS VARCHAR) AS value FROM e WHERE instruction = 'click' "
    "AND slot >= 50 AND k >= 10 AND value <= 75.5", "q_count_filtered",
)(_aggregated("click", {"metric": "COUNT", "from_slot": "50", "arg.k.gte": "10", "arg.value.lte": "75.5"}))
register(
    f"{EVENTS_SQL} SELECT CAST(coalesce(sum(CAST(cents AS HUGEINT)), 0) AS VARCHAR) AS value FROM e "
    "WHERE instruction = 'refund'", "q_sum_of_nothing",
)(_aggregated("refund", {"metric": "sum", "field": "cents"}))


@register(f"{EVENTS_SQL} SELECT signer, round(sum(CAST(value AS DECIMAL(18,2))), 2)::DOUBLE AS total, "
          "round(avg(value), 6) AS mean FROM e WHERE instruction = 'purchase' GROUP BY signer")
def q_by_signer_float(spark, sf_dir):
    """Sum and average of a float argument; text of floats depends on summation order."""
    run = lambda metric: _aggregated(
        "purchase", {"metric": metric, "field": "value", "group_by": "signer"}
    )(spark, sf_dir)
    total = run("sum").select("signer", F.round(F.col("value").cast("double"), 2).alias("total"))
    mean = run("avg").select("signer", F.round(F.col("value").cast("double"), 6).alias("mean"))
    return total.join(mean, "signer")


@register(f"{EVENTS_SQL} SELECT 'purchase' AS instruction, 'LedgerProgram' AS program_id, 'max' AS metric, "
          "'signer' AS group_by, signer, CAST(max(cents) AS VARCHAR) AS value FROM e "
          "WHERE instruction = 'purchase' GROUP BY signer")
def q_envelope(spark, sf_dir):
    request = {"metric": "max", "field": "cents", "group_by": "signer"}
    result = _aggregated("purchase", request, numeric_order=True)(spark, sf_dir)
    return q.envelope(result, inp.event_program(), "purchase", request)


@register(f"{EVENTS_SQL} SELECT CAST(slot AS VARCHAR) AS slot, tx_signature, CAST(cents AS VARCHAR) AS cents, "
          "CAST(k AS VARCHAR) AS k, CAST(CAST(k + 1 AS HUGEINT) * 1000000000000000000000000000000 + slot AS VARCHAR) "
          "AS big_amount, k % 2 = 0 AS is_even FROM e WHERE instruction = 'signup'")
def q_rows_as_text(spark, sf_dir):
    rows = inp.event_tables(spark, sf_dir).instruction("signup")
    return q.as_text(rows.select("slot", "tx_signature", "cents", "k", "big_amount", "is_even"))


@register("""WITH n(instruction) AS (VALUES ('click'),('error'),('purchase'),('signup'),('view'),('refund'))
SELECT n.instruction, CAST(count(event_id) AS VARCHAR) AS count,
  CAST(count(DISTINCT user_id) AS VARCHAR) AS unique_signers, CAST(max(event_id) AS VARCHAR) AS latest_slot
FROM n LEFT JOIN events ON event_type = n.instruction GROUP BY n.instruction""")
def q_stats_instructions(spark, sf_dir):
    return q.instruction_stats(inp.event_tables(spark, sf_dir), inp.event_program())


@register("""SELECT 'LedgerProgram' AS program_id, CAST(count(*) AS VARCHAR) AS total_instructions,
  CAST(count(DISTINCT user_id) AS VARCHAR) AS unique_signers,
  CAST(max(event_id) AS VARCHAR) AS latest_indexed_slot FROM events""")
def q_stats_program(spark, sf_dir):
    return q.program_stats(inp.event_tables(spark, sf_dir), inp.event_program())


# -- interfaces ----------------------------------------------------------

_SPACES = {"instruction": "global:", "account": "account:"}


@register("""WITH n AS (SELECT 'prog' || c_custkey AS program_id,
    unnest(['pay' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]), 'close']) AS name FROM customer)
SELECT program_id, name, substr(sha256('global:' || name), 1, 16) AS disc FROM n""")
def q_discriminators(spark, sf_dir):
    return cat.instruction_discriminators(inp.customer_idls(spark, sf_dir)).select("program_id", "name", "disc")


@register("""SELECT 'prog' || c_custkey AS program_id, 'Vault' || c_custkey AS name,
  substr(sha256('account:Vault' || c_custkey), 1, 16) AS disc FROM customer""")
def q_account_discriminators(spark, sf_dir):
    return cat.account_discriminators(inp.customer_idls(spark, sf_dir)).select("program_id", "name", "disc")


# Storage type, nullable, filter kind of each entry of ARG_TYPES, in its order.
_EXPECTED = [
    ("BOOLEAN", False, "scalar"), ("SMALLINT", False, "numeric"), ("SMALLINT", False, "numeric"),
    ("INTEGER", False, "numeric"), ("BIGINT", False, "numeric"), ("NUMERIC(39,0)", False, "numeric"),
    ("REAL", False, "numeric"), ("DOUBLE PRECISION", False, "numeric"), ("TEXT", False, "scalar"),
    ("VARCHAR(44)", False, "scalar"), ("BYTEA", False, "unsupported"), ("BIGINT", True, "numeric"),
    ("TEXT", True, "scalar"), ("JSONB", False, "unsupported"), ("JSONB", False, "unsupported"),
    ("TEXT", False, "scalar"), ("JSONB", False, "unsupported"), ("JSONB", False, "unsupported"),
    ("JSONB", False, "unsupported"), ("TEXT", True, "scalar"),
]
_TYPES_SQL = "t(i, sql_type, nullable, filter_kind) AS (VALUES " + ", ".join(
    f"({i}, '{s}', {str(n).lower()}, '{f}')" for i, (s, n, f) in enumerate(_EXPECTED)) + ")"
_SEGMENT = "upper(c_mktsegment[1]) || lower(c_mktsegment[2:])"


@register(f"""WITH {_TYPES_SQL}
SELECT 'prog' || c_custkey AS program_id, 'instruction' AS kind, 'pay' || {_SEGMENT} AS object,
  'ix_pay_' || lower(c_mktsegment) AS table_name, a.o AS ordinal, a.f AS field, a.c AS column_name,
  t.sql_type, t.nullable, t.filter_kind
FROM customer, (VALUES (0, 0, 'argOne', 'arg_one'), (1, 7, 'argTwo', 'arg_two')) a(o, shift, f, c), t
WHERE t.i = (c_nationkey + a.shift) % 20
UNION ALL SELECT 'prog' || c_custkey, 'instruction', 'close', 'ix_close', NULL, NULL, NULL, NULL, NULL, NULL FROM customer
UNION ALL SELECT 'prog' || c_custkey, 'account', 'Vault' || c_custkey, 'acct_vault' || c_custkey, v.o, v.f, v.c, v.s, v.n, v.k
FROM customer, (VALUES (0, 'totalPaid', 'total_paid', 'BIGINT', false, 'numeric'), (1, 'alias', 'alias', 'TEXT', true, 'scalar'))
  v(o, f, c, s, n, k) WHERE c_custkey % 3 = 0
UNION ALL SELECT 'prog' || c_custkey, 'account', 'Vault' || c_custkey, 'acct_vault' || c_custkey, NULL, NULL, NULL, NULL, NULL, NULL
FROM customer WHERE c_custkey % 3 = 1""")
def q_catalog_columns(spark, sf_dir):
    return cat.catalog_columns(inp.customer_idls(spark, sf_dir)).drop("idl_type")


@register(f"""WITH {_TYPES_SQL}, args AS (
  SELECT 'prog' || c_custkey AS program_id, 'instruction' AS kind, 'pay' || {_SEGMENT} AS object, f AS field,
    old.sql_type AS was, old.nullable AS was_n,
    CASE WHEN f = 'argTwo' AND c_nationkey = 5 THEN NULL ELSE new.sql_type END AS now, new.nullable AS now_n
  FROM customer, (VALUES ('argOne', 0, 1), ('argTwo', 7, 7)) a(f, s1, s2), t old, t new
  WHERE old.i = (c_nationkey + s1) % 20 AND new.i = (c_nationkey + s2) % 20)
SELECT program_id, kind, object, field,
  CASE WHEN now IS NULL THEN 'removed' WHEN was <> now THEN 'type' ELSE 'nullability' END AS change,
  was AS was_type, now AS now_type
FROM args WHERE now IS NULL OR was <> now OR was_n <> now_n""")
def q_schema_drift(spark, sf_dir):
    old = cat.catalog_columns(inp.customer_idls(spark, sf_dir))
    new = cat.catalog_columns(inp.customer_idls(spark, sf_dir, revision=1))
    return cat.schema_drift(new, old)


# -- raw transactions ----------------------------------------------------

_LINES_SQL = """
WITH l AS (
  SELECT row_number() OVER () AS rid, l_orderkey AS slot,
    concat_ws('-', 'li', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS tx_signature,
    'user' || l_partkey AS signer, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS qty,
    ['user' || l_partkey, 'progA', 'progN', 'vault' || l_suppkey, 'clock', 'pool' || l_linenumber, 'progR'] AS keys,
    CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 6 END AS flag,
    CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END AS status, l_linenumber AS line,
    1 + l_linenumber % 2 AS signed, l_linenumber % 2 AS ro_signed, 1 + l_suppkey % 2 AS ro_unsigned, l_tax
  FROM lineitem),
f AS (
  SELECT rid, slot, tx_signature, signer, keys, signed, ro_signed, ro_unsigned, l_tax, x.ix_ordinal, x.data, x.accounts,
    keys[x.idx + 1] AS program_id
  FROM l, LATERAL (VALUES (0, flag, 'a' || qty, [0,3,5]), (1, line, 'b' || qty, [3,4,0]), (2, status, 'c' || qty, [1,2,9]),
    (3, flag, 'd' || qty, [2,5]), (4, 1, 'e' || qty, [3,6])) x(ix_ordinal, idx, data, accounts))
"""


@register(f"{_LINES_SQL} SELECT slot, tx_signature, signer, ix_ordinal, program_id, data FROM f")
def q_flatten_instructions(spark, sf_dir):
    flat = tx.flatten_all_instructions(inp.line_transactions(spark, sf_dir))
    return flat.select("slot", "tx_signature", "signer", "ix_ordinal", "program_id", "data")


@register(f"{_LINES_SQL} SELECT slot, tx_signature, signer, ix_ordinal, data FROM f WHERE program_id = 'progA'")
def q_filter_program(spark, sf_dir):
    flat = tx.flatten_all_instructions(inp.line_transactions(spark, sf_dir))
    own = flat.where(F.col("program_id") == "progA")
    return own.select("slot", "tx_signature", "signer", "ix_ordinal", "data")


@register(f"""{_LINES_SQL} SELECT program_id, slot, tx_signature, ix_ordinal FROM f
WHERE program_id IN (SELECT 'prog' || l_returnflag FROM lineitem WHERE l_returnflag <> 'N')""")
def q_filter_programs(spark, sf_dir):
    """Several programs at once; the list of programs comes from a table."""
    named = inp.table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(
        F.concat(F.lit("prog"), "l_returnflag").alias("program_id"))
    flat = tx.flatten_all_instructions(inp.line_transactions(spark, sf_dir))
    return tx.filter_programs(flat, named).select("program_id", "slot", "tx_signature", "ix_ordinal")


@register(f"{_LINES_SQL} SELECT slot, tx_signature, ix_ordinal, data FROM f WHERE program_id = 'progR' AND l_tax <> 0")
def q_filter_without_failed(spark, sf_dir):
    prepared = tx.with_program_instructions(
        inp.line_transactions(spark, sf_dir), "progR", include_failed=False)
    return tx.flatten_instructions(prepared).select("slot", "tx_signature", "ix_ordinal", "data")


@register(f"""{_LINES_SQL}, i AS (
  SELECT rid, slot, tx_signature, keys, signed, ro_signed, ro_unsigned, ix_ordinal,
    unnest(accounts) AS a, unnest(range(len(accounts))) AS p FROM f WHERE program_id = 'progA'),
w AS (
  SELECT rid, slot, tx_signature, keys[a + 1] AS pubkey, min(ix_ordinal * 10 + p) AS seen FROM i
  WHERE CASE WHEN a >= 5 THEN a - 5 < 1 WHEN a < signed THEN a < signed - ro_signed
    ELSE a < 5 - ro_unsigned END GROUP BY ALL)
SELECT slot, tx_signature, pubkey,
  CAST(row_number() OVER (PARTITION BY rid ORDER BY seen) - 1 AS INT) AS account_pos FROM w""")
def q_writable_accounts(spark, sf_dir):
    prepared = tx.with_program_instructions(inp.line_transactions(spark, sf_dir), "progA")
    return tx.writable_accounts(prepared)


# -- decoding ------------------------------------------------------------

_LEDGER_SQL = f"""{EVENTS_SQL}
SELECT instruction, slot, tx_signature, 'user' || signer AS signer, CAST(slot AS VARCHAR) AS event_id,
  CAST(signer AS BIGINT) AS user_id, cents - 5000 AS delta, instruction || '-' || k AS label,
  CAST(CAST(k + 1 AS HUGEINT) * 18446744073709551616 + slot AS VARCHAR) AS amount,
  CASE WHEN k % 3 <> 0 THEN props END AS note, k % 2 = 0 AS is_even, upper(sha256(signer)) AS owner_hex,
  '{{"k":' || k || ',"marks":[' || k || ',' || signer || '],"total":"' || slot || '"}}' AS detail,
  CASE WHEN k % 2 = 0 THEN '{{"buy":{{}}}}' ELSE '{{"sell":{{}}}}' END AS side
FROM e WHERE k > 1"""


def _ledger_columns(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(
        F.lit(name).alias("instruction"), "slot", "tx_signature", "signer",
        F.col("event_id").cast("string").alias("event_id"), "user_id", "delta", "label",
        wide.text(F.col("amount")).alias("amount"), "note", "is_even",
        F.hex(base58_to_bytes("owner")).alias("owner_hex"), "detail", "side",
    )


def _matched(spark, sf_dir) -> DataFrame:
    program = inp.ledger_program()
    prepared = tx.with_program_instructions(inp.event_transactions(spark, sf_dir), program.program_id)
    return ins.match_instructions(tx.flatten_instructions(prepared), program)


@register(f"{EVENTS_SQL} SELECT slot, tx_signature, CASE WHEN k = 0 THEN 'deadbeefdeadbeef' ELSE "
          "substr(sha256('global:' || instruction), 1, 16) END AS disc, "
          "CASE WHEN k > 0 THEN instruction END AS instruction FROM e")
def q_match_instructions(spark, sf_dir):
    return _matched(spark, sf_dir).select("slot", "tx_signature", "disc", "instruction")


def _staged(spark, sf_dir) -> DataFrame:
    """Matched payloads written by instruction, so each decoder reads its own rows only."""
    matched, path = _matched(spark, sf_dir), shared_folder(spark, "payloads")
    matched.write.partitionBy("instruction").parquet(path)
    return spark.read.schema(matched.schema).parquet(path)


@register(_LEDGER_SQL)
def q_decode_instructions(spark, sf_dir):
    program, matched = inp.ledger_program(), _staged(spark, sf_dir)
    decoded = [
        _ledger_columns(ins.decode_instructions(matched, program, name, on_error="quarantine"), name)
        for name in program.instructions
    ]
    return reduce(DataFrame.unionAll, decoded)


@register(f"""{EVENTS_SQL} SELECT slot, tx_signature, 'unknown_discriminator' AS reason, 'deadbeefdeadbeef' AS detail
FROM e WHERE k = 0 UNION ALL SELECT slot, tx_signature, 'decode_error', instruction FROM e WHERE k = 1""")
def q_rejects(spark, sf_dir):
    program, matched = inp.ledger_program(), _staged(spark, sf_dir)
    rejects = [ins.decode_rejects(matched, program, name) for name in program.instructions]
    return reduce(DataFrame.unionByName, rejects, ins.unknown_instructions(matched))


@register("""SELECT 'ctx' || c_custkey AS tx_signature, 'acct' || c_custkey AS pubkey, c_nationkey <> 0 AS has_bytes
FROM customer WHERE c_nationkey <> 3""")
def q_owned_accounts(spark, sf_dir):
    states = acc.account_states(inp.customer_infos(spark, sf_dir))
    owned = acc.account_bytes(acc.owned_accounts(states, inp.PROGRAM))
    return owned.select("tx_signature", "pubkey", F.col("payload").isNotNull().alias("has_bytes"))


def _matched_accounts(spark, sf_dir) -> DataFrame:
    states = acc.owned_accounts(acc.account_states(inp.customer_infos(spark, sf_dir)), inp.PROGRAM)
    touched = acc.touched_states(inp.customer_writable(spark, sf_dir), states)
    return acc.match_accounts(acc.account_bytes(touched), inp.ledger_program())


@register("""SELECT 'acct' || c_custkey AS pubkey, c_custkey AS slot, CAST(c_custkey AS VARCHAR) AS cust_key,
  c_name AS full_name, CAST(c_nationkey AS INT) AS nation, CAST(round(c_acctbal * 100) AS BIGINT) AS balance,
  CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment
FROM customer WHERE c_nationkey NOT IN (0, 1, 2, 3)""")
def q_decode_accounts(spark, sf_dir):
    rows = acc.decode_accounts(_matched_accounts(spark, sf_dir), inp.ledger_program(), "Customer")
    return rows.select(
        "pubkey", "slot", F.col("cust_key").cast("string").alias("cust_key"), "full_name",
        F.col("nation").cast("int").alias("nation"), "balance", "segment",
    )


@register("""SELECT c_custkey AS slot, 'ctx' || c_custkey AS tx_signature,
  CASE c_nationkey WHEN 0 THEN 'bad_encoding' WHEN 1 THEN 'unknown_discriminator' ELSE 'decode_error' END AS reason,
  'acct' || c_custkey AS detail FROM customer WHERE c_nationkey IN (0, 1, 2)""")
def q_account_rejects(spark, sf_dir):
    matched = _matched_accounts(spark, sf_dir)
    return acc.unmatched_accounts(matched).unionByName(
        acc.account_rejects(matched, inp.ledger_program(), "Customer"))


@register("""SELECT 'ord' || o_orderkey AS signature, o_orderkey // 4 AS slot FROM orders WHERE o_orderstatus = 'P'""")
def q_unresolved(spark, sf_dir):
    missing = tx.unresolved_signatures(inp.order_feed(spark, sf_dir), inp.order_replies(spark, sf_dir))
    return missing.select("signature", "slot")


# -- selection -----------------------------------------------------------

_FEED_SQL = "WITH f AS (SELECT 'ord' || o_orderkey AS signature, o_orderkey // 4 AS slot, -o_orderkey AS feed_pos, * FROM orders)"


@register(f"{_FEED_SQL} SELECT signature, slot, feed_pos FROM f WHERE slot > 100 AND slot <= 2000")
def q_select_slots(spark, sf_dir):
    return sel.select_slots(inp.order_feed(spark, sf_dir), 100, 2000).select("signature", "slot", "feed_pos")


@register(f"{_FEED_SQL} SELECT signature, slot, feed_pos FROM f WHERE o_orderkey < 1400 AND o_orderkey > 57")
def q_select_between(spark, sf_dir):
    rows = sel.select_between(inp.order_feed(spark, sf_dir), "ord1400", "ord57")
    return rows.select("signature", "slot", "feed_pos")


@register(f"""{_FEED_SQL} SELECT signature, slot, feed_pos FROM f
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)""")
def q_select_list(spark, sf_dir):
    """The list names orders several times, with blanks around and between."""
    lines = inp.table(spark, sf_dir, "lineitem")
    named = F.when(F.col("l_quantity") == 50, F.concat(F.lit(" ord"), "l_orderkey", F.lit(" "))).otherwise(" ")
    wanted = lines.select(named.alias("signature"))
    return sel.select_signatures(inp.order_feed(spark, sf_dir), wanted).select("signature", "slot", "feed_pos")


def order_commits(spark, sf_dir) -> DataFrame:
    """Commits per order: the program is its status; low-priority orders leave gaps."""
    return inp.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("prog"), "o_orderstatus").alias("program_id"),
        (F.col("o_orderpriority") != "5-LOW").alias("contiguous"),
        inp.order_slot().alias("last_whole_slot"),
    )


@register("""SELECT 'prog' || o_orderstatus AS program_id, max(o_orderkey // 4) AS last_processed_slot
FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1""")
def q_checkpoint(spark, sf_dir):
    return st.checkpoints(order_commits(spark, sf_dir))


@register("""SELECT (SELECT max(o_orderkey // 4) FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus = 'F') AS from_slot,
  (SELECT max(o_orderkey // 4) FROM orders) AS to_slot""")
def q_resume_range(spark, sf_dir):
    own = st.checkpoints(order_commits(spark, sf_dir)).where("program_id = 'progF'")
    return sel.resume_range(own, inp.order_feed(spark, sf_dir))


@register(f"{_FEED_SQL} SELECT signature, slot, feed_pos FROM f WHERE o_orderstatus <> 'F'")
def q_exclude_done(spark, sf_dir):
    done = inp.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("prog"), "o_orderstatus").alias("program_id"),
        inp.order_signature().alias("tx_signature"), inp.order_slot().alias("slot"))
    rows = sel.exclude_done(inp.order_feed(spark, sf_dir), done, "progF")
    return rows.select("signature", "slot", "feed_pos")


# -- registry and commits ------------------------------------------------


@register("""SELECT CAST(user_id AS VARCHAR) AS program_id, arg_max(props, ts) AS idl, min(ts) AS created_at, max(ts) AS updated_at
FROM events GROUP BY user_id""")
def q_registry_latest(spark, sf_dir):
    log = inp.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("program_id"), F.col("props").alias("idl"),
        F.col("ts").alias("written_at"))
    return st.latest_programs(log)


@register("""WITH c AS (SELECT 'b' || s_suppkey AS batch, s_nationkey, s_suppkey // 2 AS batch_id,
    row_number() OVER (PARTITION BY s_nationkey, s_suppkey // 2 ORDER BY s_acctbal, 'b' || s_suppkey) AS n
  FROM supplier WHERE s_acctbal > 1000)
SELECT l_orderkey, l_linenumber, 'b' || l_suppkey AS batch, l_extendedprice FROM lineitem
WHERE 'b' || l_suppkey IN (SELECT batch FROM c WHERE n = 1)""")
def q_commit_visible(spark, sf_dir):
    """Each supplier is an attempt; two with the same run and batch show one of them."""
    lines = inp.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("b"), "l_suppkey").alias("batch"), "l_extendedprice")
    commits = inp.table(spark, sf_dir, "supplier").where("s_acctbal > 1000").select(
        F.lit("p").alias("program_id"), F.concat(F.lit("r"), "s_nationkey").alias("run"),
        F.floor(F.col("s_suppkey") / 2).alias("batch_id"),
        F.concat(F.lit("b"), "s_suppkey").alias("batch"), F.col("s_acctbal").alias("committed_at"))
    return st.visible(lines, commits).select("l_orderkey", "l_linenumber", "batch", "l_extendedprice")


def _new_store(spark, purpose: str) -> st.Store:
    store = st.Store(spark, shared_folder(spark, purpose), inp.ledger_program(), slots_per_bucket=1000)
    store.ensure_tables()
    return store


@register(f"SELECT * FROM ({_LEDGER_SQL})")
def q_ingest(spark, sf_dir):
    """Raw transactions through the whole batch path, read back from committed tables."""
    store = _new_store(spark, "ingest")
    ingest(store, inp.event_transactions(spark, sf_dir), None, "all", on_error="quarantine")
    rows = [_ledger_columns(store.instruction(n), n) for n in store.program.instructions]
    return reduce(DataFrame.unionAll, rows)


# -- composed paths ------------------------------------------------------


def _store_rows(store: st.Store) -> DataFrame:
    return reduce(DataFrame.unionAll, [_ledger_columns(store.instruction(n), n) for n in store.program.instructions])


def _landed(df: DataFrame, purpose: str) -> str:
    """A derived input written as files, as a landing job leaves them."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return path


def _landed_replies(spark, sf_dir) -> DataFrame:
    """The transactions of all events as landed files: encoded once, however often they are read."""
    return readers.read_transactions(spark, _landed(inp.event_transactions(spark, sf_dir), "transactions"), "parquet")


def _landed_by_type(spark, sf_dir) -> dict[str, DataFrame]:
    """The transactions of the events of each type, landed in one pass as a folder a type."""
    replies, path = inp.event_transactions(spark, sf_dir), shared_folder(spark, "transactions")
    kind = inp.table(spark, sf_dir, "events").where(F.col("event_type").isin(inp.EVENT_TYPES)).select(
        F.concat(F.lit("tx"), "event_id").alias("signature"), F.col("event_type").alias("kind")).distinct()
    replies.join(kind, "signature").write.partitionBy("kind").parquet(path)
    st.ensure_folders(spark, [f"{path}/kind={name}" for name in inp.EVENT_TYPES])
    return {name: readers.read_transactions(spark, f"{path}/kind={name}", "parquet") for name in inp.EVENT_TYPES}


def _event_files(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The feed and the transactions of all events, through the readers."""
    feed = _landed(inp.event_feed(spark, sf_dir), "feed")
    return readers.read_signatures(spark, feed, "parquet"), _landed_replies(spark, sf_dir)


@register(_LEDGER_SQL)
def q_backfill_slots(spark, sf_dir):
    """Two ranges that overlap and cover the whole feed: every row once."""
    feed, replies = _event_files(spark, sf_dir)
    store, middle = _new_store(spark, "slots"), feed.agg(F.max("slot")).first()[0] // 2
    ingestion.backfill(store, feed, replies, None, "low", slots=(0, middle + 100), on_error="quarantine")
    ingestion.backfill(store, feed, replies, None, "high", slots=(middle - 100, 2 * middle + 1), on_error="quarantine")
    return _store_rows(store)


@register(f"""SELECT * FROM ({_LEDGER_SQL}) WHERE slot < (SELECT max(event_id) FROM events) AND slot > (SELECT min(event_id) FROM events)""")
def q_backfill_between(spark, sf_dir):
    """Between the newest and the oldest signature, both left out."""
    feed, replies = _event_files(spark, sf_dir)
    store, ends = _new_store(spark, "between"), feed.agg(F.max("slot"), F.min("slot")).first()
    ingestion.backfill(store, feed, replies, None, "run", between=(f"tx{ends[0]}", f"tx{ends[1]}"), on_error="quarantine")
    return _store_rows(store)


_LISTED_SQL = f"""{EVENTS_SQL} SELECT tx_signature AS signature FROM e WHERE k % 5 = 3
UNION ALL SELECT 'gone' || o_orderkey FROM orders"""


def _listed_store(spark, sf_dir) -> st.Store:
    """A list of all events and of orders that never landed. The feed lacks the events
    with k % 5 = 2, and those with k % 5 = 3 have not landed."""
    events = inp.table(spark, sf_dir, "events").select(F.concat(F.lit("tx"), F.col("event_id")).alias("signature"), (inp.k() % 5).alias("part"))
    lacks = lambda rows, part: rows.join(events.where(F.col("part") == part), "signature", "left_anti")
    feed, replies = _event_files(spark, sf_dir)
    absent = inp.table(spark, sf_dir, "orders").select(F.concat(F.lit("gone"), "o_orderkey"))
    wanted = events.select(F.concat(F.lit(" "), "signature", F.lit(" ")).alias("signature")).union(absent)
    store = _new_store(spark, "list")
    ingestion.backfill(store, lacks(feed, 2), lacks(replies, 3), None, "run", signatures=wanted, on_error="quarantine")
    return store


@register(f"SELECT * FROM ({_LEDGER_SQL} AND k % 5 <> 3)")
def q_backfill_list(spark, sf_dir):
    """A listed signature counts also when the feed lacks it."""
    return _store_rows(_listed_store(spark, sf_dir))


@register(_LISTED_SQL)
def q_backfill_list_unresolved(spark, sf_dir):
    """What has not landed waits, whether the feed knows it or not."""
    return _listed_store(spark, sf_dir).unresolved().select("signature")


def _caught_up(spark, sf_dir) -> st.Store:
    """A live batch left what had not landed, then a backfill of the oldest half; catch-up does the rest."""
    feed, replies = _event_files(spark, sf_dir)
    store, middle = _new_store(spark, "catch-up"), feed.agg(F.max("slot")).first()[0] // 2
    early = replies.where(F.col("slot") <= middle // 2)
    ingestion.backfill(store, feed, early, None, "first", slots=(0, middle), on_error="quarantine")
    ingestion.catch_up(store, feed, replies, None, "gap", on_error="quarantine")
    # a feed that has landed less than what is committed leaves everything as it is
    ingestion.catch_up(store, feed.where(F.col("slot") <= middle), replies, None, "behind", on_error="quarantine")
    return store


@register(_LEDGER_SQL)
def q_catch_up(spark, sf_dir):
    """Signatures that waited and slots never read are both there after catch-up."""
    return _store_rows(_caught_up(spark, sf_dir))


@register("SELECT max(event_id) AS last_processed_slot FROM events")
def q_catch_up_checkpoint(spark, sf_dir):
    return _caught_up(spark, sf_dir).checkpoint().select("last_processed_slot")


@register(f"""{EVENTS_SQL} SELECT slot, tx_signature, 'unknown_discriminator' AS reason, 'deadbeefdeadbeef' AS detail
FROM e WHERE k = 0 UNION ALL SELECT slot, tx_signature, 'decode_error', instruction FROM e WHERE k = 1""")
def q_ingest_rejects(spark, sf_dir):
    """Rejects as committed. With q_ingest: every program instruction is a row or a reject."""
    store = _new_store(spark, "rejects")
    ingest(store, inp.event_transactions(spark, sf_dir), None, "all", on_error="quarantine")
    return store.table("_rejects")


def _account_store(spark, sf_dir) -> st.Store:
    infos = _landed(inp.customer_infos(spark, sf_dir), "infos")
    store = _new_store(spark, "accounts")
    ingest(store, inp.customer_transactions(spark, sf_dir), readers.read_account_infos(spark, infos, "parquet"), "all")
    return store


@register(ORACLES["q_decode_accounts"])
def q_ingest_accounts(spark, sf_dir):
    """Account states of touched accounts, read back from committed tables."""
    rows = _account_store(spark, sf_dir).account("Customer")
    return rows.select(
        "pubkey", "slot", F.col("cust_key").cast("string").alias("cust_key"), "full_name",
        F.col("nation").cast("int").alias("nation"), "balance", "segment",
    )


@register(f"""SELECT * FROM ({ORACLES["q_account_rejects"]}) UNION ALL
SELECT c_custkey, 'ctx' || c_custkey, 'unknown_discriminator', 'deadbeefdeadbeef' FROM customer""")
def q_ingest_account_rejects(spark, sf_dir):
    return _account_store(spark, sf_dir).table("_rejects")


def _ledger_store(spark, sf_dir) -> st.Store:
    """All events in many small batches, then compacted, with the old files deleted."""
    store, parts = _new_store(spark, "ledger"), _landed_by_type(spark, sf_dir)
    for k, kind in enumerate(inp.EVENT_TYPES):
        ingest(store, parts[kind], None, "part", k, on_error="quarantine")
    store.compact(small_bytes=st.ANY_BYTES)
    store.vacuum(older_than_hours=0)
    return store


@register(_LEDGER_SQL)
def q_store_compacted(spark, sf_dir):
    """Compaction leaves every row as it was."""
    return _store_rows(_ledger_store(spark, sf_dir))


@register(f"""SELECT CAST(slot AS VARCHAR) AS slot, tx_signature, signer, CAST(delta AS VARCHAR) AS delta, amount
FROM ({_LEDGER_SQL}) WHERE instruction = 'view' AND delta >= 100 ORDER BY CAST(slot AS BIGINT) DESC LIMIT 50""")
def q_store_list(spark, sf_dir):
    """The newest rows of a stored instruction that pass a filter."""
    store = _ledger_store(spark, sf_dir)
    rows = q.list_instructions(store, store.program, "view", {"arg.delta.gte": "100"})
    return q.as_text(rows).select("slot", "tx_signature", "signer", "delta", "amount")


@register(f"""SELECT signer, CAST(sum(CAST(delta AS HUGEINT)) AS VARCHAR) AS value
FROM ({_LEDGER_SQL}) WHERE instruction = 'purchase' GROUP BY signer""")
def q_store_sum_by_signer(spark, sf_dir):
    store = _ledger_store(spark, sf_dir)
    return q.aggregate(store, store.program, "purchase", {"metric": "sum", "field": "delta", "group_by": "signer"}, numeric_order=True)


@register(f"""SELECT instruction, CAST(count(*) AS VARCHAR) AS count, CAST(count(DISTINCT signer) AS VARCHAR) AS unique_signers,
  CAST(max(slot) AS VARCHAR) AS latest_slot FROM ({_LEDGER_SQL}) GROUP BY instruction""")
def q_store_stats(spark, sf_dir):
    store = _ledger_store(spark, sf_dir)
    return q.instruction_stats(store, store.program)


@register("""SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN 'Failed to parse IDL JSON'
  WHEN s_nationkey % 3 = 1 THEN 'IDL has no program address' END AS idl_error FROM supplier""")
def q_read_idl(spark, sf_dir):
    """One file for each supplier: cut short, without an address, or whole."""
    nation = F.col("s_nationkey") % 3
    doc = F.when(nation == 0, F.lit('{"address":')).when(nation == 1, F.lit('{"instructions":[]}')).otherwise(
        F.concat(F.lit('{"address":"prog'), "s_suppkey", F.lit('"}')))
    path = shared_folder(spark, "idl")
    documents = inp.dealt(inp.table(spark, sf_dir, "supplier").select("s_suppkey", doc.alias("value")), "s_suppkey")
    land_documents(documents, path)
    return readers.read_idl(spark, path).select(document_key().alias("s_suppkey"), "idl_error")


# -- values --------------------------------------------------------------


@register(f"""{EVENTS_SQL} SELECT slot, '{{"label":"' || instruction || '","k":"' || k || '","small":' || k || ',"note":'
  || CASE WHEN k % 3 = 0 THEN 'null' ELSE '"' || replace(props, '"', '\\"') || '"' END || ',"raw":['
  || CASE WHEN k % 2 = 0 THEN '0,255' ELSE '' END || '],"rate":'
  || CASE k % 4 WHEN 0 THEN '5' WHEN 1 THEN '2.5' WHEN 2 THEN '1e-7' ELSE '1e+21' END || '}}' AS json FROM e""")
def q_json_form(spark, sf_dir):
    """Nested values as JSON: large integers as strings, bytes as numbers, null kept, floats without padding."""
    layout = Layout({"Doc": {"kind": "struct", "fields": [
        {"name": "label", "type": "string"}, {"name": "k", "type": "u64"}, {"name": "small", "type": "u8"},
        {"name": "note", "type": {"option": "string"}}, {"name": "raw", "type": "bytes"},
        {"name": "rate", "type": "f64"}]}})
    number = inp.k()
    payload = F.unhex(F.concat(
        inp.le_text(F.col("event_type")), inp.le(number, 8), inp.le(number, 1),
        F.when(number % 3 == 0, F.lit("00")).otherwise(F.concat(F.lit("01"), inp.le_text(F.col("props")))),
        F.when(number % 2 == 0, F.lit("0200000000FF")).otherwise(F.lit("00000000")),
        # 5, 2.5, 1e-7 and 1e21 as doubles
        F.get(F.array(F.lit("0000000000001440"), F.lit("0000000000000440"), F.lit("48AFBC9AF2D77A3E"), F.lit("50EFE2D6E41A4B44")), (number % 4).cast("int")),
    ))
    rows = inp.table(spark, sf_dir, "events").select(F.col("event_id").alias("slot"), payload.alias("p"))
    return rows.select("slot", F.expr(layout.json_text({"defined": "Doc"}, "p", At())).alias("json"))


@register("""WITH v AS (SELECT l_orderkey AS key, (l_partkey::HUGEINT - l_suppkey * 3) * 100000000000000000000 - l_orderkey AS n FROM lineitem)
SELECT key, CAST(sum(n) AS VARCHAR) AS total, CAST(min(n) AS VARCHAR) AS least, CAST(max(n) AS VARCHAR) AS most FROM v GROUP BY key""")
def q_i128_sum(spark, sf_dir):
    """Signed 128-bit sums and bounds per order."""
    scaled = ((F.col("l_partkey") - F.col("l_suppkey") * 3) * 10).cast("decimal(38,0)")
    borrow = F.when(F.col("l_orderkey") > 0, 1).otherwise(0)
    value = wide.limbs(scaled - borrow, borrow * wide.dec(wide.BASE) - F.col("l_orderkey"))
    rows = inp.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), value.alias("v"))
    hi, lo = wide.sums(F.col("v"))
    return rows.groupBy("key").agg(
        wide.pair_text(hi, lo).alias("total"), wide.text(F.min("v")).alias("least"),
        wide.text(F.max("v")).alias("most"))


@register("""SELECT p_partkey, 'u64_value_' || p_partkey AS snake, lower(p_name) IS NOT NULL AS named,
  substr(sha256('global:' || p_name), 1, 16) AS disc FROM part""")
def q_names(spark, sf_dir):
    name = F.concat(F.lit("u64Value_"), "p_partkey")
    return inp.table(spark, sf_dir, "part").select(
        "p_partkey", text.snake_case(name).alias("snake"), F.col("p_name").isNotNull().alias("named"),
        text.discriminator(text.INSTRUCTION_SPACE, F.col("p_name")).alias("disc"))


# -- streaming -----------------------------------------------------------

_NOTICES_SQL = """WITH n AS (SELECT DISTINCT event_id - event_id % 3 AS first FROM events
  WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) <> 0)"""


def _notifications(spark, sf_dir) -> DataFrame:
    """Event files as a stream of notifications."""
    schema = inp.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    return inp.event_notifications(events)


@register(f"{_NOTICES_SQL} SELECT 'tx' || first AS signature FROM n")
def q_stream_dedupe(spark, sf_dir):
    target, state = shared_folder(spark, "dedupe"), shared_folder(spark, "dedupe-state")
    live = rt.dedupe(rt.well_formed(_notifications(spark, sf_dir)), "1 day").select("signature")
    live.writeStream.option("checkpointLocation", state).option("path", target).format("parquet").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema("signature string").parquet(target)


@register("""SELECT event_id AS slot, 'malformed_notification' AS reason FROM events
WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 0""")
def q_malformed(spark, sf_dir):
    notices = inp.event_notifications(inp.table(spark, sf_dir, "events"))
    return rt.malformed(notices).select("slot", "reason")


@register(f"""{_NOTICES_SQL}, d AS ({_LEDGER_SQL})
SELECT * FROM d WHERE slot IN (SELECT first FROM n)""")
def q_stream_ingest(spark, sf_dir):
    """Notifications through the live path, read back from committed tables."""
    store = _new_store(spark, "live")
    rt.follow(
        store, _notifications(spark, sf_dir), lambda: inp.event_transactions(spark, sf_dir), None, "live",
        shared_folder(spark, "live-state"), trigger={"availableNow": True},
        on_error="quarantine",
    ).awaitTermination()
    rows = [_ledger_columns(store.instruction(n), n) for n in store.program.instructions]
    return reduce(DataFrame.unionAll, rows)


def _late_store(spark, sf_dir) -> st.Store:
    """Every event announced, the newest half first: the second batch is late as a whole.

    The errors were committed by a backfill before, so live and backfill overlap.
    """
    events, landing = inp.table(spark, sf_dir, "events"), shared_folder(spark, "notices")
    middle = events.agg(F.max("event_id")).first()[0] // 2
    for part, rows in enumerate((events.where(F.col("event_id") > middle), events.where(F.col("event_id") <= middle))):
        inp.own_notifications(rows).coalesce(1).write.parquet(f"{landing}/part={part}")
    store = _new_store(spark, "late")
    done = events.where("event_type = 'error'").select(F.concat(F.lit("tx"), "event_id").alias("signature"))
    replies = _landed_replies(spark, sf_dir)
    ingest(store, replies.join(done, "signature", "left_semi"), None, "before", contiguous=False, on_error="quarantine")
    for part in range(2):
        notices = readers.stream_notifications(spark, f"{landing}/part={part}", "parquet")
        rt.follow(
            store, notices, lambda: replies, None, f"live-{part}", shared_folder(spark, "late-state"),
            trigger={"availableNow": True}, on_error="quarantine",
        ).awaitTermination()
    return store


@register(_LEDGER_SQL)
def q_stream_late(spark, sf_dir):
    """Late notices are processed, and overlap with a backfill stores no row twice."""
    return _store_rows(_late_store(spark, sf_dir))


@register(f"{EVENTS_SQL} SELECT slot, 'malformed_notification' AS reason FROM e WHERE k = 0")
def q_stream_malformed(spark, sf_dir):
    """Malformed notices as committed rejects."""
    return _late_store(spark, sf_dir).table("_rejects").where("reason = 'malformed_notification'").select("slot", "reason")
