"""The read queries: filtered list, filtered aggregate, program statistics.

Requests are dictionaries of text as they arrive from a client. They are checked
and bound while the plan is built; what runs is one declarative plan, and the
caller decides whether to collect it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import quad, text, wide
from ledgerloom.operators.catalog import Field, Program
from ledgerloom.sources.tables import Tables

# Limits and names of the request language.
LIMIT_DEFAULT = 50
LIMIT_MAX = 200
METRICS = ("count", "sum", "avg", "min", "max")
OPERATORS = ("eq", "gte", "lte")
ORDERS = ("asc", "desc")
INTEGER_PATTERN = r"-?\d+"
NUMBER_PATTERN = r"-?\d+(\.\d+)?"

_RANGES = {
    T.ShortType(): (-(2**15), 2**15 - 1),
    T.IntegerType(): (-(2**31), 2**31 - 1),
    T.LongType(): (-(2**63), 2**63 - 1),
    T.DecimalType(20, 0): (0, 10**20 - 1),
    wide.WIDE: (-(2**127), 2**128 - 1),
    quad.QUAD: (-(2**255), 2**256 - 1),
}
# Integers kept in limbs, and how they are written.
_LIMBS = {wide.WIDE: wide, quad.QUAD: quad}


class QueryError(ValueError):
    """A rejected request; `status` is 404 for an unknown instruction, else 400."""

    def __init__(self, message: str, status: int = 400):
        super().__init__(message)
        self.status = status


@dataclass(frozen=True)
class ArgFilter:
    name: str
    operator: str
    value: str


# -- reading requests ----------------------------------------------------


def _fields(program: Program, name: str) -> dict[str, Field]:
    if name not in program.instructions:
        raise QueryError(f"Unknown instruction '{name}'", 404)
    return {f.name: f for f in program.instructions[name]}


def _number(value: str) -> float:
    """A number as a JavaScript client writes it; anything else is not a number."""
    value = value.strip()
    prefix = {"0x": 16, "0o": 8, "0b": 2}.get(value[:2].lower())
    try:
        if prefix:
            return int(value[2:], prefix) if re.fullmatch(r"[0-9a-zA-Z]+", value[2:]) else math.nan
        if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", value):
            return 0 if value == "" else math.nan
        return float(value)
    except ValueError:
        return math.nan


def _limit(query: Mapping[str, str]) -> int:
    limit = _number(query["limit"]) if query.get("limit") else LIMIT_DEFAULT
    if not (float(limit).is_integer() and 1 <= limit <= LIMIT_MAX):
        raise QueryError(f"limit must be an integer between 1 and {LIMIT_MAX}")
    return int(limit)


def _ascending(query: Mapping[str, str]) -> bool:
    """Newest first unless told otherwise; an order given as nothing is ascending."""
    order = query.get("order")
    if order and order.lower() not in ORDERS:
        raise QueryError("order must be 'asc' or 'desc'")
    return order is not None and order.lower() != "desc"


def _slot(query: Mapping[str, str], name: str) -> int | None:
    value = query.get(name)
    if not value:
        return None
    if not re.fullmatch(INTEGER_PATTERN, value, re.ASCII):
        raise QueryError(f"{name} must be a valid integer")
    return int(value)


def _arg_filters(query: Mapping[str, str]) -> list[ArgFilter]:
    found = []
    for key, value in query.items():
        if not key.startswith("arg."):
            continue
        name, *rest = key[len("arg."):].split(".")
        if not name or len(rest) > 1:
            raise QueryError(f"Invalid filter '{key}'")
        operator = rest[0] if rest else "eq"
        if operator not in OPERATORS:
            raise QueryError(f"Unsupported operator '{operator}' for filter '{key}'")
        found.append(ArgFilter(name, operator, value))
    return found


# -- binding filters -----------------------------------------------------


def _compare(column: Column, operator: str, value: Column) -> Column:
    return {"eq": column == value, "gte": column >= value, "lte": column <= value}[operator]


def _whole_bound(column: Column, spark_type, operator: str, value: Decimal) -> Column:
    """Compare an integer column with any number, leaving the column uncast.

    A fraction becomes the next whole number on the right side of the comparison;
    a number outside the column's range decides the comparison on its own.
    """
    low, high = _RANGES[spark_type]
    if operator == "eq" and value != value.to_integral_value():
        return F.lit(False)
    bound = math.ceil(value) if operator == "gte" else math.floor(value)
    if bound > high:
        return F.lit(operator == "lte") & column.isNotNull()
    if bound < low:
        return F.lit(operator == "gte") & column.isNotNull()
    if spark_type in _LIMBS:
        return _compare(column, operator, _LIMBS[spark_type].literal(bound))
    return _compare(column, operator, F.lit(Decimal(bound)).cast(spark_type))


def _arg_condition(fields: dict[str, Field], arg: ArgFilter) -> Column:
    found = fields.get(arg.name)
    if found is None:
        raise QueryError(f"Unknown instruction argument '{arg.name}'")
    if found.filter_kind == "unsupported":
        raise QueryError(f"Filtering is not supported for argument '{arg.name}'")
    if found.filter_kind == "scalar" and arg.operator != "eq":
        raise QueryError(f"Only equality filters are supported for argument '{arg.name}'")
    column = F.col(found.column)
    if found.filter_kind == "numeric":
        if not re.fullmatch(NUMBER_PATTERN, arg.value, re.ASCII):
            raise QueryError(f"Argument '{arg.name}' expects a numeric value")
        if found.spark_type in (T.FloatType(), T.DoubleType()):
            return _compare(column, arg.operator, F.lit(arg.value).cast(found.spark_type))
        return _whole_bound(column, found.spark_type, arg.operator, Decimal(arg.value))
    if found.sql_type == "BOOLEAN":
        if arg.value not in ("true", "false"):
            raise QueryError(f"Argument '{arg.name}' expects a boolean value")
        return column == F.lit(arg.value == "true")
    return column == F.lit(arg.value)


def _slot_condition(operator: str, value: int) -> Column:
    return _whole_bound(F.col("slot"), T.LongType(), operator, Decimal(value))


def _conditions(fields: dict[str, Field], query, filters, low, high) -> list[Column]:
    conditions = []
    if query.get("signer"):
        conditions.append(F.col("signer") == query["signer"])
    if query.get("tx_signature"):
        conditions.append(F.col("tx_signature") == query["tx_signature"])
    if low is not None:
        conditions.append(_slot_condition("gte", low))
    if high is not None:
        conditions.append(_slot_condition("lte", high))
    return conditions + [_arg_condition(fields, f) for f in filters]


def _filtered(tables: Tables, name: str, conditions: list[Column], low, high) -> DataFrame:
    frame = tables.instruction(name, low, high)
    for condition in conditions:
        frame = frame.where(condition)
    return frame


# -- list ----------------------------------------------------------------


def as_text(frame: DataFrame) -> DataFrame:
    """Big integers as text, everything else as it is."""
    columns = []
    for field in frame.schema.fields:
        column = F.col(f"`{field.name}`")
        if field.dataType in _LIMBS:
            column = _LIMBS[field.dataType].text(column)
        elif isinstance(field.dataType, (T.LongType, T.DecimalType)):
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return frame.select(*columns)


def list_instructions(
    tables: Tables, program: Program, name: str, query: Mapping[str, str] | None = None
) -> DataFrame:
    """The newest (or oldest) rows of an instruction that pass the filters.

    Sort and limit become one top-k per partition and a merge of those, over the part
    of the slots that the tables find to hold that many rows.
    """
    query = query or {}
    fields = _fields(program, name)
    limit, ascending = _limit(query), _ascending(query)
    filters = _arg_filters(query)
    low, high = _slot(query, "from_slot"), _slot(query, "to_slot")
    conditions = _conditions(fields, query, filters, low, high)
    low, high = tables.nearest(name, low, high, conditions, limit, ascending)
    frame = _filtered(tables, name, conditions, low, high)
    keys = [c for c in ("slot", "_tx_pos", "_ix_ordinal") if c in frame.columns]
    # Feed positions count from the newest entry, so within a slot they run backwards.
    newest = {"_tx_pos": not ascending}
    order = [F.asc(k) if newest.get(k, ascending) else F.desc(k) for k in keys]
    shown = [c for c in frame.columns if not c.startswith("_")]
    return frame.orderBy(*order).limit(limit).select(*shown)


# -- aggregate -----------------------------------------------------------


def _metric(metric: str, fields: dict[str, Field], name: str | None) -> Column:
    """Aggregate expression that yields text."""
    if metric == "count":
        return F.count(F.lit(1)).cast("string")
    if not name:
        raise QueryError("field is required for sum, avg, min, and max metrics")
    found = fields.get(name)
    if found is None:
        raise QueryError(f"Unknown instruction argument '{name}'")
    if found.filter_kind != "numeric":
        raise QueryError(f"Metric '{metric}' requires a numeric argument")
    column = F.col(found.column)
    if found.spark_type in (T.FloatType(), T.DoubleType()):
        return _float_metric(metric, column, found)
    if metric in ("min", "max"):
        best = F.min(column) if metric == "min" else F.max(column)
        return _LIMBS[found.spark_type].text(best) if found.spark_type in _LIMBS else best.cast("string")
    if found.spark_type == wide.WIDE:
        hi, lo = wide.sums(column)
        if metric == "sum":
            return F.coalesce(wide.pair_text(hi, lo), F.lit("0"))
        return text.quotient_text(*wide.magnitude(hi, lo), F.nullif(F.count(column), F.lit(0)))
    if found.spark_type == quad.QUAD:
        total = quad.sums(column)
        if metric == "sum":
            return F.coalesce(quad.limbs_text(total), F.lit("0"))
        return quad.quotient_text(total, F.nullif(F.count(column), F.lit(0)))
    # Summed as decimals: a sum of bigints would overflow.
    total = F.sum(column.cast("decimal(20,0)"))
    if metric == "sum":
        return F.coalesce(total.cast("string"), F.lit("0"))
    size = F.abs(total)
    high, low = wide.int_div(size, wide.dec(wide.BASE)), size % wide.dec(wide.BASE)
    return text.quotient_text(total < 0, high, low, F.nullif(F.count(column), F.lit(0)))


def _float_metric(metric: str, column: Column, found: Field) -> Column:
    kind = "float" if found.spark_type == T.FloatType() else "double"
    if metric == "avg":
        return text.float_text(F.avg(column))
    best = {"sum": F.sum, "min": F.min, "max": F.max}[metric](column).cast(kind)
    shown = text.float_text(best, kind)
    return F.coalesce(shown, F.lit("0")) if metric == "sum" else shown


def aggregate(
    tables: Tables,
    program: Program,
    name: str,
    query: Mapping[str, str] | None = None,
    numeric_order: bool = False,
) -> DataFrame:
    """One `value` over the filtered rows, or one per signer.

    Groups are ordered by the text of the value, null first, then by signer;
    numeric_order=True orders by the number instead.
    """
    query = query or {}
    fields = _fields(program, name)
    metric = (query.get("metric") or "").lower()
    if metric not in METRICS:
        raise QueryError("metric must be one of count, sum, avg, min, max")
    group_by = query.get("group_by")
    if group_by and group_by != "signer":
        raise QueryError("group_by must be 'signer'")
    filters = _arg_filters(query)
    low, high = _slot(query, "from_slot"), _slot(query, "to_slot")
    frame = _filtered(tables, name, _conditions(fields, query, filters, low, high), low, high)
    value = _metric(metric, fields, query.get("field")).alias("value")
    if not group_by:
        return frame.agg(value)
    keys = [F.desc_nulls_first("value")]
    if numeric_order:
        field = fields.get(query.get("field"))
        is_float = metric != "count" and field.spark_type in (T.FloatType(), T.DoubleType())
        keys = [F.col("value").cast("double").desc_nulls_first()] if is_float else _greatest_first(F.col("value"))
    return frame.groupBy("signer").agg(value).orderBy(*keys, F.asc("signer"))


def _greatest_first(value: Column) -> list[Column]:
    """Order of plain decimal texts by number, exact at any length; null first."""
    negative = value.startswith("-")
    digits = F.ltrim(value, F.lit("-"))
    size = F.length(F.split_part(digits, F.lit("."), F.lit(1)))
    return [
        value.isNull().desc(), negative.asc(), F.when(negative, -size).otherwise(size).desc(),
        F.when(~negative, digits).desc(), F.when(negative, digits).asc(),
    ]


def envelope(result: DataFrame, program: Program, name: str, query: Mapping[str, str]) -> DataFrame:
    """A result with the request it answers as leading columns."""
    head = [F.lit(name).alias("instruction"), F.lit(program.program_id).alias("program_id")]
    if query.get("metric"):
        head.append(F.lit(query["metric"].lower()).alias("metric"))
    if query.get("group_by"):
        head.append(F.lit(query["group_by"]).alias("group_by"))
    return result.select(*head, *result.columns)


# -- statistics ----------------------------------------------------------


def _per_signer(tables: Tables, program: Program) -> DataFrame:
    """Counts per (instruction, signer): the one pass both statistics build on. Tables that
    keep such counts are not read themselves."""
    kept = tables.signer_counts(program)
    if kept is not None:
        return kept
    return (
        tables.signers(program)
        .groupBy("instruction", "signer")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("slot").alias("latest"))
    )


def instruction_stats(tables: Tables, program: Program) -> DataFrame:
    """Rows, unique signers and latest slot of every instruction, also of empty ones."""
    names = tables.spark.createDataFrame([(n,) for n in program.instructions], "instruction string")
    found = (
        _per_signer(tables, program)
        .groupBy("instruction")
        .agg(F.sum("rows").alias("rows"), F.count("signer").alias("signers"),
             F.max("latest").alias("latest"))
    )
    # At most one row per instruction of the interface on either side.
    return names.join(F.broadcast(found), "instruction", "left").select(
        "instruction",
        F.coalesce("rows", F.lit(0)).cast("string").alias("count"),
        F.coalesce("signers", F.lit(0)).cast("string").alias("unique_signers"),
        F.col("latest").cast("string").alias("latest_slot"),
    )


def program_stats(tables: Tables, program: Program) -> DataFrame:
    """One row: total instructions, unique signers, latest slot of the program."""
    per_signer = (
        _per_signer(tables, program)
        .groupBy("signer")
        .agg(F.sum("rows").alias("rows"), F.max("latest").alias("latest"))
    )
    return per_signer.agg(
        F.lit(program.program_id).alias("program_id"),
        F.coalesce(F.sum("rows"), F.lit(0)).cast("string").alias("total_instructions"),
        F.count("signer").cast("string").alias("unique_signers"),
        F.max("latest").cast("string").alias("latest_indexed_slot"),
    )
