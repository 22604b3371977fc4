"""Schemas derived from program interfaces.

Two forms of one rule: `catalog_columns` derives the tables of a whole directory
of interfaces as one narrow Spark job, `Program` holds the schema of the single
program a plan is built for (a document of a few kilobytes).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import quad, text, wide
from ledgerloom.functions.borsh import Layout, defined_name
from ledgerloom.sources import schemas
from ledgerloom.sources.readers import read_idl

# Storage type of each interface primitive, and base columns.
SQL_TYPES = {
    "bool": "BOOLEAN",
    "u8": "SMALLINT", "i8": "SMALLINT",
    "u16": "SMALLINT", "i16": "SMALLINT",
    "u32": "INTEGER", "i32": "INTEGER",
    "u64": "BIGINT", "i64": "BIGINT",
    "u128": "NUMERIC(39,0)", "i128": "NUMERIC(39,0)",
    "u256": "NUMERIC(78,0)", "i256": "NUMERIC(78,0)",
    "f32": "REAL", "f64": "DOUBLE PRECISION",
    "string": "TEXT", "pubkey": "VARCHAR(44)", "bytes": "BYTEA",
}
NESTED_TYPE = "JSONB"
PLAIN_ENUM_TYPE = "TEXT"
NUMERIC_TYPES = ["SMALLINT", "INTEGER", "BIGINT", "REAL", "DOUBLE PRECISION", "NUMERIC(39,0)", "NUMERIC(78,0)"]
SCALAR_TYPES = ["BOOLEAN", "TEXT", "VARCHAR(44)"]

# Spark types wide enough for every value; the unsigned ones are one size up.
SPARK_TYPES = {
    "bool": T.BooleanType(),
    "u8": T.ShortType(), "i8": T.ShortType(), "i16": T.ShortType(),
    "u16": T.IntegerType(), "i32": T.IntegerType(),
    "u32": T.LongType(), "i64": T.LongType(),
    "u64": T.DecimalType(20, 0),
    "u128": wide.WIDE, "i128": wide.WIDE,
    "u256": quad.QUAD, "i256": quad.QUAD,
    "f32": T.FloatType(), "f64": T.DoubleType(),
    "string": T.StringType(), "pubkey": T.StringType(), "bytes": T.BinaryType(),
}

# Columns with a leading underscore give a row its place and identity; a derived
# name never starts with one, so they cannot meet an argument.
INSTRUCTION_BASE = [
    T.StructField("slot", T.LongType(), False),
    T.StructField("_tx_pos", T.LongType(), True),
    T.StructField("_ix_ordinal", T.IntegerType(), False),
    T.StructField("tx_signature", T.StringType(), False),
    T.StructField("signer", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), True),
]
ACCOUNT_BASE = [
    T.StructField("pubkey", T.StringType(), False),
    T.StructField("slot", T.LongType(), False),
    T.StructField("_tx_signature", T.StringType(), False),
    T.StructField("updated_at", T.TimestampType(), True),
]


# -- one program ---------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """One argument or account field."""

    name: str
    column: str
    kind: object
    sql_type: str
    nullable: bool
    spark_type: T.DataType

    @property
    def filter_kind(self) -> str:
        if self.sql_type in NUMERIC_TYPES:
            return "numeric"
        return "scalar" if self.sql_type in SCALAR_TYPES else "unsupported"


def _unwrap(kind):
    nullable = False
    while isinstance(kind, dict) and "option" in kind:
        kind, nullable = kind["option"], True
    return kind, nullable


def column_type(kind, types: dict[str, dict]) -> tuple[str, bool]:
    """(storage type, nullable) of an interface type."""
    kind, nullable = _unwrap(kind)
    if isinstance(kind, str):
        return SQL_TYPES.get(kind, NESTED_TYPE), nullable
    if "vec" not in kind and "array" not in kind and "defined" in kind:
        body = types.get(defined_name(kind), {})
        if body.get("kind") == "enum" and not any(v.get("fields") for v in body["variants"]):
            return PLAIN_ENUM_TYPE, nullable
    return NESTED_TYPE, nullable


@dataclass
class Program:
    """Tables of one program: instruction arguments, account fields, type definitions."""

    program_id: str
    types: dict[str, dict]
    instructions: dict[str, list[Field]]
    accounts: dict[str, list[Field]]
    account_names: list[str] = field(default_factory=list)
    #: (first slot, interface) of each version, oldest first; empty if there is but one.
    versions: list[tuple[int | None, Program]] = field(default_factory=list)

    @classmethod
    def merged(cls, versions: list[tuple[int | None, Program]]) -> Program:
        """Several versions of one interface as one, with tables wide enough for all of them.

        A version is in force from its first slot to the next version's; the one without
        a first slot comes before all others. A column that a version lacks is nullable,
        and a type may only grow (see `WIDER`).
        """
        versions = sorted(versions, key=lambda v: (v[0] is not None, v[0] or 0))
        parts = [p for _, p in versions]
        if len({p.program_id for p in parts}) != 1:
            raise ValueError("Versions must be of one program")
        if len({first for first, _ in versions}) != len(versions):
            raise ValueError("Two versions begin at the same slot")
        names = list(dict.fromkeys(n for p in parts for n in p.account_names))
        return cls(
            parts[-1].program_id, parts[-1].types,
            _merged_tables([p.instructions for p in parts], "ix"), _merged_tables([p.accounts for p in parts], "acct"),
            names, versions if len(versions) > 1 else [],
        )

    def in_force(self) -> list[tuple[int | None, int | None, Program]]:
        """(first slot, slot before which it ends, interface) of each version."""
        if not self.versions:
            return [(None, None, self)]
        ends = [first for first, _ in self.versions[1:]] + [None]
        # Slots before the first version belong to it.
        return [(first if k else None, end, p) for k, ((first, p), end) in enumerate(zip(self.versions, ends, strict=True))]

    @classmethod
    def from_idl(cls, document: str | dict) -> Program:
        if isinstance(document, str):
            try:
                document = json.loads(document)
            except ValueError as error:
                raise ValueError(f"Failed to parse IDL JSON: {error}") from error
        if not document.get("address"):
            raise ValueError("IDL has no program address")
        # A definition keeps the type parameters that stand beside it.
        types = {
            t["name"]: t["type"] | ({"generics": t["generics"]} if t.get("generics") else {})
            for t in document.get("types") or []
        }
        accounts = {}
        for account in document.get("accounts") or []:
            body = types.get(account["name"])
            if body and body["kind"] == "struct":
                named = [f for f in body.get("fields") or [] if isinstance(f, dict) and "name" in f]
                accounts[account["name"]] = cls._fields(named, types, ACCOUNT_BASE)
        instructions = {
            ix["name"]: cls._fields(ix.get("args") or [], types, INSTRUCTION_BASE)
            for ix in document["instructions"]
        }
        names = [a["name"] for a in document.get("accounts") or []]
        return cls(document["address"], types, instructions, accounts, names)

    @staticmethod
    def _fields(members, types, base) -> list[Field]:
        out, taken = [], {f.name for f in base}
        for member in members:
            column = text.snake_name(member["name"])
            if column in taken:
                raise ValueError(f"Column '{column}' of '{member['name']}' is already in use")
            taken.add(column)
            sql_type, nullable = column_type(member["type"], types)
            inner, _ = _unwrap(member["type"])
            spark = SPARK_TYPES.get(inner) if isinstance(inner, str) else None
            out.append(
                Field(member["name"], column, member["type"], sql_type, nullable,
                      spark or T.StringType())
            )
        return out

    @property
    def layout(self) -> Layout:
        return Layout(self.types)

    def instruction_table(self, name: str) -> str:
        return f"ix_{text.snake_name(name)}"

    def account_table(self, name: str) -> str:
        return f"acct_{text.snake_name(name)}"

    def instruction_schema(self, name: str) -> T.StructType:
        return _schema(INSTRUCTION_BASE, self.instructions[name])

    def account_schema(self, name: str) -> T.StructType:
        if name not in self.account_names:
            raise ValueError(f"Account {name} is missing from IDL")
        if name not in self.types:
            raise ValueError(f"Account type {name} is missing from IDL types")
        if name not in self.accounts:
            raise ValueError(f"Account {name} is not a struct")
        return _schema(ACCOUNT_BASE, self.accounts[name])

    def discriminators(self, spark: SparkSession) -> DataFrame:
        """(disc, name) of every instruction; as many rows as the interface lists."""
        return _discriminators(spark, list(self.instructions), text.INSTRUCTION_SPACE)

    def account_discriminators(self, spark: SparkSession) -> DataFrame:
        """(disc, name) of every account, also of those that get no table."""
        return _discriminators(spark, self.account_names, text.ACCOUNT_SPACE)


# Types a column may grow through from one version to the next.
WIDER = [
    [T.ShortType(), T.IntegerType(), T.LongType(), T.DecimalType(20, 0)],
    [T.FloatType(), T.DoubleType()],
]


def _wider(one: Field, other: Field) -> Field | None:
    """The field whose type holds the values of both."""
    if one.spark_type == other.spark_type:
        return other
    for chain in WIDER:
        if one.spark_type in chain and other.spark_type in chain:
            return max(one, other, key=lambda f: chain.index(f.spark_type))
    return None


def _merged_tables(tables: list[dict[str, list[Field]]], prefix: str) -> dict[str, list[Field]]:
    out = {}
    for name in dict.fromkeys(n for t in tables for n in t):
        own = [t[name] for t in tables if name in t]
        merged: dict[str, Field] = {}
        for fields in own:
            for f in fields:
                held = merged.get(f.column, f)
                wide_enough = _wider(held, f)
                if wide_enough is None:
                    change = f"{held.spark_type.simpleString()} -> {f.spark_type.simpleString()}"
                    raise ValueError(f"The interface changed stored columns: {prefix}_{text.snake_name(name)}.{f.column}: {change}")
                merged[f.column] = replace(wide_enough, nullable=held.nullable or f.nullable)
        everywhere = set.intersection(*({f.column for f in fields} for fields in own))
        out[name] = [f if f.column in everywhere else replace(f, nullable=True) for f in merged.values()]
    return out


def widened(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of one version in the columns of all: grown types, and nulls for what it lacks."""
    have = {f.name: f.dataType for f in rows.schema.fields}
    columns = []
    for f in schema.fields:
        if f.name not in have:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            columns.append(F.col(f.name) if have[f.name] == f.dataType else F.col(f.name).cast(f.dataType).alias(f.name))
    return rows.select(*columns)


def _schema(base, fields) -> T.StructType:
    return T.StructType(base + [T.StructField(f.column, f.spark_type, f.nullable) for f in fields])


def _discriminators(spark, names, space) -> DataFrame:
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    return frame.select(text.discriminator(space, F.col("name")).alias("disc"), "name")


def load_program(spark: SparkSession, path: str) -> Program:
    """Read the one interface document a run is built for."""
    rows = read_idl(spark, path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"Failed to read IDL at {path}: expected one document")
    if rows[0]["idl_error"]:
        raise ValueError(f"{rows[0]['idl_error']} at {path}")
    return Program.from_idl(rows[0]["idl"])


# -- a directory of interfaces ------------------------------------------


def _last(types: Column, name: Column) -> Column:
    """Definition of a named type; the last one wins."""
    return F.try_element_at(F.filter(types, lambda t: t["name"] == name), F.lit(-1))["type"]


def _type_columns(types: Column, kind: Column) -> tuple[Column, Column, Column]:
    """(type without options, storage type, nullable) of interface type text."""
    wrap = '{"option":'
    prefix = F.regexp_extract(kind, r'^(\{"option":)*', 0)
    depth = (F.length(prefix) / len(wrap)).cast("int")
    inner = F.btrim(
        F.substring(kind, F.length(prefix) + 1, F.length(kind) - F.length(prefix) - depth),
        F.lit('"'),
    )
    primitive = F.element_at(F.create_map(*(F.lit(x) for p in SQL_TYPES.items() for x in p)), inner)
    name = F.coalesce(
        F.get_json_object(inner, "$.defined.name"), F.get_json_object(inner, "$.defined")
    )
    body = _last(types, name)
    plain = (body["kind"] == "enum") & ~F.exists(
        body["variants"], lambda v: F.coalesce(v["fields"], F.lit("[]")) != "[]"
    )
    nested = F.when(inner.startswith('{"defined":') & plain, PLAIN_ENUM_TYPE).otherwise(NESTED_TYPE)
    sql_type = F.when(inner.startswith("{"), nested).otherwise(
        F.coalesce(primitive, F.lit(NESTED_TYPE))
    )
    return inner, sql_type, depth > 0


def _described(rows: DataFrame, kind: str, prefix: str) -> DataFrame:
    _, sql_type, nullable = _type_columns(F.col("types"), F.col("idl_type"))
    held = F.col("field").isNotNull()
    table = F.concat(F.lit(prefix), text.snake_case(F.col("object")))
    return rows.select(
        "program_id",
        F.lit(kind).alias("kind"),
        "object",
        table.alias("table_name"),
        "ordinal",
        "field",
        text.snake_case(F.col("field")).alias("column_name"),
        F.when(held, F.col("idl_type")).alias("idl_type"),
        F.when(held, sql_type).alias("sql_type"),
        F.when(held, nullable).alias("nullable"),
        F.when(sql_type.isin(NUMERIC_TYPES) & held, "numeric")
        .when(sql_type.isin(SCALAR_TYPES) & held, "scalar")
        .when(held, "unsupported")
        .alias("filter_kind"),
    )


def parsed(idls: DataFrame) -> DataFrame:
    """Interface documents of a column `idl` with their parts as typed columns."""
    doc = F.from_json("idl", schemas.IDL)
    return idls.select(doc.alias("doc")).select(
        F.col("doc.address").alias("program_id"), "doc.instructions", "doc.accounts", "doc.types"
    )


def catalog_columns(idls: DataFrame) -> DataFrame:
    """One row per column of every table; tables without columns keep one row.

    Narrow: a document's type definitions travel with the row until its types are
    resolved, so there is no join and no shuffle whatever the number of documents.
    """
    docs = parsed(idls)
    instructions = (
        docs.select("program_id", "types", F.explode("instructions").alias("ix"))
        .select("program_id", "types", F.col("ix.name").alias("object"),
                F.posexplode_outer("ix.args").alias("ordinal", "arg"))
        .select("program_id", "types", "object", "ordinal",
                F.col("arg.name").alias("field"), F.col("arg.type").alias("idl_type"))
    )
    members = F.from_json(F.col("body.fields"), "array<string>")
    accounts = (
        docs.select("program_id", "types", F.explode("accounts").alias("account"))
        .select("program_id", "types", F.col("account.name").alias("object"),
                _last(F.col("types"), F.col("account.name")).alias("body"))
        .where(F.col("body.kind") == "struct")
        .select("program_id", "types", "object",
                F.filter(F.coalesce(members, F.array()),
                         lambda m: F.get_json_object(m, "$.name").isNotNull()).alias("members"))
        .select("program_id", "types", "object",
                F.posexplode_outer("members").alias("ordinal", "member"))
        .select("program_id", "types", "object", "ordinal",
                F.get_json_object("member", "$.name").alias("field"),
                F.get_json_object("member", "$.type").alias("idl_type"))
    )
    return _described(instructions, "instruction", "ix_").unionByName(
        _described(accounts, "account", "acct_")
    )


def instruction_discriminators(idls: DataFrame) -> DataFrame:
    """(program_id, disc, name) for the instructions of every document."""
    names = parsed(idls).select("program_id", F.explode("instructions.name").alias("name"))
    return names.select(
        "program_id", text.discriminator(text.INSTRUCTION_SPACE, F.col("name")).alias("disc"), "name"
    )


def account_discriminators(idls: DataFrame) -> DataFrame:
    names = parsed(idls).select("program_id", F.explode("accounts.name").alias("name"))
    return names.select(
        "program_id", text.discriminator(text.ACCOUNT_SPACE, F.col("name")).alias("disc"), "name"
    )


def schema_drift(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Columns that two catalogs do not agree on, with the change each one means."""
    key = ["program_id", "kind", "object", "field"]
    side = lambda frame, tag: frame.where("field IS NOT NULL").select(
        *key, F.struct("sql_type", "nullable").alias(tag)
    )
    both = side(current, "now").join(side(stored, "was"), key, "full_outer")
    change = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("now").isNull(), "removed")
        .when(F.col("now.sql_type") != F.col("was.sql_type"), "type")
        .when(F.col("now.nullable") != F.col("was.nullable"), "nullability")
    )
    return (
        both.withColumn("change", change)
        .where("change IS NOT NULL")
        .select(*key, "change", F.col("was.sql_type").alias("was_type"),
                F.col("now.sql_type").alias("now_type"))
    )
