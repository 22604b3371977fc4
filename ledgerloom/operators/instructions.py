"""Matching and decoding instruction payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.base58 import base58_to_bytes
from ledgerloom.functions.borsh import At
from ledgerloom.functions.text import DISCRIMINATOR_BYTES
from ledgerloom.operators.catalog import Field, Program

ON_ERROR = ("fail", "quarantine")


def payload_discriminator(payload: Column) -> Column:
    """Hex of the leading bytes; shorter payloads give shorter text and never match."""
    return F.lower(F.hex(F.substring(payload, 1, DISCRIMINATOR_BYTES)))


def match_instructions(flat: DataFrame, program: Program, on_error: str = "quarantine") -> DataFrame:
    """Add `payload`, `disc` and `instruction` (null when no discriminator matches).

    Text that is no base58 fails the job with on_error='fail'; else its payload is
    null, and `unknown_instructions` tells it from an unknown discriminator.

    The base58 step is the only Python in the path. The lookup table has one row
    per instruction of a single interface, which bounds the broadcast.
    """
    decoded = flat.withColumn("payload", base58_to_bytes("data"))
    if on_error == "fail":
        message = F.concat(F.lit("Instruction data is not base58 in transaction "), F.col("tx_signature"))
        bad = F.col("data").isNotNull() & F.col("payload").isNull()
        decoded = decoded.withColumn("payload", F.when(bad, F.raise_error(message)).otherwise(F.col("payload")))
    return match_payloads(decoded, program)


def match_payloads(rows: DataFrame, program: Program) -> DataFrame:
    """Add `disc` and `instruction` to rows whose payload is decoded already."""
    names = program.discriminators(rows.sparkSession).withColumnRenamed("name", "instruction")
    keyed = rows.withColumn("disc", payload_discriminator(F.col("payload")))
    return keyed.join(F.broadcast(names), "disc", "left")


PLACED = ("slot", "tx_signature", "tx_pos", "ix_ordinal", "signer")


def unknown_payloads(matched: DataFrame) -> DataFrame:
    """Payloads without a known instruction, with their place, so that they can be tried again."""
    reason = F.when(F.col("payload").isNull(), "bad_encoding").otherwise("unknown_discriminator")
    return matched.where("instruction IS NULL").select(
        *PLACED, reason.alias("reason"), F.col("disc").alias("detail"), "payload"
    )


def short_payloads(matched: DataFrame, program: Program, name: str) -> DataFrame:
    """Payloads of one instruction that are shorter than its layout, with their place."""
    frame, whole = whole_payloads(matched, program, name)
    return frame.where(~whole).select(
        *PLACED, F.lit("decode_error").alias("reason"), F.lit(name).alias("detail"), "payload"
    )


def whole_payloads(matched: DataFrame, program: Program, name: str) -> tuple[DataFrame, Column]:
    """Payloads of one instruction, and the condition that they hold all of its arguments."""
    own = matched.where(F.col("instruction") == name)
    frame, _, whole = decode_fields(own, program, program.instructions[name])
    return frame, whole


def decode_fields(
    frame: DataFrame,
    program: Program,
    fields: list[Field],
    payload: str = "payload",
    enum_text: str = "object",
) -> tuple[DataFrame, list[Column], Column]:
    """Values of a record that follows the discriminator.

    Returns the frame with helper columns, one value Column per field, and the
    condition that the payload held all of them. Offsets of variable-size fields
    become columns, so later fields refer to them instead of repeating them. Bytes
    after the last field are ignored.
    """
    layout = program.layout
    at, values = At(plus=DISCRIMINATOR_BYTES), []
    for i, field in enumerate(fields):
        values.append(_value(layout, field, payload, at, enum_text).alias(field.column))
        size = layout.width(field.kind)
        if size is not None:
            at = at + size
        else:
            frame = frame.withColumn(f"_end{i}", F.expr(layout.advance(field.kind, payload, at)))
            at = At(f"_end{i}")
    # A filter on the offsets would be pushed below them and repeat every one; the
    # outer explode of one or no element lets nothing through.
    whole = F.expr(f"explode_outer(IF(coalesce({at} <= length({payload}), false), array(true), array()))")
    return frame.select("*", whole.alias("_whole")), values, F.col("_whole").isNotNull()


def _value(layout, field: Field, payload: str, at: At, enum_text: str) -> Column:
    value = layout.column(field.kind, payload, at)
    if field.sql_type == "TEXT" and isinstance(field.kind, dict) and enum_text == "name":
        # A text column of another kind holds no object and keeps its value.
        return F.coalesce(F.get(F.json_object_keys(value), F.lit(0)), value)
    return value


def decode_instructions(
    matched: DataFrame,
    program: Program,
    name: str,
    on_error: str = "fail",
    enum_text: str = "object",
) -> DataFrame:
    """Rows of one instruction table. A payload cut short fails the job, or with
    'quarantine' is left to `decode_rejects`."""
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {', '.join(ON_ERROR)}")
    if name not in program.instructions:
        raise ValueError(f"Instruction {name} is missing from IDL")
    own = matched.where(F.col("instruction") == name)
    frame, values, whole = decode_fields(own, program, program.instructions[name], enum_text=enum_text)
    if on_error == "fail":
        message = F.concat(F.lit(f"Cannot decode {name} in transaction "), F.col("tx_signature"))
        signer = F.when(whole, F.col("signer")).otherwise(F.raise_error(message))
    else:
        frame, signer = frame.where(whole), F.col("signer")
    created = F.col("created_at") if "created_at" in frame.columns else F.current_timestamp()
    return frame.select(
        "slot", F.col("tx_pos").alias("_tx_pos"), F.col("ix_ordinal").alias("_ix_ordinal"),
        "tx_signature", signer.alias("signer"), created.alias("created_at"), *values,
    )


def unknown_instructions(matched: DataFrame) -> DataFrame:
    """Rejects: instructions of the program whose payload matches no discriminator."""
    return unknown_payloads(matched).select("slot", "tx_signature", "reason", "detail")


def decode_rejects(matched: DataFrame, program: Program, name: str) -> DataFrame:
    """Rejects: payloads of one instruction that are shorter than its layout."""
    return short_payloads(matched, program, name).select("slot", "tx_signature", "reason", "detail")
