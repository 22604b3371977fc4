"""Account states: lining up replies, ownership, decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.catalog import Program
from ledgerloom.operators.instructions import decode_fields, payload_discriminator

# Fixed value: the only account encoding that is decoded.
ENCODING = "base64"


def account_states(infos: DataFrame) -> DataFrame:
    """One row per requested account that came back: keys and replies by position."""
    return infos.select(
        "tx_signature", F.inline(F.arrays_zip(F.col("pubkeys").alias("pubkey"), F.col("value").alias("info")))
    ).where("info IS NOT NULL").select("tx_signature", "pubkey", "info.owner", "info.data")


def owned_accounts(states: DataFrame, program_id: str) -> DataFrame:
    """States owned by the program; others are left out without a reject."""
    return states.where(F.col("owner") == program_id)


def account_bytes(states: DataFrame) -> DataFrame:
    """Add `payload`; it is null when the reply is not a base64 pair."""
    pair = F.from_json("data", "array<string>")
    payload = F.when(
        F.get(pair, F.lit(1)) == ENCODING, F.try_to_binary(F.get(pair, F.lit(0)), F.lit("base64"))
    )
    return states.withColumn("payload", payload)


def touched_states(writable: DataFrame, states: DataFrame) -> DataFrame:
    """States of exactly the accounts a transaction may write, with its slot."""
    return writable.join(states, ["tx_signature", "pubkey"])


def match_accounts(states: DataFrame, program: Program) -> DataFrame:
    """Add `disc` and `account`; the lookup has one row per account of one interface."""
    names = program.account_discriminators(states.sparkSession).withColumnRenamed("name", "account")
    keyed = states.withColumn("disc", payload_discriminator(F.col("payload")))
    return keyed.join(F.broadcast(names), "disc", "left")


def decode_accounts(
    matched: DataFrame, program: Program, name: str, enum_text: str = "object"
) -> DataFrame:
    """Snapshot rows of one account table. A state that cannot be decoded is never
    fatal; `account_rejects` lists it."""
    program.account_schema(name)
    own = matched.where(F.col("account") == name)
    frame, values, whole = decode_fields(own, program, program.accounts[name], enum_text=enum_text)
    updated = F.col("updated_at") if "updated_at" in frame.columns else F.current_timestamp()
    return frame.where(whole).select(
        "pubkey", "slot", F.col("tx_signature").alias("_tx_signature"),
        updated.alias("updated_at"), *values,
    )


def _reject(frame: DataFrame, reason: str, detail: Column) -> DataFrame:
    return frame.select(
        "slot", "tx_signature", F.lit(reason).alias("reason"), detail.alias("detail")
    )


def unmatched_accounts(matched: DataFrame) -> DataFrame:
    """Owned states with another encoding, or with no known discriminator."""
    reason = F.when(F.col("payload").isNull(), "bad_encoding").otherwise("unknown_discriminator")
    return matched.where("account IS NULL").select(
        "slot", "tx_signature", reason.alias("reason"), F.col("pubkey").alias("detail")
    )


def account_rejects(matched: DataFrame, program: Program, name: str) -> DataFrame:
    """States of one account type that are shorter than its layout, or that have no table."""
    own = matched.where(F.col("account") == name)
    if name not in program.accounts:
        return _reject(own, "no_account_table", F.col("pubkey"))
    frame, _, whole = decode_fields(own, program, program.accounts[name])
    return _reject(frame.where(~whole), "decode_error", F.col("pubkey"))
