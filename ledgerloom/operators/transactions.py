"""From landed transactions to the instructions of a program.

Everything here is a narrow expression over one transaction row: no shuffle and
no Python. Account lists are worked out before instructions are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRINGS = "array<string>"
_INSTRUCTION = "struct<programIdIndex:int,accounts:array<int>,data:string>"
_INSTRUCTIONS = f"array<{_INSTRUCTION}>"


def _or_empty(column: str, kind: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast(kind))


def static_keys() -> Column:
    return _or_empty("transaction.message.accountKeys", _STRINGS)


def loaded_writable() -> Column:
    return _or_empty("meta.loadedAddresses.writable", _STRINGS)


def account_keys() -> Column:
    """Static keys, then loaded writable, then loaded read-only ones."""
    return F.concat(static_keys(), loaded_writable(),
                    _or_empty("meta.loadedAddresses.readonly", _STRINGS))


def all_instructions() -> Column:
    """Top-level instructions, then every inner group in turn.

    Taking the field of all groups at once needs no lambda; only a reply with a
    group that lacks its list takes the second form.
    """
    groups = F.col("meta.innerInstructions.instructions")
    inner = F.coalesce(
        F.flatten(groups), F.flatten(F.array_compact(groups)), F.array().cast(_INSTRUCTIONS)
    )
    return F.concat(_or_empty("transaction.message.instructions", _INSTRUCTIONS), inner)


def has_signer() -> Column:
    # An empty key counts as none.
    return F.coalesce(F.get(F.col("transaction.message.accountKeys"), F.lit(0)), F.lit("")) != ""


def signer(on_error: str = "fail") -> Column:
    """The first static key. Without one the job fails, or the value is null."""
    first = F.get(F.col("transaction.message.accountKeys"), F.lit(0))
    if on_error != "fail":
        return F.when(has_signer(), first)
    message = F.concat(F.lit("Missing signer for transaction "), F.col("signature"))
    return F.when(has_signer(), first).otherwise(F.raise_error(message))


def writable_by_index(
    keys: Column, header: Column, static_count: Column, loaded: Column
) -> Column:
    """The account keys with null where the message header makes one read-only.

    Static keys are signers then others, and the last ones of either part are
    read-only; of the loaded keys the first `loaded` are writable.
    """
    clamp = lambda value, top: F.least(F.greatest(value, F.lit(0)), top)
    null = F.lit(None).cast("string")
    signers = clamp(header["numRequiredSignatures"], static_count)
    first = clamp(header["numRequiredSignatures"] - header["numReadonlySignedAccounts"], signers)
    others = static_count - signers
    second = clamp(others - header["numReadonlyUnsignedAccounts"], others)
    # More signatures than static keys leave no others, whatever the header says.
    return F.concat(
        F.slice(keys, F.lit(1), first), F.array_repeat(null, signers - first),
        F.slice(keys, signers + 1, second), F.array_repeat(null, others - second),
        F.slice(keys, static_count + 1, loaded),
    )


def with_program_instructions(
    transactions: DataFrame,
    program_id: str,
    include_failed: bool = True,
    on_error: str = "fail",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per transaction: keys, signer and `placed`, its (ordinal, instruction) list of the program.

    The slot is the one of the reply. An instruction whose program index is out of
    range is dropped. With include_failed=False a failed transaction keeps its row
    but no instructions. `keep` names further columns to carry along.
    """
    wanted = F.lit(True) if include_failed else F.col("meta.err").isNull()
    if on_error != "fail":
        wanted = wanted & has_signer()
    # An explode of one element keeps the optimizer from merging the lists into the
    # lambdas that refer to them, where they would be rebuilt once per element.
    apart = F.explode_outer(F.array(F.lit(True))).alias("_apart")
    lists = _lists(transactions, wanted, on_error, keep).select("*", apart)
    numbered = F.transform("every", lambda ix, i: F.struct(i.alias("ordinal"), ix.alias("ix")))
    own = F.filter(
        numbered, lambda p: F.get(F.col("keys"), p["ix"]["programIdIndex"]) == program_id
    )
    return lists.withColumn("placed", own).drop("every", "_apart")


def _lists(transactions: DataFrame, wanted: Column, on_error: str, keep: tuple[str, ...]) -> DataFrame:
    """A transaction's lists as columns: `keys`, the writable ones of them, `every` instruction."""
    keys, static, loaded = account_keys(), F.size(static_keys()), F.size(loaded_writable())
    header = F.col("transaction.message.header")
    return transactions.select(
        "slot",
        F.col("feed_pos").alias("tx_pos"),
        F.col("signature").alias("tx_signature"),
        signer(on_error).alias("signer"),
        keys.alias("keys"),
        writable_by_index(keys, header, static, loaded).alias("writable_keys"),
        F.when(wanted, all_instructions()).otherwise(F.array().cast(_INSTRUCTIONS)).alias("every"),
        *keep,
    )


def explode_program_instructions(
    transactions: DataFrame,
    program_id: str,
    include_failed: bool = True,
    on_error: str = "fail",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The same selection as rows: one per instruction of the program, and one without
    `data` for the first place of every other transaction, so that each is seen once.

    No lambda is involved; the program test runs in generated code after the explode.
    """
    wanted = F.lit(True) if include_failed else F.col("meta.err").isNull()
    if on_error != "fail":
        wanted = wanted & has_signer()
    base = ("slot", "tx_pos", "tx_signature", "signer", *keep)
    exploded = _lists(transactions, wanted, on_error, keep).select(
        *base, "keys", "writable_keys", F.posexplode_outer("every").alias("ix_ordinal", "ix")
    )
    own = F.coalesce(F.get("keys", F.col("ix.programIdIndex")) == program_id, F.lit(False))
    first = F.coalesce(F.col("ix_ordinal"), F.lit(0)) == 0
    return exploded.withColumn("own", own).where(F.col("own") | first).select(
        *base, first.alias("first"), "ix_ordinal",
        F.when(F.col("own"), F.col("ix.data")).alias("data"), "own",
        F.when(F.col("own"), F.transform("ix.accounts", lambda i: F.get(F.col("writable_keys"), i))
               ).alias("writable"),
    )


def flatten_instructions(prepared: DataFrame) -> DataFrame:
    """One row per instruction of the program, with its place in the transaction.

    A plain explode would also be planned as a filter on the list's size below it,
    and the list worked out twice; the outer form is filtered after the fact.
    """
    return prepared.select(
        "slot", "tx_pos", "tx_signature", "signer", F.explode_outer("placed").alias("p")
    ).where("p IS NOT NULL").select(
        "slot", "tx_pos", "tx_signature", "signer",
        F.col("p.ordinal").alias("ix_ordinal"), "p.ix.accounts", "p.ix.data",
    )


def flatten_all_instructions(transactions: DataFrame) -> DataFrame:
    """Every instruction of every program, with the address of its program (null: no key)."""
    return transactions.select(
        "slot",
        F.col("feed_pos").alias("tx_pos"),
        F.col("signature").alias("tx_signature"),
        signer().alias("signer"),
        account_keys().alias("keys"),
        F.posexplode_outer(all_instructions()).alias("ix_ordinal", "ix"),
    ).where("ix IS NOT NULL").select(
        "slot", "tx_pos", "tx_signature", "signer", "ix_ordinal",
        F.get("keys", F.col("ix.programIdIndex")).alias("program_id"),
        F.col("ix.accounts").alias("accounts"), F.col("ix.data").alias("data"),
    )


def filter_programs(flat: DataFrame, programs: DataFrame) -> DataFrame:
    """Instructions of any of the given programs (a frame with `program_id`).

    One program is a plain filter on `program_id`; a list is a semi join whose side
    is left to the planner's size check.
    """
    return flat.join(programs.select("program_id").distinct(), "program_id", "left_semi")


def writable_keys() -> Column:
    """Distinct writable keys of a prepared row's instructions, in first-seen order."""
    lists = F.col("placed.ix.accounts")
    indexes = F.coalesce(F.flatten(lists), F.flatten(F.array_compact(lists)))
    touched = F.transform(indexes, lambda i: F.get(F.col("writable_keys"), i))
    return F.array_distinct(F.filter(touched, lambda key: F.coalesce(key, F.lit("")) != ""))


def writable_accounts(prepared: DataFrame) -> DataFrame:
    """One row per transaction and writable account, numbered in first-seen order."""
    return prepared.select(
        "slot", "tx_signature", F.posexplode_outer(writable_keys()).alias("account_pos", "pubkey")
    ).where("pubkey IS NOT NULL")


def missing_signers(transactions: DataFrame) -> DataFrame:
    return transactions.where(~has_signer()).select(
        "slot", F.col("signature").alias("tx_signature"),
        F.lit("missing_signer").alias("reason"), F.lit(None).cast("string").alias("detail"),
    )


def unresolved_signatures(signatures: DataFrame, transactions: DataFrame) -> DataFrame:
    """Selected signatures whose transaction has not landed; they stay for the next run."""
    return signatures.join(transactions.select("signature"), "signature", "left_anti")
