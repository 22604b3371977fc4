"""From selected transactions to committed tables, as a batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import accounts as acc
from ledgerloom.operators import coverage
from ledgerloom.operators import instructions as ins
from ledgerloom.operators import selection as sel
from ledgerloom.operators import transactions as tx
from ledgerloom.operators.catalog import widened
from ledgerloom.plans.store import Attempt, Store


def compact(
    transactions: DataFrame, program_id: str, include_failed: bool = True, on_error: str = "fail"
) -> DataFrame:
    """What later steps need of each transaction, from one pass over the raw rows."""
    if "feed_slot" not in transactions.columns:
        transactions = transactions.withColumn("feed_slot", F.col("slot"))
    return tx.explode_program_instructions(
        transactions, program_id, include_failed, on_error, keep=("feed_slot",)
    )


def landed(transactions: DataFrame, selected: DataFrame) -> DataFrame:
    """Landed transactions of the selected signatures, each once.

    Both sides meet on the signature, so the duplicates of either side fall to the
    same partition and need no further exchange.
    """
    wanted = selected.groupBy("signature").agg(
        F.max("slot").alias("_feed_slot"), F.max("feed_pos").alias("_feed_pos")
    )
    joined = transactions.join(wanted, "signature")
    placed = joined.withColumns({
        "feed_slot": F.coalesce("_feed_slot", "slot"), "feed_pos": F.coalesce("_feed_pos", "feed_pos"),
    }).drop("_feed_slot", "_feed_pos")
    # Of several replies for one signature the least one counts: first by slot, then by content.
    said = ["slot", *(c for c in placed.columns if c not in ("signature", "slot"))]
    return placed.groupBy("signature").agg(F.min(F.struct(*said)).alias("said")).select(
        *(F.col("signature") if c == "signature" else F.col(f"said.{c}").alias(c) for c in placed.columns)
    )


def resolve(
    transactions: DataFrame, selected: DataFrame, low: int | None, high: int | None, wider: bool = True
) -> DataFrame:
    """Landed transactions of a selection whose own slots are low to high.

    A transaction carries the slot it was announced with, so the range prunes the
    scan, and what it misses inside the range has not landed. Signatures that waited
    since earlier runs are looked for between their own least and greatest slot. Only
    those whose slot nobody knows need a scan without bounds. With `wider` off both
    stay unresolved.
    """
    if low is None or high is None:
        return landed(transactions, selected) if wider else landed(transactions.where("false"), selected)
    inside = F.col("slot").between(low, high)
    found = landed(transactions.where(inside), selected)
    if not wider:
        return found
    elsewhere = selected.where(~F.coalesce(inside, F.lit(False)))
    first, last, unknown = elsewhere.agg(F.min("slot"), F.max("slot"), F.count_if(F.col("slot").isNull())).first()
    if first is None and not unknown:
        return found
    beyond = ~F.coalesce(inside, F.lit(False))
    if not unknown:
        beyond &= F.col("slot").between(first, last)
    return found.unionByName(landed(transactions.where(beyond), elsewhere))


def ingest(
    store: Store,
    transactions: DataFrame,
    infos: DataFrame | None,
    run: str,
    batch_id: int = 0,
    selected: DataFrame | None = None,
    find: Callable[[DataFrame, DataFrame], DataFrame] = landed,
    contiguous: bool = True,
    hold_last_slot: bool = False,
    upto: int | None = None,
    covered: tuple[int | None, int | None] = (None, None),
    more_rejects: DataFrame | None = None,
    on_error: str = "fail",
    include_failed: bool = True,
    enum_text: str = "object",
) -> bool:
    """Process transactions and commit their rows together; False if already committed.

    `selected` (signature, slot, feed_pos) limits the run; without it every given
    transaction is processed. The raw rows are read once: what is needed of them is
    staged, then payloads are staged by instruction, so that each table is decoded
    from its own rows only. With on_error='fail' an instruction that cannot be
    decoded, or a transaction without signer, stops the batch before anything is
    visible; an account state never does.

    `upto` is the end of the range that the run covers without gaps: later slots, of
    signatures tried again, never count for the checkpoint. `covered` is that range as
    the commit states it. `more_rejects` are
    committed with the batch's own.
    """
    if store.is_committed(run, batch_id):
        return False
    program = store.program
    attempt = store.attempt(run, batch_id)
    if selected is not None:
        selected = attempt.stage("selected", selected.select("signature", "slot", "feed_pos"))
        transactions = find(transactions, selected)
    rows = attempt.stage(
        "transactions", compact(transactions, program.program_id, include_failed, on_error)
    )
    # Every slot of this batch is known now, so its folders get their width.
    attempt.reach(rows, "slot", "feed_slot")
    if selected is not None:
        attempt.reach(selected, "slot")
    seen = rows.where("first")
    frames: dict[str, DataFrame] = {
        "_processed": seen.select(
            F.lit(program.program_id).alias("program_id"), "tx_signature", F.col("feed_slot").alias("slot")
        )
    }
    rejects = [
        seen.where("signer IS NULL").select(
            "slot", "tx_signature", F.lit("missing_signer").alias("reason"),
            F.lit(None).cast("string").alias("detail"),
        )
    ]
    if more_rejects is not None:
        more = attempt.stage("more_rejects", more_rejects.select("slot", "tx_signature", "reason", "detail"))
        attempt.reach(more, "slot")
        rejects.append(more)
    tables = _instruction_frames(program, attempt, rows, frames, rejects, on_error, enum_text)
    if infos is not None:
        _account_frames(program, attempt, rows, infos, frames, rejects, enum_text)
    frames["_rejects"] = reduce(DataFrame.unionByName, rejects)
    if selected is not None:
        frames["_unresolved"] = tx.unresolved_signatures(
            selected, seen.select(F.col("tx_signature").alias("signature"))
        )
    attempt.write_all(frames)
    _check_counts(attempt, tables)
    attempt.count_signers()

    counted = rows if upto is None else rows.where(F.col("slot") <= upto)
    newest = counted.agg(F.max("slot")).first()[0]
    attempt.commit(contiguous, newest if newest is None or not hold_last_slot else newest - 1, covered=covered, counted=True)
    attempt.clean()
    return True


def _check_counts(attempt: Attempt, tables: list[str] | None) -> None:
    """Every own instruction is a row or a reject, by what was counted while they were written."""
    if tables is None:
        return
    own = attempt.counted("instructions").get("own", 0)
    kept = sum(attempt.counted(name).get("rows", 0) for name in tables)
    if own != kept:
        raise RuntimeError(f"{own} instructions gave {kept} rows and rejects; nothing was committed")


def _add(frames: dict[str, DataFrame], rejects: list[DataFrame], table: str, name: str, rows: DataFrame) -> bool:
    """Two names may derive the same table: rows of one shape share it, others are rejects (True)."""
    held = frames.get(table)
    if held is None:
        frames[table] = rows
    elif held.dtypes == rows.dtypes:
        frames[table] = held.unionByName(rows)
    else:
        signature = F.col("tx_signature" if "tx_signature" in rows.columns else "_tx_signature")
        rejects.append(rows.select(
            "slot", signature.alias("tx_signature"), F.lit("table_name_clash").alias("reason"), F.lit(name).alias("detail")
        ))
        return True
    return False


def _during(rows: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Rows of the slots from low up to, but without, high."""
    if low is not None:
        rows = rows.where(F.col("slot") >= low)
    return rows if high is None else rows.where(F.col("slot") < high)


def _instruction_frames(program, attempt: Attempt, rows, frames, rejects, on_error, enum_text) -> list[str] | None:
    """Adds the instruction tables and what can't be decoded; the names of the tables that hold
    every instruction, or None if some are rejects for want of a table."""
    flat = rows.where("own").select("slot", "tx_pos", "tx_signature", "signer", "ix_ordinal", "data")
    matched = reduce(DataFrame.unionByName, [
        ins.match_instructions(_during(flat, low, high), version, on_error).drop("data")
        for low, high, version in program.in_force()
    ])
    staged = attempt.stage("instructions", matched, by="instruction", counts={"own": F.count(F.lit(1))})
    tables = decoded_frames(program, attempt, staged, frames, rejects, on_error, enum_text)
    # Worked out once, for the rejects and for the payloads that are kept.
    undecoded = attempt.stage("undecoded", _undecoded(program, attempt, staged, on_error))
    rejects.append(undecoded.select("slot", "tx_signature", "reason", "detail"))
    frames["_undecoded"] = undecoded
    return None if tables is None else [*tables, "_undecoded"]


def _versions_of(program, attempt: Attempt, staged):
    """(rows, version, name) of each staged instruction and the versions that know it."""
    found = set(attempt.staged_values("instructions", "instruction"))
    for low, high, version in program.in_force():
        rows = _during(staged, low, high)
        for name in version.instructions:
            if name in found:
                yield rows, version, name


def decoded_frames(program, attempt: Attempt, staged, frames, rejects, on_error, enum_text) -> list[str] | None:
    """Adds the tables of staged payloads, each decoded by the version in force at its slot; their
    names, or None if rows were rejected for want of a table."""
    tables, clashed = [], False
    for rows, version, name in _versions_of(program, attempt, staged):
        decoded = widened(ins.decode_instructions(rows, version, name, on_error, enum_text), program.instruction_schema(name))
        tables.append(program.instruction_table(name))
        clashed |= _add(frames, rejects, tables[-1], name, decoded)
    return None if clashed else list(dict.fromkeys(tables))


def _undecoded(program, attempt: Attempt, staged, on_error: str) -> DataFrame:
    unknown = ins.unknown_payloads(staged)
    if on_error != "quarantine":
        return unknown
    short = [ins.short_payloads(rows, version, name) for rows, version, name in _versions_of(program, attempt, staged)]
    return reduce(DataFrame.unionByName, short, unknown)


def _account_frames(program, attempt: Attempt, rows, infos, frames, rejects, enum_text) -> None:
    # Distinct on the join's own keys: one exchange serves both.
    writable = (
        rows.where("own").select("slot", "tx_signature", F.explode("writable").alias("pubkey"))
        .where("pubkey <> ''").groupBy("tx_signature", "pubkey").agg(F.min("slot").alias("slot"))
    )
    states = acc.owned_accounts(acc.account_states(infos), program.program_id)
    # Of several replies for one account the least (owner, data) counts; the join comes
    # first, so a small batch never exchanges the history of states.
    touched = (
        acc.touched_states(writable, states).groupBy("tx_signature", "pubkey", "slot")
        .agg(F.min(F.struct("owner", "data")).alias("state")).select("tx_signature", "pubkey", "slot", "state.*")
    )
    payloads = acc.account_bytes(touched)
    matched = reduce(DataFrame.unionByName, [
        acc.match_accounts(_during(payloads, low, high), version).drop("data", "owner")
        for low, high, version in program.in_force()
    ])
    staged = attempt.stage("accounts", matched, by="account")
    found = attempt.staged_values("accounts", "account")
    rejects.append(acc.unmatched_accounts(staged))
    for low, high, version in program.in_force():
        own = _during(staged, low, high)
        for name in version.account_names:
            if name in found:
                rejects.append(acc.account_rejects(own, version, name))
                if name in version.accounts:
                    decoded = widened(acc.decode_accounts(own, version, name, enum_text), program.account_schema(name))
                    _add(frames, rejects, program.account_table(name), name, decoded)


def replay(store: Store, run: str, batch_id: int = 0, enum_text: str = "object") -> bool:
    """Try again what gave no row, under the store's interface of today; False if already done.

    Rows that can be decoded now are committed with the places they come from, which
    are then no longer open; the rest stays as it is. Raw transactions are not read.
    """
    if store.is_committed(run, batch_id):
        return False
    program, attempt = store.program, store.attempt(run, batch_id)
    open_ = store.undecoded().where("payload IS NOT NULL").drop("reason", "detail")
    attempt.reach(open_, "slot")
    matched = reduce(DataFrame.unionByName, [
        ins.match_payloads(_during(open_, low, high), version) for low, high, version in program.in_force()
    ])
    staged = attempt.stage("instructions", matched, by="instruction")
    frames: dict[str, DataFrame] = {}
    rejects: list[DataFrame] = []
    if decoded_frames(program, attempt, staged, frames, rejects, "quarantine", enum_text) is None:
        raise ValueError("Two instructions derive the same table with other columns")
    replayed = [staged.where("false")]
    for rows, version, name in _versions_of(program, attempt, staged):
        payloads, whole = ins.whole_payloads(rows, version, name)
        replayed.append(payloads.where(whole).select(*staged.columns))
    frames["_replayed"] = reduce(DataFrame.unionByName, replayed).select("slot", "tx_signature", "ix_ordinal")
    attempt.write_all(frames)
    rows = sum(attempt.counted(t).get("rows", 0) for t in frames if not t.startswith("_"))
    if rows != attempt.counted("_replayed").get("rows", 0):
        raise RuntimeError("The rows are not those of the replayed places; nothing was committed")
    attempt.count_signers()
    attempt.commit(False, None, counted=True)
    attempt.clean()
    return True


def backfill(
    store: Store,
    feed: DataFrame,
    transactions: DataFrame,
    infos: DataFrame | None,
    run: str,
    slots: tuple[int, int] | None = None,
    between: tuple[str, str] | None = None,
    signatures: list[str] | DataFrame | None = None,
    retry_unresolved: bool = True,
    unreadable: DataFrame | None = None,
    **options,
) -> bool:
    """Process one selection. Only whole slot ranges move the checkpoint.

    Transactions committed before are left out, and signatures that were waiting
    for their transaction are tried again. A long list of signatures may come as a
    frame with a column `signature`. `unreadable` lines of the landed files (see
    `readers.unreadable_lines`) are committed as rejects, each once for ever.
    """
    if unreadable is not None:
        kept = store.table("_rejects").select("reason", "detail")
        options["more_rejects"] = unreadable.join(kept, ["reason", "detail"], "left_anti")
    mode = sel.check_selector(slots, between, signatures)
    low = high = None
    covered = (None, None)
    if mode == "slots":
        low, high = slots
        selected = sel.select_slot_range(feed, low, high)
        covered = _landed_range(feed, low, high)
    elif mode == "between":
        selected = sel.select_between(feed, *between)
    else:
        wanted = signatures if isinstance(signatures, DataFrame) else sel.signature_list(store.spark, signatures)
        if wanted.isEmpty():
            return False
        selected = sel.select_signatures(feed, wanted, absent=True)
    selected = selected.select("signature", "slot", "feed_pos")
    processed = store.table("_processed", low, high) if mode == "slots" else store.processed(selected)
    selected = sel.exclude_done(selected, processed, store.program.program_id)
    if mode != "slots":
        low, high = selected.agg(F.min("slot"), F.max("slot")).first()
    if retry_unresolved:
        selected = selected.unionByName(store.unresolved())
    return ingest(
        store, transactions, infos, run, selected=selected, contiguous=mode == "slots", upto=high, covered=covered,
        find=lambda landed_rows, wanted_rows: resolve(landed_rows, wanted_rows, low, high), **options
    )


def _landed_range(feed: DataFrame, low: int, high: int) -> tuple[int, int]:
    """The slots of a run from low to high whose feed is complete: all before the newest one."""
    tip = feed.agg(F.max("slot")).first()[0]
    return low - 1, low - 1 if tip is None else max(low - 1, min(high, tip - 1))


def fill_gaps(store: Store, feed: DataFrame, transactions: DataFrame, infos: DataFrame | None, run: str, **options) -> bool:
    """Process the slots between committed ranges that no commit covers; False if there are none.

    All gaps make one batch, whose commit covers from the first gap to the end of the
    last one: what lies between them is covered already. Slots that the feed has not
    reached yet are left for later.
    """
    own = F.col("program_id") == store.program.program_id
    gaps = store.missing().where(own)
    low, high = gaps.agg(F.min("from_slot"), F.max("to_slot")).first()
    if low is None:
        return False
    start, end = _landed_range(feed, low + 1, high)
    if end <= start:
        return False
    near = feed.where((F.col("slot") > start) & (F.col("slot") <= end))
    selected = coverage.in_ranges(near, gaps, store.slots_per_bucket).select("signature", "slot", "feed_pos")
    selected = sel.exclude_done(selected, store.table("_processed", low, high), store.program.program_id)
    return ingest(
        store, transactions, infos, run, selected=selected, upto=end, covered=(start, end),
        find=lambda landed_rows, wanted_rows: resolve(landed_rows, wanted_rows, low, high), **options
    )


def catch_up(store: Store, feed, transactions, infos, run: str, stop_at_gap: bool = False, **options) -> bool:
    """Backfill from the checkpoint to the tip of the feed; False when there is nothing to do.

    The checkpoint slot itself is covered again: a slot may have been cut short,
    and what is committed of it is left out by signature. With `stop_at_gap` the run
    begins at the first slot that is missing, however far later runs have come.
    """
    own = store.checkpoint(stop_at_gap).where(F.col("program_id") == store.program.program_id)
    bounds = sel.resume_range(own, feed).first()
    if bounds.to_slot is None:
        return False
    return backfill(
        store, feed, transactions, infos, run, slots=(bounds.from_slot, bounds.to_slot), **options
    )
