"""Which transactions a run covers.

Feeds are (signature, slot, feed_pos), newest first. Ranges are plain filters on
the feed, so they prune by slot and need no paging.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def select_slots(feed: DataFrame, above: int, up_to: int) -> DataFrame:
    """Entries with above < slot <= up_to; an empty range selects nothing."""
    return feed.where((F.col("slot") > above) & (F.col("slot") <= up_to))


def select_slot_range(feed: DataFrame, slot_from: int, slot_to: int) -> DataFrame:
    """Both ends inclusive, as a user states them."""
    if slot_from > slot_to:
        raise ValueError("slot_from must be less than or equal to slot_to")
    return select_slots(feed, slot_from - 1, slot_to)


def _age(slot: Column, feed_pos: Column) -> Column:
    """Feed order: greater is older."""
    return F.struct((-slot).alias("s"), feed_pos.alias("p"))


def _place(feed: DataFrame, signature: str) -> DataFrame:
    """Place of one signature as a single row (null when absent)."""
    return feed.where(F.col("signature") == signature).agg(
        F.min(_age(F.col("slot"), F.col("feed_pos"))).alias("place")
    )


def select_between(feed: DataFrame, before: str, until: str) -> DataFrame:
    """Entries older than `before` and newer than `until`, both left out.

    An absent `before` fails the job; an absent `until` selects to the start. The
    two places are scalar subqueries, one row each whatever the feed's size.
    """
    age = _age(F.col("slot"), F.col("feed_pos"))
    message = F.lit(f"Signature {before} is not in the feed")
    start = F.coalesce(
        _place(feed, before).scalar(), F.raise_error(message).cast("struct<s:bigint,p:bigint>")
    )
    end = _place(feed, until).scalar()
    return feed.where((age > start) & F.coalesce(age < end, F.lit(True)))


def parse_signatures(text: str) -> list[str]:
    """A comma-separated list: trimmed, without blanks, first occurrence kept."""
    found = list(dict.fromkeys(s.strip() for s in text.split(",") if s.strip()))
    if not found:
        raise ValueError("signatures must contain at least one signature")
    return found


def signature_list(spark: SparkSession, signatures: Iterable[str]) -> DataFrame:
    """A driver-side list as a frame (position, signature), cleaned like `parse_signatures`."""
    found = list(dict.fromkeys(s.strip() for s in signatures if s and s.strip()))
    return spark.createDataFrame(list(enumerate(found)), "position bigint, signature string")


def select_signatures(feed: DataFrame, wanted: DataFrame, absent: bool = False) -> DataFrame:
    """Entries named in `wanted`, once each however often a name is listed.

    With `absent`, a name that the feed lacks stays too, without slot and position. The list may come from a file of any size, so the join side is left to the
    planner's size check. Repeated names are folded before they are exchanged.
    """
    names = wanted.select(F.trim("signature").alias("signature")).where("signature <> ''").distinct()
    if absent:
        return names.join(feed, "signature", "left")
    return feed.join(names, "signature", "left_semi")


def oldest_first(selected: DataFrame) -> DataFrame:
    """Order in which transactions are to be read."""
    return selected.orderBy(F.asc("slot"), F.desc("feed_pos"))


def resume_range(
    checkpoint: DataFrame, feed: DataFrame, slot_from: int | None = None, slot_to: int | None = None
) -> DataFrame:
    """One row (from_slot, to_slot): the explicit ends, else checkpoint (0 if none) and tip.

    `checkpoint` has a column last_processed_slot. A feed may have landed less than
    what live batches committed: its tip then counts as the checkpoint. An explicit
    range that ends before it starts fails the job.
    """
    tip = feed.agg(F.max("slot").alias("tip"))
    stored = checkpoint.agg(F.max("last_processed_slot").alias("stored"))
    low = F.coalesce(F.lit(slot_from).cast("bigint"), stored.scalar(), F.lit(0).cast("bigint"))
    high = F.coalesce(F.lit(slot_to).cast("bigint"), F.greatest(F.col("tip"), stored.scalar()))
    bounds = tip.select(low.alias("low"), high.alias("high"))
    message = F.concat(
        F.lit("Invalid slot range: slot-from ("), F.col("low").cast("string"),
        F.lit(") must be less than or equal to slot-to ("), F.col("high").cast("string"), F.lit(")"),
    )
    checked = F.when(F.col("low") > F.col("high"), F.raise_error(message)).otherwise(F.col("low"))
    return bounds.select(checked.cast("bigint").alias("from_slot"), F.col("high").alias("to_slot"))


def exclude_done(selected: DataFrame, processed: DataFrame, program_id: str) -> DataFrame:
    """Entries not yet committed for the program, also those that gave no row.

    The committed side is cut down to the selection first: a short selection is
    broadcast to it after the planner's size check, and the long history is not
    exchanged. For a long one both joins share the same exchanges.
    """
    done = (
        processed.where(F.col("program_id") == program_id)
        .select(F.col("tx_signature").alias("signature"))
        .join(selected.select("signature"), "signature", "left_semi")
    )
    return selected.join(done, "signature", "left_anti")


def check_selector(
    slots: tuple[int | None, int | None] | None = None,
    between: tuple[str | None, str | None] | None = None,
    signatures: Iterable[str] | None = None,
) -> str:
    """The one selector of a backfill: 'slots', 'between' or 'signatures'."""
    given = {"slots": slots, "between": between, "signatures": signatures}
    named = [name for name, value in given.items() if value is not None]
    if len(named) != 1:
        raise ValueError("Choose exactly one of slots, between and signatures")
    if named[0] != "signatures" and (len(given[named[0]]) != 2 or None in given[named[0]]):
        raise ValueError(f"{named[0]} needs both ends")
    if slots is not None and slots[0] > slots[1]:
        raise ValueError("slot_from must be less than or equal to slot_to")
    return named[0]
