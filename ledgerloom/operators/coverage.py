"""Which slots are covered by commits, and which are not: union of intervals.

Ranges are half open, (from_slot, to_slot], so that neighbours meet without a gap. They
may overlap, lie inside each other and come in any order. The union takes two levels: the
furthest end of each slot bucket, and inside a bucket a running maximum that begins
with the furthest end of the buckets before it. Thus no task holds all ranges of a
program; only one row a bucket meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 100_000


def bucket_of(slot: Column | str, size: int) -> Column:
    """Whole-number bucket of a slot; a double would round the largest slots."""
    slot = F.col(slot).cast("bigint") if isinstance(slot, str) else slot.cast("bigint")
    width = F.lit(size).cast("bigint")
    return F.call_function("div", slot - F.pmod(slot, width), width)


def covered_ranges(commits: DataFrame) -> DataFrame:
    """(program_id, from_slot, to_slot) of contiguous commits that cover whole slots.

    A backfill states its range. A live batch covers up to its last whole slot and has
    no start of its own: a stream sees every slot, so it goes on from the furthest end
    of the batches before it in its run. The first one of a run, whose start nobody
    knows, covers its last whole slot only.
    """
    before = Window.partitionBy("program_id", "run").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce("to_slot", "last_whole_slot")
    ranges = (
        commits.where("contiguous").withColumn("_end", end)
        .withColumn("_start", F.coalesce("from_slot", F.max("_end").over(before), F.col("_end") - 1))
        .select("program_id", F.col("_start").alias("from_slot"), F.col("_end").alias("to_slot"))
    )
    return ranges.where("to_slot > from_slot")


def reached(ranges: DataFrame, size: int = BUCKET) -> DataFrame:
    """The ranges with `reach`: the furthest end of all that begin before them, null for the first."""
    bucketed = ranges.withColumn("_bucket", bucket_of("from_slot", size))
    furthest = bucketed.groupBy("program_id", "_bucket").agg(F.max("to_slot").alias("_end"))
    earlier = Window.partitionBy("program_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = furthest.withColumn("_carry", F.max("_end").over(earlier)).drop("_end")
    inside = Window.partitionBy("program_id", "_bucket").orderBy("from_slot", "to_slot").rowsBetween(Window.unboundedPreceding, -1)
    joined = bucketed.join(carried, ["program_id", "_bucket"])
    # greatest leaves nulls out
    return joined.withColumn("reach", F.greatest(F.max("to_slot").over(inside), "_carry")).drop("_bucket", "_carry")


def missing_ranges(ranges: DataFrame, size: int = BUCKET) -> DataFrame:
    """(program_id, from_slot, to_slot] between the first and the last covered slot that no range covers."""
    return reached(ranges, size).where("from_slot > reach").select(
        "program_id", F.col("reach").alias("from_slot"), F.col("from_slot").alias("to_slot")
    )


def islands(ranges: DataFrame, size: int = BUCKET) -> DataFrame:
    """The union of the ranges as (program_id, from_slot, to_slot) that neither meet nor overlap."""
    gaps = missing_ranges(ranges, size)
    whole = ranges.groupBy("program_id").agg(F.min("from_slot").alias("low"), F.max("to_slot").alias("high"))
    starts = whole.select("program_id", F.col("low").alias("from_slot")).unionByName(gaps.select("program_id", F.col("to_slot").alias("from_slot")))
    ends = whole.select("program_id", F.col("high").alias("to_slot")).unionByName(gaps.select("program_id", F.col("from_slot").alias("to_slot")))
    # The nth start belongs to the nth end: an island ends where the next gap begins.
    numbered = lambda frame, slot: frame.withColumn(
        "n", F.row_number().over(Window.partitionBy("program_id").orderBy(slot))
    )
    return numbered(starts, "from_slot").join(numbered(ends, "to_slot"), ["program_id", "n"]).drop("n")


def whole_checkpoints(commits: DataFrame, size: int = BUCKET) -> DataFrame:
    """Last slot per program up to which nothing is missing since the first covered one.

    Explicit lists leave gaps and don't count; a gap that is filled later lets the
    checkpoint move on past what was covered beyond it.
    """
    ranges = covered_ranges(commits)
    first_gap = missing_ranges(ranges, size).groupBy("program_id").agg(F.min("from_slot").alias("gap"))
    furthest = ranges.groupBy("program_id").agg(F.max("to_slot").alias("end"))
    return furthest.join(first_gap, "program_id", "left").select(
        "program_id", F.coalesce("gap", "end").alias("last_processed_slot")
    )


def in_ranges(rows: DataFrame, ranges: DataFrame, size: int = BUCKET) -> DataFrame:
    """Rows whose slot lies in a range (from_slot, to_slot]; ranges must not overlap.

    A range is repeated for each bucket it touches, so the join is by bucket and the
    comparison stays inside one.
    """
    first, last = bucket_of(F.col("from_slot") + 1, size), bucket_of("to_slot", size)
    cut = ranges.select("from_slot", "to_slot", F.explode(F.sequence(first, last)).alias("_bucket"))
    bucketed = rows.withColumn("_bucket", bucket_of("slot", size)).alias("r")
    inside = (F.col("r._bucket") == F.col("g._bucket")) & (F.col("r.slot") > F.col("g.from_slot")) & (F.col("r.slot") <= F.col("g.to_slot"))
    return bucketed.join(cut.alias("g"), inside, "left_semi").drop("_bucket")
