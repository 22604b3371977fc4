"""Coverage of slots, overlapping compactions, dedupe by count, and streams that drop."""

import datetime as dt
import json
import random
import threading
from collections import deque

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import coverage as cov
from ledgerloom.operators.catalog import Program
from ledgerloom.plans import ingest as ing
from ledgerloom.plans.store import Store
from ledgerloom.sources import readers
from ledgerloom.streaming import realtime as rt
from ledgerloom.streaming.recent import first_of_recent, for_list_state
from tests import sample
from tests.test_ingest import feed, frame
from tests.test_lossless import STAMP, announce, reply, signatures, store  # noqa: F401


def plain_union(ranges):
    covered = set()
    for low, high in ranges:
        covered |= set(range(low + 1, high + 1))
    return covered


def as_slots(rows):
    found = [s for r in rows for s in range(r.from_slot + 1, r.to_slot + 1)]
    assert len(found) == len(set(found)), "ranges overlap"
    return set(found)


@pytest.mark.parametrize("size", [7])
def test_union_of_intervals(spark, size):
    rnd = random.Random(size)
    ranges = {p: [(a, a + rnd.choice([1, 2, 5, 40])) for a in rnd.choices(range(-20, 300), k=n)] for p, n in (("p", 30), ("q", 1), ("r", 8))}
    rows = spark.createDataFrame([(p, *r) for p, rs in ranges.items() for r in [*rs, rs[0]]], "program_id string, from_slot long, to_slot long")
    gaps, whole = cov.missing_ranges(rows, size).collect(), cov.islands(rows, size).collect()
    for p, own in ranges.items():
        covered = plain_union(own)
        assert as_slots([r for r in whole if r.program_id == p]) == covered
        assert as_slots([r for r in gaps if r.program_id == p]) == set(range(min(covered), max(covered) + 1)) - covered
        # islands neither meet nor overlap
        ends = sorted((r.from_slot, r.to_slot) for r in whole if r.program_id == p)
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    assert cov.missing_ranges(rows.limit(0), size).isEmpty() and cov.islands(rows.limit(0), size).isEmpty()


def test_rows_in_ranges(spark):
    ranges = spark.createDataFrame([(0, 3), (5, 6), (10, 95)], "from_slot long, to_slot long")
    rows = spark.createDataFrame([(s, "x") for s in range(-2, 120)] + [(2, "again"), (None, "none")], "slot long, tag string")
    found = sorted((r.slot, r.tag) for r in cov.in_ranges(rows, ranges, 10).collect())
    assert found == sorted([(s, "x") for s in [1, 2, 3, 6, *range(11, 96)]] + [(2, "again")])


def commits(spark, rows):
    """(run, batch_id, last_whole_slot, from_slot, to_slot)"""
    return spark.createDataFrame([("p", r, b, True, last, low, high) for r, b, last, low, high in rows],
                                 "program_id string, run string, batch_id long, contiguous boolean, last_whole_slot long, from_slot long, to_slot long")


def test_live_batches_go_on_from_the_batch_before(spark):
    live = [("live", 0, 20, None, None), ("live", 3, 50, None, None), ("live", 2, 30, None, None), ("other", 0, 70, None, None)]
    found = commits(spark, [("a", 0, 9, -1, 10), *live])
    assert sorted((r.from_slot, r.to_slot) for r in cov.covered_ranges(found).collect()) == [(-1, 10), (19, 20), (20, 30), (30, 50), (69, 70)]
    assert [(r.from_slot, r.to_slot) for r in cov.missing_ranges(cov.covered_ranges(found)).orderBy("from_slot").collect()] == [(10, 19), (50, 69)]
    assert cov.whole_checkpoints(found).first().last_processed_slot == 10
    # a batch that saw no slot covers nothing
    assert cov.covered_ranges(commits(spark, [("live", 0, None, None, None), ("b", 0, 5, 7, 7)])).isEmpty()


def test_gaps_are_filled_and_the_checkpoint_moves_on(spark, store):  # noqa: F811
    slots = list(range(1, 100, 3))
    entries, replies = feed(spark, [(f"sig-{s}", s) for s in reversed(slots)]), frame(spark, [reply(f"sig-{s}", s) for s in slots])
    ing.backfill(store, entries, replies, None, "low", slots=(0, 20))
    ing.backfill(store, entries, replies, None, "high", slots=(60, 90))
    assert sorted((r.from_slot, r.to_slot) for r in store.missing().collect()) == [(20, 59)]
    assert store.checkpoint().first().last_processed_slot == 88
    assert store.checkpoint(stop_at_gap=True).first().last_processed_slot == 20
    assert ing.fill_gaps(store, entries, replies, None, "fill")
    assert store.missing().isEmpty() and not ing.fill_gaps(store, entries, replies, None, "again")
    assert signatures(store) == sorted(f"sig-{s}" for s in slots if s <= 90)
    assert store.checkpoint(stop_at_gap=True).first().last_processed_slot == 90


def test_the_newest_slot_of_a_feed_is_not_taken_as_complete(spark, store):  # noqa: F811
    ing.backfill(store, feed(spark, [("sig-5", 5)]), frame(spark, [reply("sig-5", 5)]), None, "a", slots=(0, 100))
    late = feed(spark, [("sig-9", 9), ("sig-5b", 5), ("sig-5", 5)])
    replies = frame(spark, [reply("sig-5", 5), reply("sig-5b", 5), reply("sig-9", 9)])
    assert store.checkpoint(stop_at_gap=True).first().last_processed_slot == 4
    ing.catch_up(store, late, replies, None, "b", stop_at_gap=True)
    assert signatures(store) == ["sig-5", "sig-5b", "sig-9"]


def test_overlapping_compactions_lose_nothing(spark, store):  # noqa: F811
    for n in (1, 2):
        ing.ingest(store, frame(spark, [reply(f"sig-{n}", n)]), None, "part", n)
    one = store.begin_compaction()
    ing.ingest(store, frame(spark, [reply("sig-3", 3)]), None, "part", 3)
    two = store.begin_compaction()
    assert one.finish() and not two.finish()
    assert signatures(store) == ["sig-1", "sig-2", "sig-3"]
    assert store.vacuum(older_than_hours=0) > 0
    assert signatures(store) == ["sig-1", "sig-2", "sig-3"]


def test_only_small_batches_are_compacted(spark, store):  # noqa: F811
    for n in (1, 2):
        ing.ingest(store, frame(spark, [reply(f"sig-{n}", n)]), None, "part", n)
    sizes = {r.batch: store._bytes(r.batch) for r in store.commits().collect()}
    assert store.begin_compaction(small_bytes=min(sizes.values())) is None
    assert store.begin_compaction(small_bytes=max(sizes.values())) is None or len(set(sizes.values())) == 1
    assert sorted(store.begin_compaction().batches) == sorted(sizes)


# --- dedupe by count -------------------------------------------------------------------


def plain_queue(stream, n):
    queue, out = deque(), []
    for row in stream:
        if row[1] not in queue:
            queue.append(row[1])
            out.append(row)
            if len(queue) > n:
                queue.popleft()
    return out


@pytest.mark.parametrize(("remember", "lanes"), [(7, 1), (7, 3)])
def test_last_signatures(spark, tmp_path, remember, lanes):
    rnd = random.Random(remember)
    stream = [(i, f"s{rnd.randint(0, 30)}") for i in range(200)]
    landing = tmp_path / "notes"
    for part in range(2):
        notes = [(s, slot, STAMP + dt.timedelta(seconds=slot)) for slot, s in stream[part * 100 : part * 100 + 100]]
        rnd.shuffle(notes)
        announce(landing, f"{part}.json", *notes, (None, 1000 + part, STAMP))
    own = for_list_state(spark)
    notices = readers.stream_notifications(own, str(landing), max_files_per_trigger=1)
    target = str(tmp_path / "out")

    def run():
        first_of_recent(notices, remember, lanes).select("context.slot", "value.signature").writeStream.option(
            "checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", target).trigger(availableNow=True).start().awaitTermination()

    run()
    run()  # restarts from its offsets and its state
    rows = spark.read.schema("slot long, signature string").parquet(target).collect()
    got = sorted((r.slot, r.signature) for r in rows if r.signature)
    assert sorted(r.slot for r in rows if not r.signature) == [1000, 1001]
    names = spark.createDataFrame([(s,) for _, s in set(stream)], "s string").selectExpr("s", f"pmod(xxhash64(s), {lanes}) AS lane")
    lane = {r.s: r.lane for r in names.collect()}
    assert got == sorted(r for n in range(lanes) for r in plain_queue([r for r in stream if lane[r[1]] == n], remember))
    with pytest.raises(ValueError):
        first_of_recent(notices, 0)


# --- streams that drop -----------------------------------------------------------------


def test_backoff_is_bounded():
    pauses = [rt.Backoff(0.25, 4).pause(n) for n in range(1, 8)]
    assert pauses == [0.25, 0.5, 1, 2, 4, 4, 4] and rt.Backoff().pause(10_000) == 4


def supervised(spark, store, tmp_path, fail_at, **options):  # noqa: F811
    slots = [10, 20]
    replies = frame(spark, [reply(f"sig-{s}", s) for s in [*slots, 5]])
    landing = tmp_path / "notes"
    for s in slots:
        announce(landing, f"{s}.json", (f"sig-{s}", s, STAMP))
    calls = []

    def transactions():
        calls.append(1)
        if len(calls) in fail_at:
            raise ConnectionError("dropped on purpose")
        return replies

    entries = feed(spark, [("sig-5", 5)])
    return rt.keep_following(
        store, lambda: entries, lambda: readers.stream_notifications(spark, str(landing), max_files_per_trigger=1), transactions,
        None, "live", str(tmp_path / "state"), backoff=rt.Backoff(0.01, 0.05), poll_seconds=0.1, **options)


def test_a_dropped_stream_ends_with_every_row_once(spark, store, tmp_path):  # noqa: F811
    assert supervised(spark, store, tmp_path, (1, 4), trigger={"availableNow": True}, remember=None) == 2
    assert signatures(store) == sorted(f"sig-{s}" for s in [5, 10, 20])


def test_the_last_error_is_raised_after_too_many_drops_in_a_row(spark, store, tmp_path):  # noqa: F811
    with pytest.raises(Exception, match="dropped on purpose"):
        supervised(spark, store, tmp_path, range(1, 100), attempts=3, trigger={"availableNow": True})


def test_following_ends_when_told(spark, store, tmp_path):  # noqa: F811
    stop = threading.Event()
    threading.Timer(6, stop.set).start()
    assert supervised(spark, store, tmp_path, (), stop=stop, trigger={"processingTime": "200 milliseconds"}) == 0
    assert not [q for q in spark.streams.active if q.name == "live"]


def test_following_with_a_bounded_memory(spark, tmp_path):
    own = for_list_state(spark)
    held = Store(own, str(tmp_path / "own"), Program.from_idl(sample.IDL), slots_per_bucket=10)
    held.open(json.dumps(sample.IDL))
    landing = tmp_path / "notes"
    for s in (10, 20):
        announce(landing, f"{s}.json", (f"sig-{s}", s, STAMP), ("sig-10", s + 1, STAMP + dt.timedelta(1)), (None, s, STAMP))
    replies = frame(own, [reply("sig-10", 10), reply("sig-20", 20)])
    rt.follow(held, readers.stream_notifications(own, str(landing), max_files_per_trigger=1), lambda: replies, None, "live",
              str(tmp_path / "state"), trigger={"availableNow": True}, remember=10).awaitTermination()
    assert signatures(held) == ["sig-10", "sig-20"]
    assert held.table("_rejects").where(F.col("reason") == "malformed_notification").count() == 2
