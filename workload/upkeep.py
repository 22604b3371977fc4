"""Registered queries of coverage, compaction and the live path."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import coverage as cov
from ledgerloom.operators import query as q
from ledgerloom.plans import ingest as ingestion
from ledgerloom.plans import store as st
from ledgerloom.session import shared_folder
from ledgerloom.sources import readers
from ledgerloom.sources.pages import land_pages, read_feed_pages, stream_feed_pages
from ledgerloom.streaming import realtime as rt
from ledgerloom.streaming.recent import first_of_recent, for_list_state
from workload import inputs as inp
from workload.queries import _LEDGER_SQL, EVENTS_SQL, _event_files, _landed_by_type, _landed_replies, _new_store, _store_rows, register

# -- covered and missing slots -------------------------------------------

_RANGES_SQL = """WITH r AS (SELECT 'prog' || o_orderstatus AS program_id, o_orderkey AS f,
  o_orderkey + (o_custkey % 7) * (o_custkey % 5) AS t FROM orders WHERE o_orderpriority <> '5-LOW' AND (o_custkey % 7) * (o_custkey % 5) > 0),
m AS (SELECT *, max(t) OVER (PARTITION BY program_id ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
g AS (SELECT program_id, reach AS from_slot, f AS to_slot FROM m WHERE f > reach)"""


def order_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit per order: ranges of all lengths that overlap, hold each other or leave gaps."""
    length = (F.col("o_custkey") % 7) * (F.col("o_custkey") % 5)
    return inp.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("prog"), "o_orderstatus").alias("program_id"), F.lit("run").alias("run"),
        F.col("o_orderkey").alias("batch_id"), (F.col("o_orderpriority") != "5-LOW").alias("contiguous"),
        F.col("o_orderkey").alias("last_whole_slot"), F.col("o_orderkey").alias("from_slot"),
        (F.col("o_orderkey") + length).alias("to_slot"),
    )


@register(f"{_RANGES_SQL} SELECT * FROM g")
def q_missing_ranges(spark, sf_dir):
    return cov.missing_ranges(cov.covered_ranges(order_ranges(spark, sf_dir)), 1000)


@register(f"""{_RANGES_SQL}, i AS (SELECT *, sum(CASE WHEN f > reach THEN 1 ELSE 0 END) OVER (PARTITION BY program_id ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS n FROM m)
SELECT program_id, min(f) AS from_slot, max(t) AS to_slot FROM i GROUP BY program_id, n""")
def q_covered_islands(spark, sf_dir):
    return cov.islands(cov.covered_ranges(order_ranges(spark, sf_dir)), 1000)


@register(f"{_RANGES_SQL} SELECT program_id, min(from_slot) AS last_processed_slot FROM g GROUP BY program_id")
def q_checkpoint_whole(spark, sf_dir):
    """The checkpoint that stops at the first gap."""
    return cov.whole_checkpoints(order_ranges(spark, sf_dir), 1000)


@register("""WITH s AS (SELECT o_orderkey // 4 AS slot, 'ord' || o_orderkey AS signature FROM orders),
b AS (SELECT DISTINCT (l_orderkey // 400) * 100 AS low FROM lineitem WHERE l_linenumber = 7 AND l_quantity > 49)
SELECT signature, slot FROM s WHERE EXISTS (SELECT 1 FROM b WHERE slot > low AND slot <= low + 30)""")
def q_in_ranges(spark, sf_dir):
    """Feed entries inside any of many ranges."""
    low = F.floor(F.col("l_orderkey") / 400) * 100
    lines = inp.table(spark, sf_dir, "lineitem").where("l_linenumber = 7 AND l_quantity > 49")
    ranges = lines.select(low.alias("from_slot"), (low + 30).alias("to_slot")).distinct()
    return cov.in_ranges(inp.order_feed(spark, sf_dir), ranges, 64).select("signature", "slot")


def _store_with_gaps(spark, sf_dir) -> tuple[st.Store, DataFrame, DataFrame]:
    """Three ranges with gaps between them, one of which lies inside another, and a list in a gap."""
    feed, replies = _event_files(spark, sf_dir)
    store, tip = _new_store(spark, "gaps"), feed.agg(F.max("slot")).first()[0]
    ranges = {"a": (0, tip // 8), "b": (tip // 4, tip // 2), "inside": (tip // 3, tip // 3 + 5), "c": (tip // 8 * 6, tip + 1000)}
    for run, slots in ranges.items():
        ingestion.backfill(store, feed, replies, None, run, slots=slots, on_error="quarantine")
    ingestion.backfill(store, feed, replies, None, "list", signatures=[f"tx{tip // 8 + 1}", f"tx{tip // 2 + 1}"], on_error="quarantine")
    return store, feed, replies


@register("""WITH t AS (SELECT max(event_id) AS tip FROM events)
SELECT tip // 8 AS from_slot, tip // 4 - 1 AS to_slot FROM t UNION ALL SELECT tip // 2, tip // 8 * 6 - 1 FROM t""")
def q_store_missing(spark, sf_dir):
    """Gaps between the committed ranges of a store."""
    return _store_with_gaps(spark, sf_dir)[0].missing().select("from_slot", "to_slot")


@register(_LEDGER_SQL)
def q_fill_gaps(spark, sf_dir):
    """Every row once after the gaps are filled, and no gap is left."""
    store, feed, replies = _store_with_gaps(spark, sf_dir)
    ingestion.fill_gaps(store, feed, replies, None, "fill", on_error="quarantine")
    if ingestion.fill_gaps(store, feed, replies, None, "again", on_error="quarantine"):
        raise RuntimeError("a gap was left")
    return _store_rows(store)


@register("SELECT max(event_id) - 1 AS last_processed_slot FROM events")
def q_fill_gaps_checkpoint(spark, sf_dir):
    """Catching up from the first gap moves the whole checkpoint to the last complete slot."""
    store, feed, replies = _store_with_gaps(spark, sf_dir)
    ingestion.catch_up(store, feed, replies, None, "catch", stop_at_gap=True, on_error="quarantine")
    return store.checkpoint(stop_at_gap=True).select("last_processed_slot")


# -- compaction ----------------------------------------------------------


@register(_LEDGER_SQL)
def q_store_overlapping_compactions(spark, sf_dir):
    """Two compactions overlap, a batch comes between them, and retired files are deleted."""
    store, parts = _new_store(spark, "overlap"), _landed_by_type(spark, sf_dir)

    def batch(number):
        ingestion.ingest(store, parts[inp.EVENT_TYPES[number]], None, "part", number, on_error="quarantine")

    for number in range(3):
        batch(number)
    first = store.begin_compaction(st.ANY_BYTES)
    batch(3)
    second = store.begin_compaction(st.ANY_BYTES)
    batch(4)
    outcome = second.finish(), first.finish()
    if outcome != (True, False):
        raise RuntimeError(f"one compaction counts, not {outcome}")
    store.vacuum(older_than_hours=0)
    return _store_rows(store)


# -- live ----------------------------------------------------------------

REMEMBERED = 100


def _repeated_notices(spark, sf_dir) -> DataFrame:
    """Every event announces its own signature, and repeats one of 50 events ago (always still
    remembered) or, every third event, one of 400 events ago (always forgotten)."""
    own = F.col("event_id")
    notices = lambda rows, shift: rows.select(
        F.struct(own.alias("slot")).alias("context"), F.struct(F.concat(F.lit("tx"), own - shift).alias("signature")).alias("value"),
        F.timestamp_micros(own * 10 + (1 if shift else 0)).alias("received_at"))
    events = inp.table(spark, sf_dir, "events").select("event_id")
    later = events.where(own >= 400)
    return notices(events, 0).unionByName(notices(later.where(own % 3 != 0), 50)).unionByName(notices(later.where(own % 3 == 0), 400))


@register("""SELECT event_id AS slot, 'tx' || event_id AS signature FROM events
UNION ALL SELECT event_id, 'tx' || (event_id - 400) FROM events WHERE event_id >= 400 AND event_id % 3 = 0""")
def q_stream_last_signatures(spark, sf_dir):
    """The last 100 signatures, first in, first out, over batches of one file each."""
    landing, target = shared_folder(spark, "repeats"), shared_folder(spark, "recent")
    notices = _repeated_notices(spark, sf_dir)
    newest = inp.table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    for part in range(4):  # files are read in the order in which they landed
        own = F.col("context.slot")
        landed = notices.where((own > newest * part // 4 - (part == 0)) & (own <= newest * (part + 1) // 4))
        landed.coalesce(1).write.mode("append").parquet(landing)
    own = for_list_state(spark)
    notices = readers.stream_notifications(own, landing, "parquet", max_files_per_trigger=1)
    first_of_recent(notices, REMEMBERED).select("context.slot", "value.signature").writeStream.option(
        "checkpointLocation", shared_folder(spark, "recent-state")).option("path", target).format("parquet").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema("slot bigint, signature string").parquet(target)


def _dropped_twice(spark, sf_dir) -> st.Store:
    """A followed stream that fails while its second and third batch are processed. The older half
    of the feed was landed before; the newer half is announced in four files."""
    feed, replies = _event_files(spark, sf_dir)
    events, landing = inp.table(spark, sf_dir, "events"), shared_folder(spark, "notices")
    middle = events.agg(F.max("event_id")).first()[0] // 2
    live = events.where(F.col("event_id") > middle)
    inp.own_notifications(live).repartitionByRange(4, F.col("context.slot")).write.parquet(landing)
    store, calls, lock = _new_store(spark, "dropped"), [], threading.Lock()

    def transactions():
        with lock:
            calls.append(1)
            if len(calls) in (3, 5):  # the first call is that of catching up
                raise ConnectionError("dropped on purpose")
        return replies

    drops = rt.keep_following(
        store, lambda: feed.where(F.col("slot") <= middle), lambda: readers.stream_notifications(spark, landing, "parquet", 1),
        transactions, None, "live", shared_folder(spark, "dropped-state"), attempts=3, backoff=rt.Backoff(0.05, 0.2),
        poll_seconds=0.2, trigger={"availableNow": True}, on_error="quarantine",
    )
    if drops != 2:
        raise RuntimeError(f"dropped {drops} times, not twice")
    return store


@register(f"SELECT * FROM ({_LEDGER_SQL} AND k <> 0)")
def q_stream_supervised(spark, sf_dir):
    """A stream that is dropped twice ends with every row once."""
    return _store_rows(_dropped_twice(spark, sf_dir))


@register(f"""{EVENTS_SQL} SELECT slot, 'malformed_notification' AS reason FROM e
WHERE k = 0 AND slot > (SELECT max(event_id) // 2 FROM events)""")
def q_stream_supervised_rejects(spark, sf_dir):
    """Malformed notices of a dropped stream, each once."""
    rejects = _dropped_twice(spark, sf_dir).table("_rejects")
    return rejects.where("reason = 'malformed_notification'").select("slot", "reason")


# -- paged feed ----------------------------------------------------------

KEYS_PER_PAGE = 2000


def _paged_orders(spark, sf_dir, path: str, below: int | None = None, least: int = 0) -> None:
    """The order feed as landed pages of neighbouring keys."""
    page = F.floor(-F.col("feed_pos") / KEYS_PER_PAGE)
    feed = inp.order_feed(spark, sf_dir).withColumn("page", page).where(F.col("page") >= least)
    land_pages(feed if below is None else feed.where(F.col("page") < below), path)


@register("SELECT 'ord' || o_orderkey AS signature, o_orderkey // 4 AS slot FROM orders")
def q_feed_pages(spark, sf_dir):
    path = shared_folder(spark, "pages")
    _paged_orders(spark, sf_dir, path)
    return read_feed_pages(spark, path).select("signature", "slot")


@register("""SELECT 'ord' || o_orderkey AS signature, o_orderkey // 4 AS slot FROM orders
WHERE o_orderkey < 5927 AND o_orderkey > 1057 ORDER BY o_orderkey DESC LIMIT 300""")
def q_feed_pages_between(spark, sf_dir):
    """The newest 300 entries between two signatures, from the pages between them."""
    path = shared_folder(spark, "pages")
    _paged_orders(spark, sf_dir, path)
    # The bounds are keys: the feed's nearest entries stand for one that it lacks.
    key = F.col("o_orderkey")
    ends = inp.table(spark, sf_dir, "orders").agg(F.min(F.when(key >= 5927, key)), F.max(F.when(key <= 1057, key))).first()
    before, until = (None if end is None else f"ord{end}" for end in ends)
    return read_feed_pages(spark, path, before=before, until=until, limit=300).select("signature", "slot")


@register("SELECT 'ord' || o_orderkey AS signature, o_orderkey // 4 AS slot FROM orders")
def q_stream_feed_pages(spark, sf_dir):
    """Pages land in two parts; the stream goes on from its offset after a restart."""
    path, target, state = (shared_folder(spark, p) for p in ("pages", "paged", "paged-state"))
    for below, least in ((2, 0), (None, 2)):
        _paged_orders(spark, sf_dir, path, below, least)
        stream_feed_pages(spark, path).select("signature", "slot").writeStream.option("checkpointLocation", state).option(
            "path", target).format("parquet").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("signature string, slot bigint").parquet(target)


# -- lines that can't be read --------------------------------------------


@register(f"""SELECT * FROM ({_LEDGER_SQL} AND k % 7 <> 0)""")
def q_unreadable_rows(spark, sf_dir):
    """Landed replies of which some lines are cut: the others are there."""
    return _store_rows(_damaged(spark, sf_dir))


@register(f"""{EVENTS_SQL} SELECT 'unreadable_transactions' AS reason, '{{"signature":"tx' || slot || '","cut' AS text FROM e WHERE k % 7 = 0""")
def q_unreadable_lines(spark, sf_dir):
    """Each line that is cut is one reject, with its text, however often its folder is read."""
    rejects = _damaged(spark, sf_dir).table("_rejects").where("reason = 'unreadable_transactions'")
    return rejects.select("reason", F.get_json_object("detail", "$.text").alias("text"))


def _damaged(spark: SparkSession, sf_dir: str) -> st.Store:
    """Event replies as lines of JSON; every seventh is cut. Two backfills read them all."""
    events = inp.table(spark, sf_dir, "events").select(F.concat(F.lit("tx"), "event_id").alias("signature"), inp.k().alias("k"))
    replies = inp.event_transactions(spark, sf_dir).join(events, "signature")
    line = F.to_json(F.struct(*(c for c in replies.columns if c != "k")))
    cut = F.concat(F.lit('{"signature":"'), "signature", F.lit('","cut'))
    path = shared_folder(spark, "damaged")
    replies.select(F.when(F.col("k") % 7 == 0, cut).otherwise(line).alias("value")).write.text(path)
    store, feed = _new_store(spark, "damaged-store"), inp.event_feed(spark, sf_dir)
    tip = feed.agg(F.max("slot")).first()[0]
    for run, slots in (("low", (0, tip // 2)), ("high", (tip // 2 + 1, tip))):
        ingestion.backfill(
            store, feed, readers.read_transactions(spark, path), None, run, slots=slots, on_error="quarantine",
            unreadable=readers.unreadable_lines(spark, path, "transactions"))
    return store


# -- kept statistics -----------------------------------------------------


@register("""SELECT event_type AS instruction, CAST(count(*) FILTER (k > 1) AS VARCHAR) AS count,
  CAST(count(DISTINCT user_id) FILTER (k > 1) AS VARCHAR) AS unique_signers, CAST(max(event_id) FILTER (k > 1) AS VARCHAR) AS latest_slot
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type""")
def q_store_stats_kept(spark, sf_dir):
    """Statistics of many batches, some of them compacted, from what each batch counted."""
    store, replies = _new_store(spark, "counted"), _landed_replies(spark, sf_dir)
    tip = replies.agg(F.max("slot")).first()[0]
    for part in range(4):
        own = replies.where((F.col("slot") > tip * part // 4 - (part == 0)) & (F.col("slot") <= tip * (part + 1) // 4))
        ingestion.ingest(store, own, None, "part", part, on_error="quarantine")
        if part == 2:
            store.compact(st.ANY_BYTES)
    if store.signer_counts(store.program) is None:
        raise RuntimeError("a batch did not count its signers")
    return q.instruction_stats(store, store.program)
