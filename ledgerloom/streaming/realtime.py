"""Live ingestion: notifications -> dedupe -> the batch path, per micro-batch."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ledgerloom.operators import selection as sel
from ledgerloom.plans.ingest import catch_up, ingest, resolve
from ledgerloom.plans.store import Store
from ledgerloom.streaming.recent import first_of_recent

log = logging.getLogger(__name__)


def _signature():
    return F.col("value.signature")


def _is_well_formed():
    return F.coalesce(_signature() != "", F.lit(False)) & F.col("context.slot").isNotNull()


def well_formed(notifications: DataFrame) -> DataFrame:
    """Notifications with a signature and a slot."""
    return notifications.where(_is_well_formed()).select(
        _signature().alias("signature"), F.col("context.slot").alias("slot"), "received_at"
    )


def malformed(notifications: DataFrame) -> DataFrame:
    """The rest, as rejects; lines that could not be read keep their file and text."""
    corrupt = F.col("corrupt") if "corrupt" in notifications.columns else F.lit(None).cast("string")
    reason = F.when(corrupt.isNotNull(), "unreadable_notification").otherwise("malformed_notification")
    return notifications.where(~_is_well_formed()).select(
        F.col("context.slot").alias("slot"), _signature().alias("tx_signature"),
        reason.alias("reason"), corrupt.alias("detail"),
    )


def dedupe(notices: DataFrame, window: str = "1 hour", salts: int = 16) -> DataFrame:
    """The first notification of each signature within a time window.

    State is bounded by time, not by count. A signature repeated very often is first
    thinned out in `salts` separate groups, so that no single task gets all of its
    rows; the second pass sees at most one row per group. A row later than the
    watermark is dropped, so this is for reports: `follow`, which must lose nothing,
    leaves repeats out by what is committed.
    """
    timed = notices.withWatermark("received_at", window)
    if salts > 1:
        salt = F.pmod(F.spark_partition_id(), F.lit(salts))
        timed = timed.withColumn("_salt", salt).dropDuplicatesWithinWatermark(["signature", "_salt"])
        timed = timed.drop("_salt")
    return timed.dropDuplicatesWithinWatermark(["signature"])


def process_batch(
    store: Store,
    run: str,
    transactions: Callable[[], DataFrame],
    infos: Callable[[], DataFrame] | None,
    retry_slots: int = 1000,
    **options,
) -> Callable[[DataFrame, int], None]:
    """foreachBatch function over raw notifications. Readers are called per batch, so
    newly landed files count.

    Repeats within a batch are folded here, and those of other batches or of a
    backfill are left out by what is committed, however late they come. Signatures
    that had not landed are tried again while their slot is within `retry_slots` of
    the batch; later backfills try them too. Scans stay within these slots. Malformed
    notifications become rejects. A replayed batch finds its own commit and does
    nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        if store.is_committed(run, batch_id):
            return
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            # Later arrivals are newer, and feed positions count from the newest.
            selected = well_formed(batch).groupBy("signature").agg(
                F.min("slot").alias("slot"), (-F.unix_micros(F.min("received_at"))).alias("feed_pos")
            )
            low, high = selected.agg(F.min("slot"), F.max("slot")).first()
            waiting, reach = None, low
            if low is not None:
                reach = low - retry_slots
                waiting = store.unresolved(reach, high)
                selected = sel.exclude_done(selected, store.table("_processed", low, high), store.program.program_id)
                selected = selected.unionByName(waiting.join(selected, "signature", "left_anti"))
            ingest(
                store, transactions(), infos() if infos else None, run, batch_id, selected=selected,
                find=lambda rows, wanted: resolve(rows, wanted, reach, high, wider=False),
                hold_last_slot=True, upto=high, more_rejects=malformed(batch), **options,
            )
        finally:
            batch.unpersist()

    return handle


def follow(
    store: Store,
    notifications: DataFrame,
    transactions: Callable[[], DataFrame],
    infos: Callable[[], DataFrame] | None,
    run: str,
    checkpoint: str,
    trigger: dict | None = None,
    remember: int | None = None,
    lanes: int = 1,
    **options,
) -> StreamingQuery:
    """Start the live query. `run` and `checkpoint` belong together across restarts.

    With `remember`, notices of the last so many signatures are dropped before they are
    looked up (see `recent`); what is committed is left out in any case.
    """
    if remember:
        notifications = first_of_recent(notifications, remember, lanes)
    return (
        notifications.writeStream.queryName(run)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(process_batch(store, run, transactions, infos, **options))
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def catch_up_then_follow(
    store: Store,
    feed: Callable[[], DataFrame],
    notifications: DataFrame,
    transactions: Callable[[], DataFrame],
    infos: Callable[[], DataFrame] | None,
    run: str,
    checkpoint: str,
    trigger: dict | None = None,
    retry_slots: int = 1000,
    remember: int | None = None,
    lanes: int = 1,
    **options,
) -> StreamingQuery:
    """Close the gap since the checkpoint, then follow; `keep_following` does so after each drop.

    The catch-up run is named by the number of commits so far, so a restart after a
    crash repeats it and a later restart begins a new one. `options` go to both.
    """
    batches = store.commits().count()
    catch_up(store, feed(), transactions(), infos() if infos else None, f"{run}-gap-{batches}", **options)
    return follow(
        store, notifications, transactions, infos, run, checkpoint, trigger=trigger, retry_slots=retry_slots,
        remember=remember, lanes=lanes, **options
    )


@dataclass(frozen=True)
class Backoff:
    """Pauses between attempts, in seconds: doubled each time, up to the longest."""

    first: float = 0.25
    longest: float = 4.0

    def pause(self, failures: int) -> float:
        # past 2**60 any first pause is beyond the longest one
        return min(self.longest, self.first * 2 ** min(failures - 1, 60))


class _Progress(StreamingQueryListener):
    """Whether the followed query has finished a batch since it was started last."""

    def __init__(self, name: str):
        self.name = name
        self.finished = threading.Event()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        if event.progress.name == self.name and event.progress.numInputRows > 0:
            self.finished.set()

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def keep_following(
    store: Store,
    feed: Callable[[], DataFrame],
    notifications: Callable[[], DataFrame],
    transactions: Callable[[], DataFrame],
    infos: Callable[[], DataFrame] | None,
    run: str,
    checkpoint: str,
    stop: threading.Event | None = None,
    attempts: int | None = None,
    backoff: Backoff = Backoff(),
    poll_seconds: float = 1.0,
    **options,
) -> int:
    """Catch up and follow, and begin again whenever the stream drops; the number of drops.

    Returns when `stop` is set, or when the query ends by itself, as with the trigger
    availableNow. Anything that fails, in the stream or in catching up, counts as a
    drop. After `attempts` drops in a row without a finished batch between them the last
    error is raised (None: never). A dropped batch had not been committed, so the next
    catch-up or the replay of the batch processes it, and what is committed is left out.
    """
    stop = stop or threading.Event()
    streams = store.spark.streams
    progress = _Progress(run)
    streams.addListener(progress)
    drops = failures = 0
    try:
        while not stop.is_set():
            progress.finished.clear()
            try:
                query = catch_up_then_follow(
                    store, feed, notifications(), transactions, infos, run, checkpoint, **options
                )
                try:
                    while not query.awaitTermination(poll_seconds):
                        if stop.is_set():
                            break
                    else:
                        return drops
                finally:
                    query.stop()
            except Exception as error:  # whatever dropped the stream, the next attempt may succeed
                drops += 1
                failures = 1 if progress.finished.is_set() else failures + 1
                if attempts is not None and failures >= attempts:
                    raise
                pause = backoff.pause(failures)
                log.warning("%s dropped (%s), again in %.2f s", run, type(error).__name__, pause)
                stop.wait(pause)
        return drops
    finally:
        streams.removeListener(progress)
