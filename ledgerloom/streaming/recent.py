"""Live dedupe by count: a notice is dropped if its signature is among the last N admitted.

First in, first out: a repeat neither renews a signature's place nor is remembered, and
the oldest one is forgotten when one too many has been admitted.

The signatures are the list state of a group, one group a lane. A single lane is exactly
one queue of N for the whole stream, and one task a batch. With more lanes, dealt by
signature, each has a queue of N of its own: a signature is remembered at least as long
as in the single queue, the state is bounded by lanes x N, and lanes run side by side.

The state store must support list state, as RocksDB does (`for_list_state`).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = "slot bigint, signature string, received_at timestamp"


def for_list_state(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB."""
    own = spark.newSession()
    own.conf.set(STATE_STORE, ROCKS_DB)
    return own


class LastSignatures(StatefulProcessor):
    """One queue: the signatures admitted last, oldest first."""

    def __init__(self, remember: int):
        self.remember = remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.admitted = handle.getListState("admitted", "signature string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # The queue is read and written once a batch. A batch is bounded by its trigger's
        # options; inside it notices count in the order they were received.
        batch = pd.concat(list(rows)).sort_values(["received_at", "slot", "signature"], kind="stable")
        queue = deque(row[0] for row in self.admitted.get())
        known = set(queue)
        first = []
        for signature in batch["signature"]:
            new = signature not in known
            first.append(new)
            if new:
                known.add(signature)
                queue.append(signature)
                if len(queue) > self.remember:
                    known.discard(queue.popleft())
        self.admitted.put([(signature,) for signature in queue])
        yield batch.loc[first, ["slot", "signature", "received_at"]]

    def close(self) -> None:
        pass


def first_of_recent(notifications: DataFrame, remember: int = 10_000, lanes: int = 1) -> DataFrame:
    """Notifications without repeats of the last `remember` signatures. Malformed ones stay."""
    if remember < 1 or lanes < 1:
        raise ValueError("remember and lanes must be positive")
    signature, slot = F.col("value.signature"), F.col("context.slot")
    formed = F.coalesce(signature != "", F.lit(False)) & slot.isNotNull()
    flat = notifications.where(formed).select(slot.alias("slot"), signature.alias("signature"), "received_at")
    lane = F.pmod(F.xxhash64("signature"), F.lit(lanes)).cast("int")
    first = (
        flat.withColumn("lane", lane).groupBy("lane")
        .transformWithStateInPandas(LastSignatures(remember), ROWS, "Append", "None")
    )
    admitted = first.select(
        F.struct("slot").alias("context"), F.struct("signature").alias("value"), "received_at"
    )
    return admitted.unionByName(notifications.where(~formed), allowMissingColumns=True)
