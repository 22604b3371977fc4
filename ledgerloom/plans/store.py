"""Tables of one program as files, with all-or-nothing commits.

Every write of a batch goes to a directory of its own attempt, and the batch
becomes visible in all tables at once when one row naming that attempt is
appended to `_commits`. A failed or repeated attempt leaves files nobody reads,
so nothing is overwritten and a retry is safe.

    <root>/_programs                              interface log, all programs
    <root>/<program_id>/_commits                  one row per committed batch
    <root>/<program_id>/<table>/batch=../slot_bucket=../last_bucket=../part-*.parquet

A folder holds the slot buckets from the first to the last that it names. How many that
are is settled for each batch, so that a table of a batch has a bounded number of folders
however many slots the batch touches.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from functools import reduce
from urllib.parse import unquote

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import coverage
from ledgerloom.operators.catalog import Program
from ledgerloom.operators.selection import exclude_done
from ledgerloom.sources.tables import union_signers

SLOTS_PER_BUCKET = 100_000
COMMITS = (
    "program_id string, run string, batch_id bigint, batch string, contiguous boolean, "
    "last_whole_slot bigint, from_slot bigint, to_slot bigint, retired array<string>, counted boolean, "
    "committed_at timestamp"
)
COMPACTION = "_compaction"
# Folders of one table of a batch, at most.
FOLDERS = 64
LAST_SLOT = 2**63 - 1
SMALL_BYTES = 256 << 20
ANY_BYTES = 2**63 - 1
# Columns that requests look single values up by; their files carry bloom filters.
LOOKUPS = ("tx_signature", "signer")
PROCESSED = "program_id string, tx_signature string, slot bigint"
UNRESOLVED = "signature string, slot bigint, feed_pos bigint"
REJECTS = "slot bigint, tx_signature string, reason string, detail string"
# Instructions that gave no row, with what a later interface needs to try them again.
UNDECODED = (
    "slot bigint, tx_signature string, tx_pos bigint, ix_ordinal int, signer string, reason string, detail string, payload binary"
)
REPLAYED = "slot bigint, tx_signature string, ix_ordinal int"
# Partial statistics: rows and newest slot of each instruction and signer of a batch.
STATS = "instruction string, signer string, rows bigint, slot bigint"
PROGRAMS = "program_id string, idl string, from_slot bigint, written_at timestamp"
SERVICE_TABLES = {
    "_processed": PROCESSED, "_unresolved": UNRESOLVED, "_rejects": REJECTS, "_undecoded": UNDECODED,
    "_replayed": REPLAYED, "_stats": STATS,
}


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under a path."""
    files, target = _files(spark, path)
    if not files.exists(target):
        return []
    return [s.getPath().getName() for s in files.listStatus(target) if s.isDirectory()]


def ensure_folders(spark: SparkSession, paths: list[str]) -> None:
    """Make the folders that are missing, so that readers find them even without rows."""
    for path in paths:
        files, target = _files(spark, path)
        files.mkdirs(target)


# -- program registry ----------------------------------------------------


def upsert_program(spark: SparkSession, root: str, program_id: str, idl: str, from_slot: int | None = None) -> None:
    """Add an interface to the log; readers see the latest one. With from_slot it is a version
    of its own, in force from that slot on."""
    row = spark.createDataFrame([(program_id, idl, from_slot)], "program_id string, idl string, from_slot bigint")
    row.withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(
        f"{root}/_programs"
    )


def forget_programs(spark: SparkSession, root: str, program_ids: list[str]) -> None:
    """Mark programs as gone, all in one write. What the log says of them before no longer counts."""
    rows = spark.createDataFrame([(p, None, None) for p in program_ids], "program_id string, idl string, from_slot bigint")
    rows.withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/_programs")


def _held(log: DataFrame) -> DataFrame:
    """The entries of a log since its program was marked as gone, if it ever was."""
    gone = F.max(F.when(F.col("idl").isNull(), F.col("written_at"))).over(Window.partitionBy("program_id"))
    return log.withColumn("_gone", gone).where("idl IS NOT NULL AND (_gone IS NULL OR written_at > _gone)").drop("_gone")


def program_versions(log: DataFrame) -> DataFrame:
    """(program_id, from_slot, idl): the latest interface of each version."""
    return _held(log).groupBy("program_id", "from_slot").agg(F.max_by("idl", "written_at").alias("idl"))


def latest_programs(log: DataFrame) -> DataFrame:
    """One row per program: newest interface, first and last time it was written. A program
    marked as gone (without an interface) is none until it is written again."""
    return _held(log).groupBy("program_id").agg(
        F.max_by("idl", "written_at").alias("idl"),
        F.min("written_at").alias("created_at"),
        F.max("written_at").alias("updated_at"),
    )


def program_log(spark: SparkSession, root: str) -> DataFrame:
    files, target = _files(spark, f"{root}/_programs")
    if not files.exists(target):
        return spark.createDataFrame([], PROGRAMS)
    return spark.read.schema(PROGRAMS).parquet(f"{root}/_programs")


def programs(spark: SparkSession, root: str) -> DataFrame:
    return latest_programs(program_log(spark, root))


def stored_program(spark: SparkSession, root: str) -> DataFrame:
    """The registered program, or no row."""
    return programs(spark, root).select("program_id", "idl").limit(1)


# -- checkpoints ---------------------------------------------------------


def checkpoints(commits: DataFrame) -> DataFrame:
    """Last whole slot per program. A maximum, so it never moves back; runs over an
    explicit list leave gaps and do not count."""
    return commits.where("contiguous").groupBy("program_id").agg(
        F.max("last_whole_slot").alias("last_processed_slot")
    )


def first_commits(commits: DataFrame) -> DataFrame:
    """One attempt per (run, batch_id), should two ever have been committed. Only what
    this one says counts: what another one retired was not copied by it."""
    said = ["batch", *(c for c in ("retired",) if c in commits.columns)]
    first = F.min_by(F.struct(*said), F.struct("committed_at", "batch")).alias("first")
    return commits.groupBy("program_id", "run", "batch_id").agg(first).select(
        "program_id", "run", "batch_id", *(F.col(f"first.{c}").alias(c) for c in said)
    )


def live_batches(commits: DataFrame) -> DataFrame:
    """Committed batches that no compaction has replaced."""
    first = first_commits(commits)
    live = first.select("batch")
    if "retired" not in commits.columns:
        return live
    return live.join(first.select(F.explode("retired").alias("batch")), "batch", "left_anti")


def visible(frame: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows of live batches. The commit list joins on the partition column, so
    unread batches are pruned at run time."""
    return frame.join(live_batches(commits), "batch", "left_semi")


def folder_width(lowest: int, highest: int) -> int:
    """Buckets of a folder, a power of two, so that these buckets take no more than FOLDERS."""
    width = 1
    while highest // width - lowest // width >= FOLDERS:
        width *= 2
    return width


def merged_stats(partials: DataFrame) -> DataFrame:
    """Partial statistics of several batches as one row per instruction and signer."""
    return partials.groupBy("instruction", "signer").agg(F.sum("rows").alias("rows"), F.max("slot").alias("slot"))


# -- one program's tables ------------------------------------------------


class Store:
    """Reads and writes the tables of one program; the queries take it as their tables."""

    def __init__(self, spark: SparkSession, root: str, program: Program, slots_per_bucket: int | None = None):
        self.spark = spark
        self.root = root
        self.program = program
        self.home = f"{root}/{program.program_id}"
        layout = subfolders(spark, f"{self.home}/_layout")
        # Stores of an earlier layout have a folder for each bucket, and go on like that.
        self.wide_folders = not layout or "wide_folders" in layout
        kept = self._kept_width(layout)
        if kept is not None and slots_per_bucket not in (None, kept):
            raise ValueError(f"These tables have {kept} slots per bucket, not {slots_per_bucket}")
        self.slots_per_bucket = kept or slots_per_bucket or SLOTS_PER_BUCKET

    @staticmethod
    def _kept_width(layout: list[str]) -> int | None:
        """Bucket width of existing tables; it is part of their folder."""
        found = [f for f in layout if f.startswith("slots_per_bucket=")]
        return int(found[0].split("=", 1)[1]) if found else None

    # schemas

    def schemas(self) -> dict[str, T.StructType]:
        """Every table with its derived schema."""
        return self.derived(self.program) | {n: T._parse_datatype_string(ddl) for n, ddl in SERVICE_TABLES.items()}

    def ensure_tables(self) -> None:
        """Create what is missing; running it again changes nothing."""
        wide = ["_layout/wide_folders"] if self.wide_folders else []
        names = [*self.schemas(), "_commits", *wide, f"_layout/slots_per_bucket={self.slots_per_bucket}"]
        ensure_folders(self.spark, [f"{self.home}/{name}" for name in names])

    def open(self, idl: str, reset: bool = False, from_slot: int | None = None) -> None:
        """Register the interface and make its tables.

        With `from_slot` it is a version of its own, in force from that slot on: what is
        older is still decoded by the versions before it, the tables get the columns of
        all versions, and types may only grow. A store of several versions is opened with
        any of them.

        A folder serves one program at a time. Starting over with another one deletes
        the old programs' tables, nothing else that lies there, and only with reset=True.
        The old programs are marked as gone first, in one write, so a crash leaves either
        them or nothing of them to readers; the next opening deletes what is left. A new
        interface of the same program must leave the columns of existing tables as they
        are.
        """
        known = programs(self.spark, self.root)
        foreign = F.col("program_id") != self.program.program_id
        other = [r.program_id for r in known.where(foreign).select("program_id").collect()]
        if other:
            if not reset:
                raise ValueError("Another program is registered here; pass reset=True to replace it")
            forget_programs(self.spark, self.root, other)
        own = [] if reset else program_versions(program_log(self.spark, self.root)).where(~foreign).collect()
        versions = {r.from_slot: r.idl for r in own}
        if from_slot is not None and not versions:
            raise ValueError("Open the store with the first version, without from_slot, before")
        versioned = from_slot is not None or len(versions) > 1
        if versioned and from_slot is None and idl not in versions.values():
            raise ValueError("This store has several versions; a new one needs from_slot")
        if versioned:
            self._open_versions(versions, idl, from_slot)
        elif not reset and not other:
            self._check_drift(known)
        logged = program_log(self.spark, self.root).where(foreign).select("program_id").distinct().collect()
        for row in logged:
            self._drop(f"{self.root}/{row.program_id}")
        if from_slot is not None or not versioned:
            upsert_program(self.spark, self.root, self.program.program_id, idl, from_slot)
        self.ensure_tables()

    def _open_versions(self, versions: dict[int | None, str], idl: str, from_slot: int | None) -> None:
        """Take on the tables of all versions; those that exist keep their columns, or grow."""
        if from_slot is not None:
            known = [v for v in versions if v is not None]
            if from_slot not in versions and any(v >= from_slot for v in known):
                raise ValueError(f"A version is in force from slot {max(known)} already")
            versions = {**versions, from_slot: idl}
        self.program = Program.merged([(first, Program.from_idl(json.loads(text))) for first, text in versions.items()])

    def _check_drift(self, known: DataFrame) -> None:
        stored = known.where(F.col("program_id") == self.program.program_id).select("idl").first()
        try:
            old = Program.from_idl(json.loads(stored.idl)) if stored else None
        except (ValueError, KeyError, TypeError):
            return  # what is registered is no interface: there is nothing to compare
        if old is None:
            return
        was = Store.derived(old)
        changed = []
        for table, schema in Store.derived(self.program).items():
            before = {f.name: f.dataType.simpleString() for f in was[table].fields} if table in was else None
            now = {f.name: f.dataType.simpleString() for f in schema.fields}
            if before is not None and before != now and not self._is_new(table):
                names = [c for c in dict.fromkeys([*before, *now]) if before.get(c) != now.get(c)]
                changed += [f"{table}.{c}: {before.get(c, 'absent')} -> {now.get(c, 'absent')}" for c in names]
        if changed:
            raise ValueError("The interface changed stored columns: " + "; ".join(changed))

    def _is_new(self, table: str) -> bool:
        return not subfolders(self.spark, f"{self.home}/{table}")

    @staticmethod
    def derived(p: Program) -> dict[str, T.StructType]:
        """Tables of the interface with their schemas."""
        out = {p.instruction_table(n): p.instruction_schema(n) for n in p.instructions}
        return out | {p.account_table(n): p.account_schema(n) for n in p.accounts}

    def _drop(self, path: str) -> None:
        files, target = _files(self.spark, path)
        files.delete(target, True)

    # reading

    def commits(self) -> DataFrame:
        return self.spark.read.schema(COMMITS).parquet(f"{self.home}/_commits")

    def table(self, name: str, low: int | None = None, high: int | None = None) -> DataFrame:
        """Committed rows of a table; slot bounds prune whole folders, and keep whole buckets."""
        frame, width = self._stored(name), self.slots_per_bucket
        if low is not None:
            frame = frame.where((F.col(self._last_bucket()) >= low // width) & (F.col("slot") >= low // width * width))
        if high is not None:
            end = min(high // width * width + width - 1, LAST_SLOT)
            frame = frame.where((F.col("slot_bucket") <= high // width) & (F.col("slot") <= end))
        return visible(frame, self.commits()).select(*self.schemas()[name].names)

    def nearest(self, name: str, low: int | None, high: int | None, conditions: list[Column], limit: int,
                ascending: bool) -> tuple[int | None, int | None]:
        """Slot bounds inside low and high that hold the first `limit` rows of an instruction.

        Parts of the slots, each from one first bucket of a folder to the next, are looked
        at from the wanted end, each step with twice as many as the one before, until enough
        rows pass the conditions: what is read is at most about twice what is needed, not
        the whole table.
        """
        width, table = self.slots_per_bucket, self.program.instruction_table(name)
        starts = self.buckets(table)
        ends = [b * width - 1 for b in starts[1:]] + [None]
        parts = [(b * width, end) for b, end in zip(starts, ends)
                 if (low is None or end is None or end >= low) and (high is None or b <= high // width)]
        parts = parts if ascending else parts[::-1]
        passed, taken = 0, 0
        while taken < len(parts):
            step = parts[taken : 2 * taken + 1]
            taken += len(step)
            first, last = (step[0], step[-1]) if ascending else (step[-1], step[0])
            rows = self.table(table, first[0], last[1])
            for condition in conditions:
                rows = rows.where(condition)
            passed += rows.limit(limit - passed).count()
            if passed >= limit and ascending:
                return low, last[1] if high is None else high if last[1] is None else min(high, last[1])
            if passed >= limit:
                return first[0] if low is None else max(low, first[0]), high
        return low, high

    def buckets(self, table: str) -> list[int]:
        """The first slot buckets of a table's folders, of whatever batch."""
        found = set()
        for batch in subfolders(self.spark, f"{self.home}/{table}"):
            names = subfolders(self.spark, f"{self.home}/{table}/{batch}") if batch.startswith("batch=") else []
            found.update(int(n.split("=", 1)[1]) for n in names if n.startswith("slot_bucket=") and n.split("=", 1)[1].lstrip("-").isdigit())
        return sorted(found)

    def folder_columns(self) -> list[str]:
        """The columns that tell the folder of a row, of one batch."""
        return ["slot_bucket", "last_bucket"] if self.wide_folders else ["slot_bucket"]

    def _last_bucket(self) -> str:
        return self.folder_columns()[-1]

    def _stored(self, name: str) -> DataFrame:
        """All rows in a table's files, of whatever batch."""
        folders = [T.StructField(c, T.LongType()) for c in self.folder_columns()]
        stored = T.StructType([*self.schemas()[name].fields, T.StructField("batch", T.StringType()), *folders])
        return self.spark.read.schema(stored).parquet(f"{self.home}/{name}")

    def instruction(self, name, low=None, high=None) -> DataFrame:
        return self.table(self.program.instruction_table(name), low, high)

    def account(self, name, low=None, high=None) -> DataFrame:
        """Snapshots of one account type, every state that was seen."""
        self.program.account_schema(name)
        return self.table(self.program.account_table(name), low, high)

    def signers(self, program) -> DataFrame:
        return union_signers(self, program)

    def signer_counts(self, program) -> DataFrame | None:
        """(instruction, signer, rows, latest) from what each batch counted of itself; None if
        one of them did not, as in stores of an earlier layout."""
        commits = self.commits()
        uncounted = live_batches(commits).join(commits.where("counted"), "batch", "left_anti")
        if not uncounted.isEmpty():
            return None
        partials = self.table("_stats").where(F.col("instruction").isin(list(program.instructions)))
        return partials.groupBy("instruction", "signer").agg(F.sum("rows").alias("rows"), F.max("slot").alias("latest"))

    def undecoded(self) -> DataFrame:
        """Instructions that gave no row so far."""
        return self.table("_undecoded").join(self.table("_replayed"), ["tx_signature", "ix_ordinal"], "left_anti")

    def checkpoint(self, stop_at_gap: bool = False) -> DataFrame:
        """The last whole slot; with stop_at_gap the last one before any gap is left."""
        return coverage.whole_checkpoints(self.commits()) if stop_at_gap else checkpoints(self.commits())

    def missing(self) -> DataFrame:
        """Ranges (from_slot, to_slot] between committed ranges that no commit covers."""
        return coverage.missing_ranges(coverage.covered_ranges(self.commits()), self.slots_per_bucket)

    def unresolved(self, low: int | None = None, high: int | None = None) -> DataFrame:
        """Signatures of earlier runs whose transactions had not landed then.

        Slot bounds prune both tables. Without them the committed side is still cut
        down to the slots that wait.
        """
        waiting = self.table("_unresolved", low, high).groupBy("signature").agg(
            F.max("slot").alias("slot"), F.max("feed_pos").alias("feed_pos")
        )
        return exclude_done(waiting, self.processed(waiting), self.program.program_id)

    def processed(self, selected: DataFrame) -> DataFrame:
        """Committed transactions in the slots of a selection; all if a slot is unknown."""
        low, high, unknown = selected.agg(
            F.min("slot"), F.max("slot"), F.count_if(F.col("slot").isNull())
        ).first()
        return self.table("_processed") if unknown else self.table("_processed", low, high)

    # writing

    def is_committed(self, run: str, batch_id: int) -> bool:
        same = (F.col("run") == run) & (F.col("batch_id") == batch_id)
        return not self.commits().where(same).isEmpty()

    def attempt(self, run: str, batch_id: int) -> Attempt:
        return Attempt(self, run, batch_id)

    # upkeep

    def begin_compaction(self, small_bytes: int = SMALL_BYTES) -> Compaction | None:
        """The live batches of less than small_bytes, to be written as one; None if there
        are fewer than two. Larger ones stay, so the store is not rewritten each time.

        The names of the live batches, and the sizes of their folders, are all that
        comes to the driver.
        """
        commits = self.commits()
        live = sorted(r.batch for r in live_batches(commits).collect())
        small = [b for b in live if self._bytes(b) < small_bytes]
        if len(small) < 2:
            return None
        number = commits.where(F.col("run") == COMPACTION).select("batch_id").distinct().count()
        return Compaction(self, number, small)

    def _bytes(self, batch: str) -> int:
        total = 0
        for name in self.schemas():
            files, target = _files(self.spark, f"{self.home}/{name}/batch={batch}")
            if files.exists(target):
                total += files.getContentSummary(target).getLength()
        return total

    def compact(self, small_bytes: int = SMALL_BYTES) -> bool:
        """Rewrite small live batches as one; False if there are fewer than two.

        One commit row shows the new batch and retires the old ones together, so
        readers see equal rows before, during and after. Batches committed meanwhile
        stay as they are. Signatures that waited and have been found since are left
        out. Ingestion may go on. Of compactions that overlap the first to commit
        counts; the others change nothing.
        """
        compaction = self.begin_compaction(small_bytes)
        return compaction is not None and compaction.finish()

    def vacuum(self, older_than_hours: float = 24) -> int:
        """Delete the folders of batches retired, or committed in vain, at least so long
        ago; their number.

        Queries that began before a compaction may still read the old files, hence
        the delay.
        """
        due = F.col("committed_at") <= F.current_timestamp() - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(older_than_hours * 3600))
        commits = self.commits()
        first = first_commits(commits)
        old = commits.where(due).select("batch")
        retired = first.join(old, "batch", "left_semi").select(F.explode("retired").alias("batch"))
        vain = old.join(first, "batch", "left_anti")
        gone = {f"batch={r.batch}" for r in retired.union(vain).collect()}
        deleted = 0
        for name in self.schemas():
            for folder in gone.intersection(subfolders(self.spark, f"{self.home}/{name}")):
                self._drop(f"{self.home}/{name}/{folder}")
                deleted += 1
        return deleted


class Compaction:
    """One try at writing several batches as one."""

    def __init__(self, store: Store, number: int, batches: list[str]):
        self.store = store
        self.batches = batches
        self.attempt = store.attempt(COMPACTION, number)

    def finish(self) -> bool:
        """Write and commit; False if another compaction did so first."""
        store = self.store
        names = store.spark.createDataFrame([(b,) for b in self.batches], "batch string")
        held = {name: store._stored(name).join(names, "batch", "left_semi") for name in store.schemas()}
        folders = [frame.select("slot_bucket", F.col(store._last_bucket()).alias("last")) for frame in held.values()]
        bounds = reduce(DataFrame.unionAll, folders).agg(F.min("slot_bucket"), F.max("last")).first()
        self.attempt.widen(*bounds)
        frames = {name: held[name].select(*schema.names) for name, schema in store.schemas().items()}
        # What is committed only grows, so an entry that is done now stays done.
        waiting = frames["_unresolved"]
        frames["_unresolved"] = exclude_done(waiting, store.processed(waiting), store.program.program_id)
        frames["_undecoded"] = frames["_undecoded"].join(store.table("_replayed"), ["tx_signature", "ix_ordinal"], "left_anti").select(*store.schemas()["_undecoded"].names)
        frames["_replayed"] = frames["_replayed"].where("false")
        frames["_stats"] = merged_stats(frames["_stats"])
        self.attempt.write_all(frames, clustered=False)
        uncounted = names.join(store.commits().where("counted"), "batch", "left_anti")
        self.attempt.commit(False, None, retired=self.batches, counted=uncounted.isEmpty())
        winner = first_commits(store.commits()).where((F.col("run") == COMPACTION) & (F.col("batch_id") == self.attempt.batch_id))
        return winner.first().batch == self.attempt.batch


class Attempt:
    """One try at writing a batch."""

    def __init__(self, store: Store, run: str, batch_id: int):
        self.store = store
        self.run = run
        self.batch_id = batch_id
        self.batch = f"{run}-{batch_id}-{uuid.uuid4().hex[:8]}"
        self._observations: dict[str, Observation] = {}
        self._buckets: tuple[int, int] | None = None
        self._width = 1

    def widen(self, lowest: int | None, highest: int | None) -> None:
        """Make the folders of this attempt wide enough for these slot buckets as well."""
        if not self.store.wide_folders or lowest is None:
            return
        self._buckets = min(lowest, *(self._buckets or [lowest])), max(highest, *(self._buckets or [highest]))
        self._width = folder_width(*self._buckets)

    def reach(self, frame: DataFrame, *slots: str) -> None:
        """`widen` for the rows of a frame, by the columns that hold slots."""
        ends = [end(c) for c in slots for end in (F.min, F.max)]
        found = [s for s in frame.agg(*ends).first() if s is not None]
        if found:
            self.widen(*(s // self.store.slots_per_bucket for s in (min(found), max(found))))

    def stage(self, name: str, frame: DataFrame, by: str | None = None, counts: dict[str, Column] | None = None) -> DataFrame:
        """Write an intermediate table of this attempt and read it back.

        Later steps start from these files: the raw rows are not read again, and a
        lost executor costs no more than its own tasks. With `by`, rows are clustered
        by that column and by slot. This is the one exchange on the way to the final
        tables; the rebalance hint splits a value that holds most of the rows and
        packs rare ones together, so files get an even size. `counts` are aggregates
        taken while the rows are written; see `counted`.
        """
        path = self._staging(name)
        if by is None:
            self._observed(name, frame, counts).write.mode("errorifexists").parquet(path)
        else:
            clustered = self._bucketed(frame).hint("rebalance", by, "slot_bucket").sortWithinPartitions(
                by, "slot_bucket", "slot"
            )
            clustered = self._observed(name, clustered.drop(*self.store.folder_columns()), counts)
            clustered.write.mode("errorifexists").partitionBy(by).parquet(path)
        return self.store.spark.read.schema(frame.schema).parquet(path)

    def _observed(self, name: str, frame: DataFrame, counts: dict[str, Column] | None) -> DataFrame:
        if not counts:
            return frame
        self._observations[name] = Observation(f"{self.batch}/{name}")
        return frame.observe(self._observations[name], *(c.alias(n) for n, c in counts.items()))

    def counted(self, name: str) -> dict[str, int]:
        """What was counted while a table was written; nothing for a table without rows' plan."""
        return {n: v or 0 for n, v in self._observations[name].get.items()}

    def _bucketed(self, frame: DataFrame) -> DataFrame:
        # Whole-number division: a double would round the largest slots.
        size = F.lit(self.store.slots_per_bucket).cast("bigint")
        slot = F.col("slot").cast("bigint")
        bucket = F.call_function("div", slot - F.pmod(slot, size), size)
        if not self.store.wide_folders:
            return frame.withColumn("slot_bucket", bucket)
        width = F.lit(self._width).cast("bigint")
        first = bucket - F.pmod(bucket, width)
        return frame.withColumns({"slot_bucket": first, "last_bucket": first + width - 1})

    def staged_values(self, name: str, by: str) -> list[str]:
        """Partition values of a staged table, as they were before they became folder names."""
        folders = subfolders(self.store.spark, self._staging(name))
        return [unquote(f.split("=", 1)[1]) for f in folders if f.startswith(f"{by}=")]

    def _staging(self, name: str) -> str:
        return f"{self.store.home}/_staging/{self.batch}/{name}"

    def write(self, table: str, frame: DataFrame, clustered: bool = False) -> None:
        """Write rows of a table by slot bucket, and count them. Rows read from a clustered
        staging table are in place already; others are brought together first."""
        rows = self._bucketed(frame)
        if not clustered:
            rows = rows.hint("rebalance", "slot_bucket")
        folders = self.store.folder_columns()
        rows = self._observed(table, rows.sortWithinPartitions(*folders, "slot"), {"rows": F.count(F.lit(1))})
        writer = rows.write.mode("errorifexists").partitionBy(*folders)
        for column in set(LOOKUPS).intersection(frame.columns):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        # The smallest filter that fits is kept, so small files stay small.
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(f"{self.store.home}/{table}/batch={self.batch}")

    def write_all(self, frames: dict[str, DataFrame], clustered: bool = True) -> None:
        """Write several tables; their jobs are independent and share the cluster.
        `clustered` tells whether the program's tables come from a clustered staging."""
        with ThreadPoolExecutor(max_workers=8) as pool:
            jobs = [
                pool.submit(
                    inheritable_thread_target(self.store.spark)(self.write), name, frame,
                    clustered and not name.startswith("_"),
                )
                for name, frame in frames.items()
            ]
            for job in jobs:
                job.result()

    def count_signers(self) -> None:
        """Write the partial statistics of this batch, from two columns of what it has written."""
        store, schemas = self.store, self.store.schemas()
        own = []
        for name in store.program.instructions:
            table = store.program.instruction_table(name)
            path = f"{store.home}/{table}/batch={self.batch}"
            if self._observations.get(table) is not None and self.counted(table).get("rows"):
                rows = store.spark.read.schema(schemas[table]).parquet(path)
                own.append(rows.select(F.lit(name).alias("instruction"), "signer", "slot"))
        if own:
            rows = reduce(DataFrame.unionByName, own).groupBy("instruction", "signer")
            self.write("_stats", rows.agg(F.count(F.lit(1)).alias("rows"), F.max("slot").alias("slot")))

    def commit(self, contiguous: bool, last_whole_slot: int | None, retired: list[str] | None = None,
               covered: tuple[int | None, int | None] = (None, None), counted: bool = False) -> None:
        """Make the batch visible. The last write of a batch, one row in one file.

        `covered` is the range (from_slot, to_slot] that a contiguous batch covers, as far
        as it is known; see `coverage.covered_ranges`.
        """
        row = self.store.spark.createDataFrame(
            [(self.store.program.program_id, self.run, self.batch_id, self.batch, contiguous,
              last_whole_slot, *covered, retired, counted)],
            COMMITS.rsplit(",", 1)[0],
        )
        row.withColumn("committed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(
            f"{self.store.home}/_commits"
        )

    def clean(self) -> None:
        """Drop this attempt's intermediate tables."""
        with suppress(Exception):
            self.store._drop(f"{self.store.home}/_staging/{self.batch}")
