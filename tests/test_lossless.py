"""What must never be lost: late, waiting, clashing, listed, renamed and compacted rows."""

import datetime as dt
import json
from pathlib import Path

import pytest

from ledgerloom.functions.borsh import At, Layout
from ledgerloom.operators import query as q
from ledgerloom.operators.catalog import Program
from ledgerloom.plans import ingest as ing
from ledgerloom.plans.store import Store
from ledgerloom.sources import readers
from ledgerloom.sources.tables import FrameTables
from ledgerloom.streaming import realtime as rt
from tests import sample
from tests.test_ingest import feed, frame

STAMP = dt.datetime(2024, 1, 1, 12)


@pytest.fixture
def store(spark, tmp_path):
    out = Store(spark, str(tmp_path / "store"), Program.from_idl(sample.IDL), slots_per_bucket=10)
    out.open(json.dumps(sample.IDL))
    return out


def reply(signature, slot):
    return sample.transaction(signature, slot, [(1, [], sample.withdraw(slot))])


def signatures(store):
    return sorted(r.tx_signature for r in store.instruction("withdraw").collect())


def announce(folder, name, *notes):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({
        "context": {"slot": slot}, "value": {"signature": s}, "received_at": at.isoformat()}) for s, slot, at in notes))


def test_late_notices_are_processed_and_malformed_ones_are_rejects(spark, store, tmp_path):
    replies = frame(spark, [reply("sig-4", 40), reply("sig-2", 20), reply("sig-3", 30)])
    landing = tmp_path / "notes"

    def run():
        rt.follow(store, readers.stream_notifications(spark, str(landing)), lambda: replies, None, "live",
                  str(tmp_path / "state"), trigger={"availableNow": True}).awaitTermination()

    announce(landing, "1.json", ("sig-4", 40, STAMP), ("sig-2", 20, STAMP), (None, 41, STAMP))
    run()
    announce(landing, "2.json", ("sig-3", 30, STAMP - dt.timedelta(hours=3)))
    run()
    assert signatures(store) == ["sig-2", "sig-3", "sig-4"]
    assert [(r.slot, r.reason) for r in store.table("_rejects").collect()] == [(41, "malformed_notification")]


def test_the_live_path_retries_what_had_not_landed(spark, store, tmp_path):
    landing, landed = tmp_path / "notes", [reply("sig-2", 20)]

    def run():
        rt.follow(store, readers.stream_notifications(spark, str(landing)), lambda: frame(spark, landed), None,
                  "live", str(tmp_path / "state"), trigger={"availableNow": True}).awaitTermination()

    announce(landing, "1.json", ("sig-1", 10, STAMP), ("sig-2", 20, STAMP))
    run()
    assert [r.signature for r in store.unresolved().collect()] == ["sig-1"]
    landed += [reply("sig-1", 10), reply("sig-3", 30)]
    announce(landing, "2.json", ("sig-3", 30, STAMP))
    run()
    assert signatures(store) == ["sig-1", "sig-2", "sig-3"]
    assert store.unresolved().isEmpty()


def test_retried_signatures_leave_the_checkpoint_alone(spark, store):
    one = feed(spark, [("sig-4", 40), ("sig-3", 30), ("sig-2", 20)])
    ing.backfill(store, one, frame(spark, []), None, "a", signatures=["sig-4"])
    replies = frame(spark, [reply("sig-4", 40), reply("sig-3", 30), reply("sig-2", 20)])
    ing.backfill(store, one, replies, None, "b", slots=(15, 25))
    assert store.checkpoint().first().last_processed_slot == 20
    assert ing.catch_up(store, one, replies, None, "c")
    assert signatures(store) == ["sig-2", "sig-3", "sig-4"]


def test_a_feed_behind_the_checkpoint_and_options_reach_catch_up(spark, store, tmp_path):
    cut = sample.transaction("sig-cut", 35, [(1, [], sample.base58(bytes.fromhex("b712469c946da122") + b"\1"))])
    replies = frame(spark, [reply("sig-4", 40), cut])
    ing.ingest(store, frame(spark, [reply("sig-3", 30)]), None, "run")
    assert store.checkpoint().first().last_processed_slot == 30
    ing.catch_up(store, feed(spark, [("sig-1", 10)]), replies, None, "behind")
    assert signatures(store) == ["sig-3"]
    landing = tmp_path / "notes"
    announce(landing, "1.json", ("sig-4", 40, STAMP))
    rt.catch_up_then_follow(
        store, lambda: feed(spark, [("sig-4", 40), ("sig-cut", 35)]), readers.stream_notifications(spark, str(landing)),
        lambda: replies, None, "live", str(tmp_path / "state"), trigger={"availableNow": True}, on_error="quarantine",
    ).awaitTermination()
    assert signatures(store) == ["sig-3", "sig-4"]
    assert [r.tx_signature for r in store.table("_rejects").collect()] == ["sig-cut"]


def test_bucket_width_is_kept_with_the_tables(spark, store):
    ing.ingest(store, frame(spark, [reply("sig-1", 55)]), None, "run")
    again = Store(spark, store.root, store.program)
    assert again.slots_per_bucket == 10
    assert again.instruction("withdraw", high=60).count() == 1
    with pytest.raises(ValueError, match="10 slots per bucket"):
        Store(spark, store.root, store.program, slots_per_bucket=1000)


def test_names_of_one_table_and_escaped_names_keep_their_rows(spark, tmp_path):
    import hashlib

    idl = {"address": sample.PROGRAM, "instructions": [
        {"name": n, "args": [{"name": "amount", "type": "u64"}]} for n in ("doThing", "do_thing", "pay:now")]}
    data = lambda n: sample.base58(hashlib.sha256(f"global:{n}".encode()).digest()[:8] + bytes(8))
    out = Store(spark, str(tmp_path / "store"), Program.from_idl(idl))
    out.open(json.dumps(idl))
    one = sample.transaction("sig-1", 1, [(1, [], data(n)) for n in ("doThing", "do_thing", "pay:now")])
    ing.ingest(out, frame(spark, [one]), None, "run")
    assert out.instruction("doThing").count() == 2
    assert out.instruction("pay:now").count() == 1
    assert out.table("_rejects").isEmpty()


def test_listed_signatures_count_without_the_feed(spark, store):
    wanted = spark.createDataFrame([("sig-2",), (" sig-9 ",), ("sig-2",)], "signature string")
    assert ing.backfill(store, feed(spark, [("sig-1", 10)]), frame(spark, [reply("sig-2", 20)]), None, "a", signatures=wanted)
    assert signatures(store) == ["sig-2"]
    assert [r.signature for r in store.unresolved().collect()] == ["sig-9"]
    assert store.checkpoint().isEmpty()


def test_a_changed_interface_is_refused(spark, store):
    ing.ingest(store, frame(spark, [reply("sig-1", 1)]), None, "run")
    changed = json.loads(json.dumps(sample.IDL))
    changed["instructions"][1]["args"][0]["type"] = "string"
    with pytest.raises(ValueError, match="changed stored columns.*amount"):
        Store(spark, store.root, Program.from_idl(changed)).open(json.dumps(changed))


def test_text_that_is_no_base58_fails_or_is_a_reject(spark, store):
    bad = sample.transaction("sig-bad", 5, [(1, [], "0OIl")])
    with pytest.raises(Exception, match="(?i)base58|encoding|decode"):
        ing.ingest(store, frame(spark, [bad]), None, "run")
    ing.ingest(store, frame(spark, [bad]), None, "run", on_error="quarantine")
    assert [r.reason for r in store.table("_rejects").collect()] == ["bad_encoding"]


def test_compaction_keeps_rows_commits_and_open_readers(spark, store):
    assert not store.compact()
    for k in range(4):
        ing.ingest(store, frame(spark, [reply(f"sig-{k}", 10 * k)]), None, "many", k)
    ing.backfill(store, feed(spark, [("sig-w", 35)]), frame(spark, []), None, "wait", signatures=["sig-w"])
    want, before = signatures(store), store.instruction("withdraw")
    assert store.compact()
    assert signatures(store) == want == sorted(r.tx_signature for r in before.collect())
    assert store.checkpoint().first().last_processed_slot == 30
    assert [r.signature for r in store.unresolved().collect()] == ["sig-w"]
    assert not ing.ingest(store, frame(spark, [reply("sig-0", 0)]), None, "many", 0)
    assert store.vacuum() == 0
    assert store.vacuum(older_than_hours=0) > 0
    folders = list(Path(store.home, "ix_withdraw").glob("batch=*"))
    assert len(folders) == 1
    assert signatures(store) == want
    ing.ingest(store, frame(spark, [reply("sig-9", 90)]), None, "many", 9)
    assert store.compact()
    assert signatures(store) == [*want, "sig-9"]
    assert store.table("_processed").count() == 5
    assert not store.compact()


def test_stored_files_carry_bloom_filters(spark, store):
    ing.ingest(store, frame(spark, [reply(f"sig-{k}", 1) for k in range(300)]), None, "run")
    file = next(Path(store.home, "ix_withdraw").rglob("*.parquet"))
    jvm = spark._jvm
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(
        jvm.org.apache.hadoop.fs.Path(str(file)), spark._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    columns = reader.getFooter().getBlocks().get(0).getColumns()
    offsets = {columns.get(i).getPath().toDotString(): columns.get(i).getBloomFilterOffset() for i in range(columns.size())}
    reader.close()
    assert offsets["tx_signature"] > 0
    assert offsets["slot"] < 0


def test_numeric_order_is_exact(spark):
    program = Program.from_idl({"address": "p", "instructions": [{"name": "pay", "args": [{"name": "amount", "type": "i64"}]}]})
    amounts = {"a": 2**53, "b": 2**53 + 1, "c": -5, "d": -40, "e": 7, "f": None}
    rows = spark.createDataFrame([(s, v) for s, v in amounts.items()], "signer string, amount bigint")
    tables = FrameTables(spark, {"pay": rows})
    request = {"metric": "max", "field": "amount", "group_by": "signer"}
    got = q.aggregate(tables, program, "pay", request, numeric_order=True).collect()
    assert [r.signer for r in got] == ["f", "b", "a", "e", "c", "d"]


def test_json_floats_have_javascript_form(spark):
    import struct

    from pyspark.sql import functions as F

    cases = {5.0: "5", -0.0: "0", 2.5: "2.5", 1e-6: "0.000001", 1.5e-7: "1.5e-7", 1e20: "100000000000000000000",
             1e21: "1e+21", -1.25e300: "-1.25e+300", 123456789012345.0: "123456789012345", float("nan"): "null",
             float("inf"): "null", 0.1: "0.1", 1234567.125: "1234567.125"}
    rows = spark.createDataFrame([(struct.pack("<d", v), want) for v, want in cases.items()], "p binary, want string")
    got = rows.select("want", F.expr(Layout({}).json_text("f64", "p", At())).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
