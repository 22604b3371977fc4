import base64
import datetime as dt
import json

import pytest

from ledgerloom.operators import query as q
from ledgerloom.operators.catalog import Program
from ledgerloom.plans import ingest as ing
from ledgerloom.plans.store import Store, stored_program
from ledgerloom.sources import readers, schemas
from ledgerloom.streaming import realtime as rt
from tests import sample

UNKNOWN = sample.base58(bytes.fromhex("deadbeefdeadbeef01"))


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.TRANSACTIONS)


@pytest.fixture
def store(spark, tmp_path):
    out = Store(spark, str(tmp_path / "store"), Program.from_idl(sample.IDL), slots_per_bucket=10)
    out.open(json.dumps(sample.IDL))
    return out


def infos(spark, signature="sig-1"):
    good = base64.b64encode(sample.vault()).decode()
    zero = base64.b64encode(bytes(8)).decode()
    value = [
        {"owner": sample.PROGRAM, "data": json.dumps([good, "base64"])},
        {"owner": "ForeignProgram", "data": json.dumps([good, "base64"])},
        {"owner": sample.PROGRAM, "data": json.dumps([zero, "base64"])},
        {"owner": sample.PROGRAM, "data": json.dumps(["payload", "jsonParsed"])},
        None,
    ]
    keys = ["vault-1", "k-foreign", "k-zero", "k-parsed", "k-none"]
    return spark.createDataFrame([(signature, keys, value)], schemas.ACCOUNT_INFOS)


def golden(signature="sig-1", slot=88, **more):
    return sample.transaction(
        signature, slot,
        [(1, [2], sample.deposit()), (1, [2], UNKNOWN), (3, [2], sample.deposit())],
        inner=[[(1, [2], sample.deposit(amount=7))]], **more,
    )


def test_only_program_instructions_are_stored_and_checkpoint_moves(spark, store):
    keys = ["signer-1", sample.PROGRAM, "vault-1", "k-foreign", "k-zero", "k-parsed", "k-none"]
    reply = golden(keys=keys)
    reply["transaction"]["message"]["instructions"][0]["accounts"] = [2, 3, 4, 5]
    reply["transaction"]["message"]["instructions"][2]["programIdIndex"] = 7
    assert ing.ingest(store, frame(spark, [reply]), infos(spark), "run")
    rows = store.instruction("deposit").orderBy("_ix_ordinal").collect()
    assert [(r.amount, r.memo, r.flag, r.metadata) for r in rows] == [
        (11, "hi", True, '{"level":"9"}'), (7, "hi", True, '{"level":"9"}')]
    assert {(r.slot, r.signer, r.tx_signature) for r in rows} == {(88, "signer-1", "sig-1")}
    assert store.instruction("withdraw").isEmpty()
    assert store.checkpoint().first().last_processed_slot == 88
    account = store.account("VaultAccount").collect()
    assert [(a.pubkey, a.slot, a.authority, a.nickname, a.metadata) for a in account] == [
        ("vault-1", 88, sample.base58(b"\1" * 32), "nick", '{"level":"5"}')]
    reasons = sorted(r.reason for r in store.table("_rejects").collect())
    assert reasons == ["bad_encoding", "unknown_discriminator", "unknown_discriminator"]


def test_a_failed_batch_is_invisible_and_a_retry_is_whole(spark, store):
    cut = sample.base58(bytes.fromhex("f223c68952e1f2b6") + b"\1\2")
    bad = sample.transaction("sig-bad", 22, [(1, [], cut)])
    good = sample.transaction("sig-good", 21, [(1, [], sample.deposit())])
    with pytest.raises(Exception, match="Cannot decode deposit in transaction sig-bad"):
        ing.ingest(store, frame(spark, [good, bad]), None, "run")
    assert store.instruction("deposit").isEmpty()
    assert store.checkpoint().isEmpty()
    assert ing.ingest(store, frame(spark, [good, bad]), None, "run", on_error="quarantine")
    assert [r.tx_signature for r in store.instruction("deposit").collect()] == ["sig-good"]
    assert [(r.reason, r.tx_signature) for r in store.table("_rejects").collect()] == [
        ("decode_error", "sig-bad")]
    assert store.checkpoint().first().last_processed_slot == 22
    assert not ing.ingest(store, frame(spark, [good]), None, "run")
    assert store.instruction("deposit").count() == 1


def test_missing_signer_stops_the_batch(spark, store):
    reply = sample.transaction("sig-none", 15, [], keys=[])
    with pytest.raises(Exception, match="Missing signer for transaction sig-none"):
        ing.ingest(store, frame(spark, [reply]), None, "run")
    assert ing.ingest(store, frame(spark, [reply]), None, "run", on_error="quarantine")
    assert [r.reason for r in store.table("_rejects").collect()] == ["missing_signer"]


def test_failed_transactions_are_kept_by_default(spark, store):
    replies = [sample.transaction("ok", 1, [(1, [], sample.withdraw())]),
               sample.transaction("failed", 2, [(1, [], sample.withdraw())], err="x")]
    ing.ingest(store, frame(spark, replies), None, "all")
    assert store.instruction("withdraw").count() == 2
    again = Store(spark, store.root + "2", store.program)
    again.open("{}")
    ing.ingest(again, frame(spark, replies), None, "all", include_failed=False)
    assert [r.tx_signature for r in again.instruction("withdraw").collect()] == ["ok"]
    assert again.table("_processed").count() == 2


def feed(spark, entries):
    return spark.createDataFrame(
        [(s, slot, i) for i, (s, slot) in enumerate(entries)], schemas.SIGNATURES)


def test_backfill_modes_resume_and_unresolved(spark, store):
    entries = [("sig-4", 40), ("sig-3", 30), ("sig-2", 20), ("sig-1", 10)]
    replies = [sample.transaction(s, slot, [(1, [], sample.withdraw(slot))]) for s, slot in entries]
    one = feed(spark, entries)
    landed = frame(spark, [r for r in replies if r["signature"] != "sig-3"])
    assert ing.backfill(store, one, landed, None, "a", slots=(15, 35))
    assert [r.tx_signature for r in store.instruction("withdraw").collect()] == ["sig-2"]
    assert [r.signature for r in store.unresolved().collect()] == ["sig-3"]
    # The waiting transaction is found by the next run whatever that run selects.
    assert ing.backfill(store, one, frame(spark, replies), None, "b", signatures=["sig-1", " sig-1 ", ""])
    assert sorted(r.tx_signature for r in store.instruction("withdraw").collect()) == [
        "sig-1", "sig-2", "sig-3"]
    assert store.unresolved().isEmpty()
    assert store.checkpoint().first().last_processed_slot == 20
    assert ing.backfill(store, one, frame(spark, replies), None, "c", between=("sig-4", "sig-1"))
    assert store.instruction("withdraw").count() == 3
    assert ing.catch_up(store, one, frame(spark, replies), None, "d")
    assert store.instruction("withdraw").count() == 4
    assert store.checkpoint().first().last_processed_slot == 40
    assert not ing.backfill(store, one, landed, None, "e", signatures=[])
    with pytest.raises(ValueError, match="exactly one"):
        ing.backfill(store, one, landed, None, "f")


def test_order_within_a_slot_follows_the_feed(spark, store):
    entries = [("new", 5), ("old", 5)]
    replies = [sample.transaction(s, 5, [(1, [], sample.withdraw(1)), (1, [], sample.withdraw(2))],
                                  feed_pos=i) for i, (s, _) in enumerate(entries)]
    ing.ingest(store, frame(spark, replies), None, "run")
    for order, want in (("asc", [("old", 1), ("old", 2), ("new", 1), ("new", 2)]),
                        ("desc", [("new", 2), ("new", 1), ("old", 2), ("old", 1)])):
        rows = q.list_instructions(store, store.program, "withdraw", {"order": order}).collect()
        assert [(r.tx_signature, int(r.amount)) for r in rows] == want


def test_live_stream_dedupes_skips_malformed_and_equals_batch(spark, store, tmp_path):
    replies = [sample.transaction(f"sig-{i}", 10 + i, [(1, [], sample.withdraw(i))]) for i in (1, 2, 3)]
    ing.ingest(store, frame(spark, replies[2:]), None, "before")
    notes = [("sig-1", 11), ("sig-1", 12), (None, None), ("sig-2", 13), ("sig-3", 13)]
    landing = tmp_path / "notes"
    landing.mkdir()
    stamp = dt.datetime(2024, 1, 1).isoformat()
    (landing / "1.json").write_text("\n".join(json.dumps({
        "context": {"slot": slot}, "value": {"signature": s}, "received_at": stamp}) for s, slot in notes))

    def run():
        stream = readers.stream_notifications(spark, str(landing))
        query = rt.follow(store, stream, lambda: frame(spark, replies), None, "live",
                          str(tmp_path / "checkpoint"), trigger={"availableNow": True})
        query.awaitTermination()

    run()
    assert sorted(r.tx_signature for r in store.instruction("withdraw").collect()) == [
        "sig-1", "sig-2", "sig-3"]
    (landing / "2.json").write_text(json.dumps({
        "context": {"slot": 14}, "value": {"signature": "sig-2"}, "received_at": stamp}))
    run()
    assert store.instruction("withdraw").count() == 3
    raw = spark.read.schema(schemas.NOTIFICATIONS).json(str(landing))
    assert rt.malformed(raw).count() == 1


def test_another_program_needs_an_explicit_reset(spark, store, tmp_path):
    ing.ingest(store, frame(spark, [golden()]), None, "run")
    assert stored_program(spark, store.root).first().program_id == sample.PROGRAM
    other = {**sample.IDL, "address": "Other"}
    new = Store(spark, store.root, Program.from_idl(other))
    with pytest.raises(ValueError, match="reset=True"):
        new.open(json.dumps(other))
    new.open(json.dumps(other), reset=True)
    assert stored_program(spark, store.root).first().program_id == "Other"
    assert new.instruction("deposit").isEmpty()


def test_slot_bounds_prune_whole_buckets_only(spark, store):
    slots = [0, 9, 10, 19, 25, 2**53 + 3]
    replies = [sample.transaction(f"s{n}", n, [(1, [], sample.withdraw(1))]) for n in slots]
    ing.ingest(store, frame(spark, replies), None, "run")
    for low, high in [(0, 9), (9, 10), (10, 25), (20, 2**53 + 3), (2**53 + 3, 2**53 + 3)]:
        request = {"from_slot": str(low), "to_slot": str(high), "order": "asc"}
        rows = q.list_instructions(store, store.program, "withdraw", request).collect()
        assert [r.slot for r in rows] == [n for n in slots if low <= n <= high]
    bounded = q.list_instructions(store, store.program, "withdraw", {"from_slot": "10", "to_slot": "25"})
    plan = bounded._jdf.queryExecution().executedPlan().toString()
    assert "slot_bucket" in plan and "PartitionFilters" in plan
