import itertools

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import selection as sel
from ledgerloom.operators import transactions as tx
from ledgerloom.plans.store import latest_programs
from ledgerloom.sources import schemas
from tests import sample


def prepared(spark, replies, program=sample.PROGRAM):
    return tx.with_program_instructions(spark.createDataFrame(replies, schemas.TRANSACTIONS), program)


def test_writable_accounts_golden(spark):
    keys = ["k0", "k1", "k2", "k3"]
    reply = sample.transaction("s", 1, [(5, [0, 1, 2, 3, 4, 5], "a"), (5, [2, 4, 99], "b")], keys=keys,
                               writable=["k4"], readonly=["P"], header=(2, 1, 1))
    rows = tx.writable_accounts(prepared(spark, [reply], "P")).orderBy("account_pos").collect()
    assert [r.pubkey for r in rows] == ["k0", "k2", "k4"]


def test_writability_by_header_for_all_small_headers(spark):
    cases = list(itertools.product(range(4), range(3), range(3), range(4), range(3)))
    frame = spark.createDataFrame(cases, "sig int, ros int, rou int, st int, lw int")
    header = F.struct(F.col("sig").alias("numRequiredSignatures"), F.col("ros").alias("numReadonlySignedAccounts"),
                      F.col("rou").alias("numReadonlyUnsignedAccounts"))
    keys = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: i.cast("string"))
    rows = frame.withColumn("keys", F.filter(keys, lambda k: k.cast("int") < F.col("st") + F.col("lw") + 1)).select(
        "*", tx.writable_by_index(F.col("keys"), header, F.col("st"), F.col("lw")).alias("w")).collect()
    for r in rows:
        for index in range(7):
            if index >= r.st:
                want = index - r.st < r.lw
            elif index < r.sig:
                want = index < r.sig - r.ros
            else:
                want = index - r.sig < r.st - r.sig - r.rou
            got = index < len(r.w) and r.w[index] is not None
            assert got == want, (r, index)


def test_missing_parts_of_a_reply(spark):
    reply = sample.transaction("s", 1, [(1, [0], "a"), (9, [0], "b"), (-1, [0], "c")])
    reply["meta"] = None
    flat = tx.flatten_instructions(prepared(spark, [reply])).collect()
    assert [(r.ix_ordinal, r.data) for r in flat] == [(0, "a")]
    reply["meta"] = {"err": None, "loadedAddresses": None, "innerInstructions": [
        {"instructions": None}, {"instructions": [{"programIdIndex": 1, "accounts": None, "data": "d"}]}]}
    flat = tx.flatten_instructions(prepared(spark, [reply])).collect()
    assert [(r.ix_ordinal, r.data) for r in flat] == [(0, "a"), (3, "d")]
    assert [r.pubkey for r in tx.writable_accounts(prepared(spark, [reply])).collect()] == ["signer-1"]


FEED = [("sig-4", 40, 0), ("sig-3b", 30, 1), ("sig-3", 30, 2), ("sig-2", 20, 3), ("sig-1", 10, 4)]


@pytest.fixture
def feed(spark):
    return spark.createDataFrame(FEED, schemas.SIGNATURES)


def names(frame):
    return [r.signature for r in sel.oldest_first(frame).collect()]


def test_slot_selection(feed):
    assert names(sel.select_slots(feed, 15, 35)) == ["sig-2", "sig-3", "sig-3b"]
    assert names(sel.select_slots(feed, 5, 5)) == []
    assert names(sel.select_slot_range(feed, 10, 20)) == ["sig-1", "sig-2"]
    with pytest.raises(ValueError, match="less than or equal"):
        sel.select_slot_range(feed, 20, 10)


def test_signature_range(feed):
    assert names(sel.select_between(feed, "sig-4", "sig-2")) == ["sig-3", "sig-3b"]
    assert names(sel.select_between(feed, "sig-3b", "sig-1")) == ["sig-2", "sig-3"]
    assert names(sel.select_between(feed, "sig-3", "absent")) == ["sig-1", "sig-2"]
    with pytest.raises(Exception, match="Signature absent is not in the feed"):
        sel.select_between(feed, "absent", "sig-1").collect()


def test_signature_lists(spark, feed):
    assert sel.parse_signatures("sig-1, sig-2,,sig-1 ") == ["sig-1", "sig-2"]
    with pytest.raises(ValueError, match="at least one"):
        sel.parse_signatures(" , ")
    wanted = sel.signature_list(spark, ["sig-2", " sig-1", "", "sig-2"])
    assert names(sel.select_signatures(feed, wanted)) == ["sig-1", "sig-2"]


def test_resume_range(spark, feed):
    stored = spark.createDataFrame([(15,)], "last_processed_slot bigint")
    none = stored.limit(0)
    ends = lambda *a: tuple(sel.resume_range(*a).first())
    assert ends(stored, feed) == (15, 40)
    assert ends(none, feed) == (0, 40)
    assert ends(stored, feed, 11, 22) == (11, 22)
    with pytest.raises(Exception, match=r"slot-from \(9\) must be less than or equal to slot-to \(1\)"):
        ends(stored, feed, 9, 1)


def test_one_selector_only():
    assert sel.check_selector(slots=(1, 2)) == "slots"
    for bad in ({}, {"slots": (1, 2), "signatures": ["a"]}, {"between": ("a", None)}, {"slots": (2, 1)}):
        with pytest.raises(ValueError):
            sel.check_selector(**bad)


def test_registry_keeps_first_creation(spark):
    log = spark.sql("SELECT * FROM VALUES ('p', 'old', TIMESTAMP'2024-01-01'), ('p', 'new', TIMESTAMP'2024-02-01')"
                    " AS t(program_id, idl, written_at)")
    row = latest_programs(log).first()
    assert row.idl == "new" and row.created_at.month == 1 and row.updated_at.month == 2
