"""Pages of the feed, lines that can't be read, rejects that are tried again, kept statistics."""

import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import query as q
from ledgerloom.operators.catalog import Program
from ledgerloom.plans import ingest as ing
from ledgerloom.plans.store import Store
from ledgerloom.sources import pages, readers
from ledgerloom.streaming import realtime as rt
from tests import sample
from tests.test_ingest import UNKNOWN, feed, frame, golden
from tests.test_lossless import STAMP, announce, reply, signatures, store  # noqa: F401

# --- pages -----------------------------------------------------------------------------


def landed_pages(tmp_path, *numbers, size=10):
    """Page n holds the slots 10 n + 9 down to 10 n."""
    for n in numbers:
        folder = tmp_path / "pages" / f"page={n}"
        folder.mkdir(parents=True, exist_ok=True)
        lines = [json.dumps({"signature": f"s{s}", "slot": s}) for s in range(n * size + size - 1, n * size - 1, -1)]
        (folder / "part-0.json").write_text("\n".join(lines) + "\n")
        (folder / "_SUCCESS").write_text("")
    return str(tmp_path / "pages")


def slots(rows):
    return [r.slot for r in rows.orderBy("feed_pos").collect()]


def test_pages_newest_first(spark, tmp_path):
    path = landed_pages(tmp_path, 0, 1, 2, 10)
    assert slots(pages.read_feed_pages(spark, path)) == [*range(109, 99, -1), *range(29, -1, -1)]
    assert slots(pages.read_feed_pages(spark, f"file://{path}", before="s25", until="s8")) == list(range(24, 8, -1))
    assert slots(pages.read_feed_pages(spark, path, before="s20", limit=3)) == [19, 18, 17]
    assert slots(pages.read_feed_pages(spark, path, until="s105")) == [109, 108, 107, 106]
    assert slots(pages.read_feed_pages(spark, path, limit=12)) == [*range(109, 99, -1), 29, 28]
    assert slots(pages.read_feed_pages(spark, path, until="nowhere", before="s2")) == [1, 0]
    assert slots(pages.read_feed_pages(spark, path, before="s0")) == []
    with pytest.raises(ValueError, match="not in the feed"):
        pages.read_feed_pages(spark, path, before="nowhere")
    with pytest.raises(ValueError):
        pages.read_feed_pages(spark, path, limit=0)
    assert pages.read_feed_pages(spark, str(tmp_path / "nothing")).isEmpty()


def test_only_pages_between_the_anchors_are_read(tmp_path):
    path = landed_pages(tmp_path, *range(8))
    reader = pages.PageReader({"path": path, "after": str(pages.feed_position(5, 3)), "up_to": str(pages.feed_position(3, 0))})
    assert [p.number for p in reader.partitions()] == [5, 4, 3]
    assert [r["slot"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == [*range(55, 39, -1)]


def test_a_line_that_is_no_entry_names_its_page(spark, tmp_path):
    path = landed_pages(tmp_path, 0)
    Path(path, "page=0", "part-0.json").write_text('{"signature":"a","slot":1}\n{"signature":\n')
    with pytest.raises(Exception, match="Page 0 holds a line that is no feed entry"):
        pages.read_feed_pages(spark, path).collect()


def test_pages_as_a_stream(spark, tmp_path):
    path, target = landed_pages(tmp_path, 0, 1, 3), str(tmp_path / "out")

    def run():
        pages.stream_feed_pages(spark, path).writeStream.option("checkpointLocation", str(tmp_path / "state")).option(
            "path", target).format("parquet").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.slot for r in spark.read.schema("slot long").parquet(target).collect())

    assert run() == list(range(20))  # page 2 has not landed, so page 3 waits
    assert run() == list(range(20))
    landed_pages(tmp_path, 2)
    shutil.rmtree(Path(path, "page=0"))  # what was read before is not looked at again
    reader = pages.PageStreamReader({"path": path, "first_page": "1"})
    assert reader.latestOffset() == {"page": 3} and reader.initialOffset() == {"page": 0}
    landed_pages(tmp_path, 0)
    assert run() == list(range(40))


def test_a_backfill_from_pages(spark, store, tmp_path):  # noqa: F811
    path = landed_pages(tmp_path, 0, 1)
    replies = frame(spark, [reply(f"s{s}", s) for s in range(20)])
    ing.backfill(store, pages.read_feed_pages(spark, path), replies, None, "run", between=("s15", "s12"))
    assert signatures(store) == ["s13", "s14"]


# --- lines that can't be read ----------------------------------------------------------


def rejects(held):
    return sorted(((r.slot, r.tx_signature, r.reason, json.loads(r.detail)["text"]) for r in held.table("_rejects").collect()), key=str)


def test_unreadable_lines_are_rejects_once(spark, store, tmp_path):  # noqa: F811
    folder = tmp_path / "tx"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join([json.dumps(reply("sig-1", 10)), '{"signature":"sig-2","slot":2', "null", json.dumps({"signature": "sig-3", "slot": "twenty"})]))
    replies = readers.read_transactions(spark, str(folder))
    assert [r.signature for r in replies.collect()] == ["sig-1"]
    bad = readers.unreadable_lines(spark, str(folder), "transactions")
    entries = feed(spark, [("sig-2", 20), ("sig-1", 10)])
    for run in ("a", "b"):
        ing.backfill(store, entries, replies, None, run, slots=(0, 100), unreadable=bad)
    found = rejects(store)
    assert [f[2] for f in found] == ["unreadable_transactions"] * len(found) and len(found) == 3
    assert {f[3] for f in found} == {'{"signature":"sig-2","slot":2', "null", '{"signature": "sig-3", "slot": "twenty"}'}
    assert all("1.json" in json.loads(r.detail)["file"] for r in store.table("_rejects").collect())
    assert signatures(store) == ["sig-1"] and [r.signature for r in store.unresolved().collect()] == ["sig-2"]
    with pytest.raises(ValueError):
        readers.unreadable_lines(spark, str(folder), "blocks")
    (folder / "1.json").write_text('{"signature":"x","slot":1,"feed_pos":0}\nnot json\n')
    assert [r.detail for r in readers.unreadable_lines(spark, str(folder), "signatures").select(F.get_json_object("detail", "$.text").alias("detail")).collect()] == ["not json"]
    assert readers.read_signatures(spark, str(folder)).count() == 1


def test_an_unreadable_notice_is_a_reject_of_the_stream(spark, store, tmp_path):  # noqa: F811
    landing = tmp_path / "notes"
    announce(landing, "1.json", ("sig-1", 10, STAMP), (None, 11, STAMP))
    with open(landing / "1.json", "a") as notes:
        notes.write('\n{"context": {"slot": 12}, "value": ')
    for _ in range(2):
        rt.follow(store, readers.stream_notifications(spark, str(landing)), lambda: frame(spark, [reply("sig-1", 10)]), None, "live",
                  str(tmp_path / "state"), trigger={"availableNow": True}).awaitTermination()
    found = {r.reason: r for r in store.table("_rejects").collect()}
    assert set(found) == {"malformed_notification", "unreadable_notification"} and store.table("_rejects").count() == 2
    assert json.loads(found["unreadable_notification"].detail)["text"] == '{"context": {"slot": 12}, "value": '
    assert signatures(store) == ["sig-1"]


# --- rejects that are tried again ------------------------------------------------------


def wider_idl():
    """The same program with an instruction more, of the discriminator that was unknown."""
    idl = json.loads(json.dumps(sample.IDL))
    idl["instructions"].append({"name": "close", "args": [{"name": "code", "type": "u8"}]})
    return idl


def close(code):
    from hashlib import sha256

    return sample.base58(sha256(b"global:close").digest()[:8] + bytes([code]))


def test_rejects_are_replayed_under_a_new_interface(spark, store):  # noqa: F811
    rows = [sample.transaction("sig-1", 10, [(1, [], sample.withdraw(5)), (1, [], close(7)), (1, [], UNKNOWN)]),
            sample.transaction("sig-2", 20, [(1, [], close(9)), (1, [], sample.base58(bytes.fromhex("b712469c946da122") + b"\1"))])]
    ing.ingest(store, frame(spark, rows), None, "run", on_error="quarantine")
    places = lambda held: sorted((r.tx_signature, r.ix_ordinal, r.reason) for r in held.undecoded().collect())
    assert places(store) == [("sig-1", 1, "unknown_discriminator"), ("sig-1", 2, "unknown_discriminator"), ("sig-2", 0, "unknown_discriminator"), ("sig-2", 1, "decode_error")]
    new = Store(spark, store.root, Program.from_idl(wider_idl()))
    new.open(json.dumps(wider_idl()))
    assert ing.replay(new, "replay") and not ing.replay(new, "replay")
    assert sorted((r.tx_signature, r.slot, r._ix_ordinal, r.signer, r.code) for r in new.instruction("close").collect()) == [
        ("sig-1", 10, 1, "signer-1", 7), ("sig-2", 20, 0, "signer-1", 9)]
    assert places(new) == [("sig-1", 2, "unknown_discriminator"), ("sig-2", 1, "decode_error")]
    assert {r.instruction: (r["count"], r.unique_signers) for r in q.instruction_stats(new, new.program).collect()}["close"] == ("2", "1")
    assert new.compact()
    assert len(places(new)) == 2 and new.instruction("close").count() == 2


def test_nothing_is_committed_when_counts_differ(spark, store, monkeypatch):  # noqa: F811
    real = ing.ins.decode_instructions
    monkeypatch.setattr(ing.ins, "decode_instructions", lambda *a, **k: real(*a, **k).where("false"))
    with pytest.raises(RuntimeError, match="nothing was committed"):
        ing.ingest(store, frame(spark, [golden()]), None, "run")
    assert store.commits().isEmpty()
    monkeypatch.undo()
    assert ing.ingest(store, frame(spark, [golden()]), None, "run")
    assert ing.ingest(store, frame(spark, []), None, "empty")


# --- kept statistics -------------------------------------------------------------------


def test_statistics_read_only_what_batches_counted(spark, store):  # noqa: F811
    keys = lambda who: (who, sample.PROGRAM, "vault-1")
    for n, who in enumerate(["a", "b"]):
        rows = [sample.transaction(f"sig-{n}", n, [(1, [], sample.withdraw(n)), (1, [2], sample.deposit())], keys=keys(who)),
                sample.transaction(f"more-{n}", 50 - n, [(1, [], sample.withdraw(n))], keys=keys("z"))]
        ing.ingest(store, frame(spark, rows), None, "run", n)

    def stats(held):
        return sorted(map(tuple, q.instruction_stats(held, held.program).collect())), [tuple(r) for r in q.program_stats(held, held.program).collect()]

    class Scanned:
        """The same tables without kept counts."""

        spark, instruction, signers = store.spark, store.instruction, store.signers
        program = store.program

        def signer_counts(self, program):
            return None

    expected = stats(Scanned())
    assert expected[0] == [("deposit", "2", "2", "1"), ("withdraw", "4", "3", "50")] and stats(store) == expected
    files = q.program_stats(store, store.program).inputFiles()
    assert any("/_stats/" in f for f in files) and not any("/ix_" in f for f in files)
    assert store.compact() and stats(store) == expected
    assert store.table("_stats").count() == 5
    # a batch that did not count itself is scanned
    attempt = store.attempt("old", 0)
    attempt.write(store.program.instruction_table("withdraw"), store.instruction("withdraw").limit(1).withColumn("tx_signature", F.lit("old")))
    attempt.commit(False, None)
    assert store.signer_counts(store.program) is None
    assert q.program_stats(store, store.program).first().total_instructions == "7"


# --- the newest rows, and starting over ------------------------------------------------


def test_the_newest_rows_do_not_read_every_bucket(spark, store):  # noqa: F811
    rows = [sample.transaction(f"sig-{s}", s, [(1, [], sample.withdraw(s % 7))], feed_pos=-s) for s in range(0, 400, 3)]
    ing.ingest(store, frame(spark, rows), None, "a")

    def wanted(keep, limit, ascending=False):
        return [s for s in sorted(range(0, 400, 3), reverse=not ascending) if keep(s)][:limit]

    for request, keep, limit, order in (
        ({"arg.amount": "3"}, lambda s: s % 7 == 3, 7, "desc"), ({"from_slot": "50", "to_slot": "133"}, lambda s: 50 <= s <= 133, 200, "asc"),
        ({"to_slot": "99", "arg.amount": "2"}, lambda s: s <= 99 and s % 7 == 2, 2, "desc"),
    ):
        found = q.list_instructions(store, store.program, "withdraw", {**request, "limit": str(limit), "order": order})
        assert [r.slot for r in found.collect()] == wanted(keep, limit, order == "asc")
    found = q.list_instructions(store, store.program, "withdraw", {"limit": "5"})
    files = found._jdf.queryExecution().executedPlan().toString()
    assert "slot_bucket" in files and "PartitionFilters" in files
    assert store.nearest("withdraw", None, None, [], 5, False) == (370, None)
    assert store.nearest("withdraw", None, 95, [], 5, True) == (None, 29)
    assert store.nearest("withdraw", None, None, [F.lit(False)], 5, True) == (None, None)


def test_starting_over_marks_the_old_program_first(spark, store, monkeypatch):  # noqa: F811
    ing.ingest(store, frame(spark, [reply("sig-1", 10)]), None, "run")
    other = {**sample.IDL, "address": "22222222222222222222222222222222"}
    new = Store(spark, store.root, Program.from_idl(other))
    with pytest.raises(ValueError):
        new.open(json.dumps(other))
    real = Store._drop
    monkeypatch.setattr(Store, "_drop", lambda self, path: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        new.open(json.dumps(other), reset=True)
    from ledgerloom.plans.store import programs, stored_program

    assert programs(spark, store.root).isEmpty()  # nothing of the old one is shown
    monkeypatch.setattr(Store, "_drop", real)
    new.open(json.dumps(other))
    assert not Path(store.home).exists()
    assert [r.program_id for r in stored_program(spark, store.root).collect()] == [other["address"]]
    # the first program may come back, with a life of its own
    again = Store(spark, store.root, Program.from_idl(sample.IDL), slots_per_bucket=10)
    again.open(json.dumps(sample.IDL), reset=True)
    row = programs(spark, store.root).first()
    assert row.program_id == sample.PROGRAM and row.created_at == row.updated_at and again.instruction("withdraw").isEmpty()


# --- versions of an interface ----------------------------------------------------------


def version(*args, name="pay"):
    return json.dumps({"address": sample.PROGRAM, "instructions": [{"name": name, "args": [{"name": n, "type": t} for n, t in args]}], "types": []})


def pay(signature, slot, body, name="pay"):
    from hashlib import sha256

    data = sha256(f"global:{name}".encode()).digest()[:8] + body
    return sample.transaction(signature, slot, [(1, [], sample.base58(data))])


def test_versions_share_a_table(spark, tmp_path):
    one, two, three = version(("a", "u8"), ("b", "u32")), version(("a", "i32"), ("c", "string")), version(("a", "u64"), ("b", "u64"), ("c", "string"))
    held = Store(spark, str(tmp_path / "v"), Program.from_idl(one), slots_per_bucket=10)
    with pytest.raises(ValueError, match="first version"):
        held.open(two, from_slot=10)
    held.open(one)
    ing.ingest(held, frame(spark, [pay("s1", 1, b"\5" + (2**32 - 1).to_bytes(4, "little"))]), None, "a")
    with pytest.raises(ValueError, match="changed stored columns"):
        Store(spark, held.root, Program.from_idl(two)).open(two)
    held.open(two, from_slot=10)
    ing.ingest(held, frame(spark, [pay("s2", 9, b"\7" + bytes(4)), pay("s3", 10, (-5).to_bytes(4, "little", signed=True) + sample.text("x"))]), None, "b")
    held.open(three, from_slot=20)
    ing.ingest(held, frame(spark, [pay("s4", 20, (2**64 - 1).to_bytes(8, "little") + (2**63).to_bytes(8, "little") + sample.text("y"))]), None, "c")
    want = [("s1", 5, 2**32 - 1, None), ("s2", 7, 0, None), ("s3", -5, None, "x"), ("s4", 2**64 - 1, 2**63, "y")]
    read = lambda s: [(r.tx_signature, r.a, r.b, r.c) for r in s.instruction("pay").orderBy("slot").collect()]
    assert read(held) == want
    again = Store(spark, str(tmp_path / "v"), Program.from_idl(three))
    again.open(three)
    assert read(again) == want and [v[0] for v in again.program.versions] == [None, 10, 20]
    assert q.aggregate(again, again.program, "pay", {"metric": "sum", "field": "a"}).first().value == str(5 + 7 - 5 + 2**64 - 1)
    assert [r.tx_signature for r in q.list_instructions(again, again.program, "pay", {"arg.b.gte": "1", "order": "asc"}).collect()] == ["s1", "s4"]
    with pytest.raises(ValueError, match="needs from_slot"):
        again.open(version(("z", "u8")))
    with pytest.raises(ValueError, match="in force from slot 20 already"):
        again.open(one, from_slot=15)
    with pytest.raises(ValueError, match="changed stored columns: ix_pay.a"):
        again.open(version(("a", "string")), from_slot=30)


def test_versions_are_of_one_program():
    other = json.loads(version(("a", "u8"))) | {"address": "other"}
    with pytest.raises(ValueError, match="one program"):
        Program.merged([(None, Program.from_idl(version())), (5, Program.from_idl(other))])
    with pytest.raises(ValueError, match="same slot"):
        Program.merged([(5, Program.from_idl(version())), (5, Program.from_idl(version()))])
    merged = Program.merged([(7, Program.from_idl(version(name="new"))), (None, Program.from_idl(version()))])
    assert [(low, high) for low, high, _ in merged.in_force()] == [(None, 7), (7, None)] and set(merged.instructions) == {"pay", "new"}
