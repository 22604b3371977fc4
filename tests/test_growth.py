"""What must not grow with the slots, the rows of a batch, or a table's row groups."""

import json
import sys
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from ledgerloom.functions import base58
from ledgerloom.operators import query as q
from ledgerloom.plans import ingest as ing
from ledgerloom.plans.store import FOLDERS, Store, folder_width
from ledgerloom.sources import readers
from ledgerloom.sources.documents import document_key, land_documents
from tests import sample
from tests.oracle import compare
from tests.test_ingest import feed, frame
from tests.test_lossless import reply, signatures, store  # noqa: F401
from workload import inputs as inp


@pytest.fixture
def events(tmp_path):
    """Forty events of all types, one row group."""
    duckdb.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) SECOND AS ts, i % 4 AS user_id,
      ['click', 'error', 'purchase', 'signup', 'view'][i % 5 + 1] AS event_type, i * 1.25 AS value, '{{"k":' || i % 9 || '}}' AS props
    FROM range(40) t(i)) TO '{tmp_path}/events.parquet'""")
    duckdb.sql(f"""COPY (SELECT i AS s_suppkey, 'x' AS s_name, i % 5 AS s_nationkey, 1.0 AS s_acctbal FROM range(30) t(i))
      TO '{tmp_path}/supplier.parquet'""")
    return str(tmp_path)


def folders(held, table):
    return [p.parent for p in Path(held.home, table).rglob("*.parquet")]


def test_folders_of_a_batch_are_bounded(spark, store):  # noqa: F811
    slots = list(range(0, 4000, 10))  # 400 buckets
    rows = [sample.transaction(f"sig-{s}", s, [(1, [], sample.withdraw(s))], feed_pos=-s) for s in slots]
    ing.backfill(store, feed(spark, [(f"sig-{s}", s) for s in [*slots, 9000]]), frame(spark, rows), None, "run", slots=(0, 9000))
    for table in ("ix_withdraw", "_processed", "_stats", "_unresolved"):
        assert 0 < len(set(folders(store, table))) <= FOLDERS
    assert signatures(store) == sorted(f"sig-{s}" for s in slots)
    for low, high in ((0, 9), (35, 64), (1990, 2400), (3995, 9000)):
        inside = [s for s in slots if low // 10 * 10 <= s <= high // 10 * 10 + 9]
        assert sorted(r.slot for r in store.instruction("withdraw", low, high).collect()) == inside
    found = q.list_instructions(store, store.program, "withdraw", {"limit": "30", "to_slot": "3333"})
    assert [r.slot for r in found.collect()] == [s for s in slots[::-1] if s <= 3333][:30]
    # folders of another width, and one over both
    ing.ingest(store, frame(spark, [reply("sig-x", 77)]), None, "more")
    assert store.compact() and signatures(store) == sorted([*(f"sig-{s}" for s in slots), "sig-x"])
    newest = q.list_instructions(store, store.program, "withdraw", {"limit": "12", "order": "asc", "from_slot": "50"})
    assert [r.slot for r in newest.collect()] == sorted([*(s for s in slots if s >= 50), 77])[:12]


def test_folder_width():
    for lowest, highest in ((0, 0), (0, 63), (5, 5000), (-700, 10), (3, 2**62)):
        width = folder_width(lowest, highest)
        assert highest // width - lowest // width < FOLDERS
        assert width == 1 or highest // (width // 2) - lowest // (width // 2) >= FOLDERS


def test_an_earlier_layout_goes_on(spark, tmp_path):
    home = tmp_path / "old" / sample.PROGRAM
    (home / "_layout" / "slots_per_bucket=10").mkdir(parents=True)
    held = Store(spark, str(tmp_path / "old"), inp.Program.from_idl(sample.IDL))
    held.open(json.dumps(sample.IDL))
    for k in range(2):
        ing.ingest(held, frame(spark, [reply(f"sig-{k}", 35 * k)]), None, "run", k)
    assert {p.name for p in folders(held, "ix_withdraw")} == {"slot_bucket=0", "slot_bucket=3"}
    assert held.compact() and [r.slot for r in held.instruction("withdraw", 30, 39).collect()] == [35]


def test_conversion_takes_a_part_of_a_batch_at_once(monkeypatch):
    import pyarrow as pa

    sizes = []
    real = base58._encode
    values = pa.array([None if i % 7 == 0 else i.to_bytes(3 + i % 40, "big") for i in range(2 * base58._ROWS + 5)], pa.binary())
    whole = real(values)
    monkeypatch.setattr(base58, "_encode", lambda part: sizes.append(len(part)) or real(part))
    parts = base58.bytes_to_base58.func(values)
    assert max(sizes) <= base58._ROWS and sum(sizes) == len(values)
    assert parts.equals(whole) and base58.base58_to_bytes.func(parts).equals(values)


@pytest.mark.parametrize("name", ["q_store_overlapping_compactions", "q_store_compacted"])
def test_large_batches_are_compacted_too(spark, events, monkeypatch, name):
    seen = []
    finish = sys.modules[Store.__module__].Compaction.finish
    monkeypatch.setattr(Store, "_bytes", lambda *_: 2**40)
    monkeypatch.setattr("ledgerloom.plans.store.Compaction.finish", lambda self: seen.append(self.batches) or finish(self))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{events}/events.parquet'")
    got, want = compare(spark, duck, events, queries()[name], oracle_sql()[name])
    assert got == want and seen and all(len(b) > 1 for b in seen)


def test_inputs_of_one_row_group_are_encoded_by_several_tasks(spark, events, monkeypatch):
    plan = inp.event_transactions(spark, events)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [event_id" in plan
    dealt = []
    monkeypatch.setattr(inp, "dealt", lambda rows, key: dealt.append(key) or rows.repartition(key))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW supplier AS SELECT * FROM '{events}/supplier.parquet'")
    got, want = compare(spark, duck, events, queries()["q_read_idl"], oracle_sql()["q_read_idl"])
    assert got == want and dealt == ["s_suppkey"]


def test_documents_are_written_by_several_tasks_into_one_folder(spark, events):
    assert inp.dealt(inp.table(spark, events, "supplier"), "s_suppkey").rdd.getNumPartitions() > 4  # not joined for their few bytes
    files = [Path(f.removeprefix("file:")) for f in queries()["q_read_idl"](spark, events).inputFiles()]
    assert len(files) == 30 and len({f.parent for f in files}) == 1


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_a_file_for_each_key(spark, tmp_path, prefix):
    rows = [(7, '{"address":"é"}'), (None, None), (-5, "{"), (3, ""), (3, "{}"), (7000000000, '{"address":"x"}')]
    documents = inp.dealt(spark.createDataFrame(rows, "k bigint, value string"), "k")
    for _ in range(2):  # as when tasks are repeated
        land_documents(documents, f"{prefix}{tmp_path}/idl")
    assert sorted(p.name for p in (tmp_path / "idl").iterdir()) == ["-5.json", "3.json", "7.json", "7000000000.json", "None.json"]
    assert sorted((tmp_path / "idl" / "3.json").read_text().splitlines()) == ["", "{}"]
    found = readers.read_idl(spark, f"{prefix}{tmp_path}/idl").select(document_key().alias("k"), "idl", "idl_error").collect()
    errors = {r.k: r.idl_error for r in found}
    assert len(found) == 5 and {r.k: r.idl for r in found}[7] == '{"address":"é"}\n'
    assert errors == {7: None, None: "Failed to parse IDL JSON", -5: "Failed to parse IDL JSON", 3: "IDL has no program address", 7000000000: None}
    land_documents(documents.limit(0), f"{prefix}{tmp_path}/none")
    assert readers.read_idl(spark, f"{prefix}{tmp_path}/none").collect() == []
