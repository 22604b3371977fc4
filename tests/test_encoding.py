"""Base conversion as a product, little-endian numbers, and inputs that are encoded once."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import base58
from workload import inputs as inp
from workload import queries, upkeep


def plain_base58(data: bytes) -> str:
    number, text = int.from_bytes(data, "big"), ""
    while number:
        number, digit = divmod(number, 58)
        text = base58.ALPHABET[digit] + text
    return base58.ALPHABET[0] * (len(data) - len(data.lstrip(b"\0"))) + text


def test_base58_around_the_widest_product():
    rnd, widest = random.Random(5), base58._DENSE
    sizes = (0, 1, 16, 17, 32, 160, widest - 1, widest, widest + 1)
    values = [fill * n for n in sizes for fill in (b"\xff", b"\0")] + [b"\0" + rnd.randbytes(n) for n in sizes]
    values.insert(3, None)
    texts = [None if v is None else plain_base58(v) for v in values]
    assert base58._encode(pa.array(values, pa.binary())).to_pylist() == texts
    assert base58._decode(pa.array(texts, pa.string())).to_pylist() == values


@pytest.mark.parametrize("convert, fill, radix", [(base58._limbs_of, 57, 58), (base58._fives_of, 255, 256)])
def test_largest_sums_are_exact(convert, fill, radix):
    digits = np.full((2, base58._DENSE), fill, dtype=np.uint8)
    base = 1 << 32 if radix == 58 else 58**5
    for column in convert(digits).T:
        assert sum(int(limb) * base**i for i, limb in enumerate(column)) == radix**base58._DENSE - 1


def test_little_endian_numbers(spark):
    numbers = [0, 1, 255, 256, -1, -(2**63), 2**63 - 1, 0x0102030405060708, None]
    rows = spark.createDataFrame([(n,) for n in numbers], "n bigint")
    for size in range(1, 9):
        shown = [r[0] for r in rows.select(inp.le(F.col("n"), size)).collect()]
        assert shown == [None if n is None else (n % 2**64).to_bytes(8, "little")[:size].hex().upper() for n in numbers]


def test_an_event_is_parsed_once(spark, sf_dir):
    payload = inp.with_event_payload(inp.table(spark, sf_dir, "events")).select("payload")
    assert payload._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") == 1


def is_encoded_again(frame) -> bool:
    return "ArrowEvalPython" in frame._jdf.queryExecution().optimizedPlan().toString()


def test_batches_read_landed_transactions(spark, sf_dir, monkeypatch):
    """Several batches of a query read the same files: none of them encodes all events again."""
    seen = []
    monkeypatch.setattr(queries, "ingest", lambda store, rows, *a, **b: seen.append(rows))
    monkeypatch.setattr(upkeep.ingestion, "ingest", lambda store, rows, *a, **b: seen.append(rows))
    monkeypatch.setattr(queries.st.Store, "compact", lambda self, small_bytes=0: True)
    monkeypatch.setattr(upkeep.q, "instruction_stats", lambda *a: None)
    queries._ledger_store(spark, sf_dir)
    upkeep.q_store_stats_kept(spark, sf_dir)
    assert len(seen) == 9
    assert not any(is_encoded_again(rows) for rows in seen)
    assert sum(rows.count() for rows in seen[:5]) == inp.table(spark, sf_dir, "events").count()


def test_types_land_with_every_row_of_a_signature(spark, tmp_path):
    """An event id of two types is in both of their batches, one that comes twice is there twice, and
    a type without events is an empty batch."""
    events = [(1, "click"), (1, "view"), (2, "error"), (2, "error"), (3, None)]
    spark.createDataFrame(
        [(i, t, 7, 1.5, '{"k": 5}') for i, t in events],
        "event_id bigint, event_type string, user_id bigint, value double, props string",
    ).write.parquet(f"{tmp_path}/events.parquet")
    parts = queries._landed_by_type(spark, str(tmp_path))
    found = {name: sorted(r.signature for r in rows.select("signature").collect()) for name, rows in parts.items()}
    assert found == {"click": ["tx1"] * 2, "error": ["tx2"] * 2, "purchase": [], "signup": [], "view": ["tx1"] * 2}
