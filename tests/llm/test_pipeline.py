"""The pipeline stage by stage against plain versions, and the registered queries."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from ledgerloom.llm import queries
from tests.llm import brute
from tests.llm.test_operators import truth

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    one = corpus_pipeline.quality(spark, docs, SF).cache()
    kept = {r.doc_id for r in one.collect()}
    assert one.columns == columns
    assert sum(i in kept for i, q in labels.items() if q == 1) >= 0.97 * sum(labels.values())
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.2 * max(1, sum(q == 0 for q in labels.values()))
    two = corpus_pipeline.near_duplicates(spark, one, SF).cache()
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert Counter(r.doc_id for r in two.collect()) == Counter({c for _, c, _ in truth(rows)})
    three = corpus_pipeline.benchmark(spark, two, SF).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r[0] for r in brute.decontaminate([(r.doc_id, r.text) for r in two.collect()], items) if not r[5]}
    assert {r.doc_id for r in three.collect()} == clean
    four = corpus_pipeline.secret_values(spark, three, SF).cache()
    assert four.columns == columns and four.count() == three.count()
    five = corpus_pipeline.tokens(spark, four, SF)
    assert Counter((r.doc_id, r.decoded_sha256) for r in five.collect()) == Counter((r.doc_id, brute.sha(r.text)) for r in four.collect())


def test_run_is_the_stages(spark):
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)
