"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_RUNS (default 3, the median is reported) set the run. Every query is
executed in full; results are discarded by the noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.session import local_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "q_list_filters",
    "q_sum",
    "q_by_signer_sum",
    "q_by_signer_avg",
    "q_stats_instructions",
    "q_stats_program",
    "q_catalog_columns",
    "q_flatten_instructions",
    "q_filter_program",
    "q_writable_accounts",
    "q_match_instructions",
    "q_decode_instructions",
    "q_decode_accounts",
    "q_select_slots",
    "q_select_between",
    "q_select_list",
    "q_exclude_done",
    "q_i128_sum",
    "q_ingest",
    "q_stream_ingest",
]
# Each run of these writes a table of its own, so one measured run is enough.
WRITERS = {"q_ingest", "q_stream_ingest"}


def timed(spark, name: str, sf_dir: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    result = {}
    for name in HEADLINE:
        count = 1 if name in WRITERS else runs
        # The first run of a query compiles it and starts the Python workers.
        times = [timed(spark, name, sf_dir) for _ in range(count + 1)][1:]
        result[name] = round(statistics.median(times), 3)
        print(name, result[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total time of the headline queries, median of warm runs",
        "value": round(sum(result.values()), 3),
        "unit": "sec",
        "queries": result,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
