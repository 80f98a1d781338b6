"""Times the headline queries; prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import time

from loomtrace.plans import passthrough, reference
from loomtrace.session import build_session

HEADLINE = ("t1_vector_topk", "t3_lexical_topk", "a7_rrf", "a1_session_meta", "j3_unsummarized", "w1_chunks", "c3_ranked", "c2_retrieve", "x1_ids", "p_agg_pricing", "p_join_inner", "p_win_rank", "p_topk_group", "p_asof", "p_tumble", "p_session")
RUNS = 3


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + os.pathsep + os.environ.get("PYTHONPATH", "")
    spark = build_session(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries = {**reference.QUERIES, **passthrough.QUERIES}
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS):
            began = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times), 3)
    print(json.dumps({"metric": "headline queries, median of 3 runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
