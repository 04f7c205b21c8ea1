"""Headline queries, timed: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from foliary.operators import search
from foliary.plans import catalog
from foliary.plans.queries_search import many_queries, search_index
from foliary.session import build_session

QUERIES = ("semantic_topk", "keyword_and_topk", "hybrid_rrf", "rerank_movement", "chunk_documents", "table_sum", "table_average", "table_top_n", "pii_scan", "exact_align", "history_budget", "recall_mrr", "p95_latency")


BATCH = 100


def timed(run, times: int = 2) -> float:
    """The best of some runs, in seconds."""
    took = []
    for _ in range(times):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return round(min(took), 3)


def index_times(spark, sf_dir: str) -> tuple[dict[str, float], dict[str, float], dict[str, float], float]:
    """The stored index: seconds for a batch of queries, and milliseconds a query in the batch and alone."""
    began = time.perf_counter()
    index = search_index(spark, sf_dir)
    built = round(time.perf_counter() - began, 3)
    took = {}
    queries = spark.createDataFrame(many_queries(spark, sf_dir, BATCH).toArrow())
    one = queries.limit(1).cache()
    one.count()
    each, single = {}, {}
    for mode in search.MODES:
        run = lambda q, mode=mode: search.search(index, q, mode, 10).write.format("noop").mode("overwrite").save()
        took[f"index_{mode}_{BATCH}"] = timed(lambda run=run: run(queries), 3)
        each[mode] = round(1000 * took[f"index_{mode}_{BATCH}"] / queries.count(), 2)
        single[mode] = round(1000 * timed(lambda run=run: run(one), 3), 1)
    return took, each, single, built


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    run = lambda name: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("semantic_topk")  # warm-up: JVM, reader, Python workers
    took = {name: timed(lambda name=name: run(name)) for name in QUERIES}
    index_took, each, single, built = index_times(spark, sf_dir)
    took |= index_took
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf_dir.rsplit("sf", 1)[-1]) if "sf" in sf_dir else sf_dir, "batched_queries_per_second": {m: round(1000 / x, 2) for m, x in each.items()}, "per_query_ms_in_batch": each, "single_query_ms": single, "index_build_sec": built}))
    spark.stop()


if __name__ == "__main__":
    main()
