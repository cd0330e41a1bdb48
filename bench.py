"""Benchmark: time of the headline queries, one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8)
the local cores; BENCH_QUERIES may list other queries, or "all".
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusloom.plans.queries import registry  # noqa: E402
from corpusloom.session import session, ship_package  # noqa: E402

HEADLINE = (
    "knn_two_stage knn_stored_codes knn_batch knn_batch_fragments knn_exact knn_recall vector_codes vector_distances "
    "vector_literal chunk_chars chunk_words chunk_conversation_pages doc_stats batch_totals cost_estimate embedded_chunks "
    "ingest_estimate ingest_documents ingest_again collision_fingerprint duplicate_groups table_filter_page ilike_lookup "
    "fts_lookup update_where cascade_delete orphans count_mismatches insert_default_if_absent optimistic_update assign_seq "
    "append_rows pk_violations latest_by_key route_events dead_letter retry_plan retry_rounds event_props hal_elements "
    "xml_values embedding_response sql_function stream_route stream_distinct"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    found = registry()
    wanted = os.environ.get("BENCH_QUERIES", "").replace(",", " ").split() or HEADLINE
    names = list(found) if wanted == ["all"] else wanted
    spark = session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    # start the JVM's scan path and the Python workers once, outside the timings
    spark.read.parquet(f"{folder}/region.parquet").repartition(int(cpus)).mapInPandas(
        lambda batches: batches, "r_regionkey int, r_name string"
    ).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        found[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
