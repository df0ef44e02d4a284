"""Times the headline queries. Prints one JSON line.

Each query runs twice and its faster run counts, so that JVM warm-up is left out;
results are computed whole and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from assayer.plans.bindings import QUERIES  # noqa: E402
from assayer.plans.ingest import ingest, structure  # noqa: E402
from assayer.session import local_session, scratch_path  # noqa: E402
from assayer.sources.readers import open_source  # noqa: E402

HEADLINES = {
    "profile_all_tables": "agg_4",
    "revenue_by_segment_and_month": "agg_8",
    "all_aggregations": "agg_7",
    "variants_by_customer_and_quarter": "agg_9",
    "top_values": "srt_3",
    "fingerprints": "agg_14",
    "skip_decisions": "set_4",
    "schema_diff": "set_2",
    "inclusion_dependencies": "jn_4",
    "orphans": "jn_5",
    "fuzzy_names": "jn_7",
    "outliers": "dq_5",
    "settlement_status": "rec_4",
    "system_reconciliation": "rec_7",
    "decision_fold": "win_2",
    "strict_parse": "jsn_2",
    "entity_groups": "prp_1",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "assayer-bench")
    seconds = {}
    def run(name: str) -> None:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    jobs = {label: (lambda name=name: run(name)) for label, name in HEADLINES.items()}
    # the structure from footers alone, with the source opened anew and nothing kept
    jobs["structure_of_source"] = lambda: structure(spark, open_source(spark, "parquet", sf_dir))
    # a whole ingest that finds nothing changed, again with the source opened anew; the first ingest is not timed
    root = scratch_path(spark, "bench-store")

    def ingest_again() -> None:
        assert ingest(spark, open_source(spark, "parquet", sf_dir, index=root), root).skipped

    ingest(spark, open_source(spark, "parquet", sf_dir, index=root), root)
    jobs["skip_unchanged_source"] = ingest_again
    for label, job in jobs.items():
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            job()
            runs.append(time.perf_counter() - start)
        seconds[label] = round(min(runs), 3)
        print(f"{label:34} {seconds[label]:8.3f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
