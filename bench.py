"""Headline queries on local cores; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.  Each query runs
once to warm up (code generation, file listing) and once timed; DuckDB's time
for the oracle of the same query is printed next to it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "url_normalize",
    "link_anchors",
    "link_first_seen",
    "link_decision_counts",
    "pattern_prefix_glob",
    "pattern_recommend_scope",
    "dom_elements",
    "dom_select",
    "record_containers",
    "record_table",
    "content_records",
    "page_scan",
    "ledger_progress",
    "ledger_run_outcome",
    "ledger_latest_run",
    "health_stalled_runs",
    "event_newest_per_project",
    "quality_field_rates",
    "redact_documents",
    "variant_merge",
    "dom_select_siblings",
    "control_groups",
    "profile_summary",
    "variant_merged_options",
    "record_stored_specs",
    "json_fingerprint",
)


def main() -> None:
    from pagesieve.plans.catalogue import ORACLES, QUERIES
    from pagesieve.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus))

    def run(name: str) -> float:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.time() - start

    times, peers = {}, {}
    for name in HEADLINE:
        run(name)
        times[name] = round(run(name), 3)
    try:
        import duckdb

        con = duckdb.connect()
        con.execute(f"SET threads = {int(cpus)}")
        for file in sorted(os.listdir(folder)):
            if file.endswith(".parquet"):
                con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{folder}/{file}'")
        for name in (n for n in HEADLINE if n in ORACLES):
            start = time.time()
            con.execute(ORACLES[name]).fetchall()
            peers[name] = round(time.time() - start, 3)
    except ImportError:
        pass
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "duckdb": peers,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
