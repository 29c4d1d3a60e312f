"""Seconds per headline query: one JSON line on stdout.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local threads.  Every query
runs in full into Spark's no-op sink; eager steps of a query are counted too.
"""

from __future__ import annotations

import json
import os
import sys
import time

from threadloom.plans import QUERIES
from threadloom.session import build_session

HEADLINE = (
    "normalize_posts",
    "search_posts_window",
    "search_keyword",
    "first_seen_lineitem",
    "first_seen_documents",
    "unseen_lineitem",
    "page_plan_lineitem",
    "page_cursors",
    "chunk_assignment",
    "chunk_resume",
    "chunk_report",
    "flatten_threads",
    "flatten_chains",
    "rebuild_paths",
    "rebuild_wide_thread",
    "posts_with_comments",
    "comment_stats",
    "layer_agreement",
    "pending_posts",
    "comment_progress",
    "identity_mismatch",
    "collections_catalog",
    "spec_violations",
    "log_progress",
    "response_audit",
    "stream_ingest_posts",
    "stream_ingest_comments",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's query path and a Python worker before the clock runs.
    spark.range(1000).mapInArrow(lambda batches: batches, "id bigint").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline query time", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir}))


if __name__ == "__main__":
    main()
