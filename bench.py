"""Time the headline queries: one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores;
each time is the median of ``BENCH_REPEATS`` runs (3)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from creatorlake.catalog import QUERIES  # noqa: E402
from creatorlake.session import INPUT_PARTITIONS, build_session  # noqa: E402

HEADLINE = [
    "hashtag_frequency", "clean_profiles", "clean_comments", "reply_rows", "extract_authors", "top_profiles_per_hashtag",
    "flat_profiles", "flat_comments", "todo_posts", "relationship_summary", "comments_summary", "url_normalize",
    "comma_number", "tier_percentile", "audience_quality", "qualification_score", "cleaning_summary", "search_summary",
    "merged_profiles", "quarantine_posts", "stream_tag_counts",
]


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session("bench", master=f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", INPUT_PARTITIONS: cpus if cpus.isdigit() else "8", "spark.driver.memory": "12g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, sf_dir, "url_normalize")  # start the session's threads before the clock counts
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = sorted(run(spark, sf_dir, name) for _ in range(repeats))
        times[name] = round(runs[len(runs) // 2], 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
