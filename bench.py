"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postflow.catalogue import QUERIES  # noqa: E402
from postflow.session import build_session  # noqa: E402

HEADLINE = [
    "html_to_text", "content_hash", "duplicate_texts", "term_match", "first_terms", "read_sources",
    "snapshot_reconcile", "reconcile_failed_board", "repoint_primary", "canonical_openings",
    "fuzzy_openings", "merge_survivors", "place_parse", "location_fit", "prefilter_counts", "unjudged",
    "capped_groups", "score_texts", "best_score", "digest_sections", "repeat_suppression",
    "appearance_replace", "event_fold", "status_counts", "funnel", "response_rates", "new_companies",
    "candidate_rollup", "watched_match", "board_lookup", "review_queue", "sightings_new", "evaluation",
    "check_unique", "stream_event_fold",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus), spark__driver__memory="20g")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    seconds: dict[str, float] = {}
    QUERIES["check_unique"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the session
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
