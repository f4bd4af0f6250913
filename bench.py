"""Headline queries at one scale; prints one JSON line, of the queries done so far when it is ended early."""

from __future__ import annotations

import json
import os
import signal
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans.catalog import QUERIES  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = (
    "win_collapse_digest",
    "win_first_per_slot",
    "win_resolve_slot",
    "agg_slot_gaps",
    "agg_fetch_outcome",
    "agg_error_history",
    "join_skip_cached",
    "sink_cache_upsert",
    "src_capture_index",
    "html_shred",
    "dom_text_agg",
    "mod_layout_1",
    "mod_layout_3",
    "home_case_6",
    "home_case_11",
    "old_case_3",
    "wiki_case_2",
    "win_first_layout",
    "win_dedup_numbered",
    "extract_dispatch",
    "tok_ngrams",
    "agg_vocab_topk",
    "agg_doc_freq",
    "tfidf",
    "win_pr_curve",
    "stream_parse_pending",
    "stream_error_history",
    "evo_rules_diff",
    "evo_moderator_churn",
    "evo_permission_change",
    # Last, as the first of them fits the model.
    "model_features",
    "fit_classifier",
    "score_proba",
    "sink_model",
)

WARM_UP = ("win_first_per_slot", "html_shred", "mod_layout_4", "agg_doc_freq")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        app="tidemark-bench",
        shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
        extra={"spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One query of each kind first: compiled code and Python workers are there before the clock starts.
    for name in WARM_UP:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}

    def tell(*_) -> None:
        total = {"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec"}
        print(json.dumps({**total, "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}), flush=True)
        if _:  # ended by a signal: what is done counts
            os._exit(0)

    signal.signal(signal.SIGTERM, tell)
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]} s", file=sys.stderr, flush=True)
    tell()
    spark.stop()


if __name__ == "__main__":
    main()
