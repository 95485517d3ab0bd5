"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "minimal_panel", "window_membership", "price_features", "max_drawdown", "asof_ffill_join", "fit_scl", "rolling_beta", "event_features", "fit_multifactor",
    "lexicon_score", "text_stats", "vocab_novelty", "claim_support", "instruction_scrub", "compute_target", "information_coef", "classification_metrics",
    "norm_postings", "classify_remote", "ingest_gate", "dedup_fuzzy", "feed_query", "weighted_mix", "status_machine", "transition_counts", "stream_daily",
    "participant_rows", "feature_table", "recommend_items", "describe", "count_vectorize", "knn_regress",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from tidemark.plans import registry
    from tidemark.session import get_session
    spark = get_session("tidemark-bench", f"local[{cpus}]", int(cpus), {"spark.driver.memory": "20g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    took = {}
    for name in names:
        start = time.time()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
