"""Benchmark: headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1) with
local[$BENCH_CPUS]; one warm-up run, then the median of $BENCH_RUNS runs per query.
Each run executes the full plan into Spark's no-op sink (nothing is collected).
Prints one JSON line.

    BENCH_QUERIES=all python bench.py      # every registered query
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from medialens.plans.registry import queries  # noqa: E402
from medialens.session import build_session  # noqa: E402

HEADLINE = [
    "summary_two_outlets", "summary_one_outlet", "model_outlet_period_dist", "avg_score_grouping_sets",
    "score_matrix", "monthly_proportions", "segment_trend", "month_spine_fill", "weekly_index_smoothed",
    "weekly_index_combined", "merged_label_qa", "dedup_first", "keyword_topics", "token_windows",
    "majority_vote", "clean_tokens", "clean_tokens_lexicon", "ngram_top1", "ngram_top3", "parse_reply", "html_corpus_text",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app_name="medialens-bench")
    spark.sparkContext.setLogLevel("ERROR")
    reg = queries()
    names = list(reg) if os.environ.get("BENCH_QUERIES") == "all" else \
        [n for n in (os.environ.get("BENCH_QUERIES") or ",".join(HEADLINE)).split(",") if n in reg]
    times: dict[str, float] = {}
    for name in names:
        def once() -> float:
            t = time.perf_counter()
            reg[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t
        once()  # warm-up
        times[name] = round(statistics.median(once() for _ in range(runs)), 4)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_median_query_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "runs": runs,
                      "shuffle_partitions": int(cpus) * 2, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
