"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 4) and ``BENCH_RUNS`` (default 3,
the fastest counts: the first runs pay for class loading and compilation) can be set in the environment.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from emberlog.plans import registry
from emberlog.session import clear_scratch, local_session

HEADLINE = (
    "next_event_report",
    "parse_match_template",
    "parse_line_id",
    "sessions_build",
    "sessions_label",
    "split_uniform3",
    "feat_transform",
    "win_same_length",
    "win_train_dedup",
    "seq_train_dedup",
    "next_dist",
    "topg_hit",
    "boundary_eval",
    "tw_members",
    "tw_counts",
    "tw_grid",
    "gram",
    "pca_score",
    "inv_predict",
    "inv_mine",
    "clu_nearest",
    "ifo_predict",
    "lr_predict",
    "outcome_render",
    "src_raw_lines",
    "snk_structured",
    "clu_offline",
    "stream_next_event",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, partitions=max(int(cores), 4), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    plans = registry.queries()
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            plans[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    clear_scratch(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
