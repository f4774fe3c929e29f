"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and the cores. Results go to the
`noop` sink, so whole plans run and nothing is collected. Stage tables are written first and timed on their own.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))

HEADLINE = [
    "unified_usage", "trace_summary", "log_severity_max", "filled_grid", "train_stats", "scale_features",
    "baseline_skill", "modeling_ready", "live_error_join", "recommendation_summary", "forecast_series", "auc_roc",
]


def main() -> None:
    from nodetide.plans import decision_queries, feature_queries, registered, telemetry
    from nodetide.operators import decide, features
    from nodetide.session import build_session

    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = registered()
    times: dict[str, float] = {}

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def timed(name: str, fn, repeats: int = REPEATS) -> None:
        best = None
        for _ in range(repeats + 1):  # the first run warms up
            start = time.perf_counter()
            fn()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)

    def once(name: str, fn) -> None:
        start = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - start, 3)

    run(spark.read.parquet(f"{SF_DIR}/events.parquet"))
    once("stage_unified", lambda: telemetry.metrics(spark, SF_DIR))
    once("stage_severity", lambda: telemetry.severities(spark, SF_DIR))
    timed("feature_table", lambda: run(feature_queries.features(spark, SF_DIR)))
    once("stage_features", lambda: feature_queries.feature_stage(spark, SF_DIR))
    timed("scaling_decision", lambda: run(decide.decide(decision_queries.predictions(spark, SF_DIR), telemetry.CHECK)))
    once("stage_records", lambda: decision_queries.records(spark, SF_DIR))
    for name in HEADLINE:
        timed(name, lambda name=name: run(queries[name](spark, SF_DIR)))
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
