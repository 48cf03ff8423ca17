"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run to the end (no-op sink), after a warm-up on the smallest tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "run_cycle", "features_wide", "indicators_wide", "ema_wide", "ols_wide", "bars_wide_range", "features", "ind_macd",
    "ind_adx", "ind_cci", "prep_ffill", "prep_robust", "split_ordered", "eval_check", "eval_rollup", "interval_forecast",
    "check_report", "run_chain", "doc_latest", "doc_merge", "param_merge", "defaults_overlay", "checksum_diff",
    "violations_plan", "violations_series", "mon_rate", "mon_record_15s", "mon_hist_p95", "mon_range", "stream_tumbling",
)


def main() -> None:
    from loomcast.session import build_session
    from loomcast.suite import load

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"}
    spark = build_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()
    names = sys.argv[1:] or [n for n in HEADLINE if n in queries]
    warm = "/root/testdata/sf0.001"

    def run(name: str, folder: str) -> float:
        t0 = time.perf_counter()
        queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    if os.path.isdir(warm):
        for n in names[:3]:
            run(n, warm)
    times = {n: round(run(n, sf), 3) for n in names}
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
