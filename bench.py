"""Headline queries on the bench tables; prints one JSON line.

The shared weekly panel is built once, timed as ``build_panel``; the other queries start from it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barloom.plans import queries as Q, views as V  # noqa: E402
from barloom.session import session  # noqa: E402

HEADLINE = ("E20_compute_features", "E21_build_feature_matrix", "E2_rsi", "E5_bollinger", "E11_cci", "F1_cs_zscore",
            "F4_neutralise_cap_industry", "F6_factor_preprocess", "F8_factor_layers", "F9_top_k", "G7_sliding_windows",
            "G9_wavelet_split", "H2_correlation_edges", "J9_evaluation_summary", "J9_ic_by_day", "K6_backtest_daily",
            "K7_performance_metrics", "K11_period_backtest", "K12_topk_drift_backtest", "L3_heatmap_scores")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = session(f"local[{cpus}]", cpus, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                               "spark.driver.memory": "12g"})
    run(V.table(spark, sf, "lineitem").select("l_suppkey"))
    seconds: dict[str, float] = {}

    def timed(name: str, work) -> None:
        start = time.perf_counter()
        work()
        seconds[name] = round(time.perf_counter() - start, 3)

    only = sys.argv[1:]
    timed("build_panel", lambda: V.panel(spark, sf))
    timed("build_scores_and_labels", lambda: (V.scores(spark, sf), V.labels(spark, sf)))
    for name in HEADLINE:
        if not only or any(name.startswith(o) for o in only):
            timed(name, lambda: run(Q.QUERIES[name].plain(spark, sf)))
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
