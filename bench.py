"""Times the headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from quantflume.session import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

#: Registered queries that are timed as they are.
QUERIES = [
    "resample_ohlcv_15m", "robust_z_causal", "rank_gauss_causal", "ewm_std_12", "force_alignment", "expected_value", "terrain_state", "asof_nearest",
    "trades_nonoverlap", "circuit_breaker", "gate_report", "circular_shift_p", "singularity_scores", "curvature_scan", "offline_chain", "live_tail",
]


def published(spark) -> dict:
    from quantflume.functions import series
    from quantflume.operators import geometry, layers, models, stats
    from quantflume.plans import chains
    from tests import simulators

    bars = simulators.synthetic(spark, "garch", 6000, [0]).cache()
    bars.count()
    ranked = series.rank_causal(layers.motion(bars), ["E", "jerk", "m_flux"])
    columns = ["E_gauss", "jerk_gauss", "m_flux_gauss"]
    few = series.tail(bars, 4000)
    # window 1,440 and step 60: 1,464 evaluations of a seed and their targets
    planted = simulators.synthetic(spark, "planted", 1440 + 2 * 60 + 61 + 1464 * 60, list(range(30)), step=60)
    whole = series.tail(bars, 3200)
    prefix = whole.orderBy("bar_ms").limit(2400)
    return {
        # 58 to 63 s published: 6,000 bars, 4,200 evaluated, window 1,500, refit 60
        "causal_geometry_6000": lambda: geometry.causal_scan(ranked, columns, "lam"),
        # 66 to 72 s published: nine layers over 4,000 bars at full grid sizes
        "offline_chain_4000": lambda: chains.offline_chain(few),
        # 5 to 6 s published: one live call on the last 220 bars
        "live_call_220": lambda: chains.live_call(few),
        # 65 to 73 s published: 240 bars, five bandwidths, two halves
        "reliability_240": lambda: geometry.reliability(ranked, columns, window=1500, bars=240),
        # 63 s published: 30 seeds of 1,464 evaluations, each tested by 999 circular shifts
        "calibration_30_seeds": lambda: models.speed_test(models.evaluations(planted, 1440, 60, 4.0), "hour", list(range(1, 1000))),
        # 90 to 93 s published: two offline chains, of 2,400 and of 3,200 bars, compared
        "prefix_2400_3200": lambda: stats.changed_share(chains.offline_chain(prefix), chains.offline_chain(whole), ["E_gap", "transition_score", "edge_score", "singularity_score"]),
    }


def timed(df) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def main() -> None:
    from quantflume.plans import registry

    spark = session("bench", f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    timed(registry.QUERIES["resample_ohlcv_15m"](spark, SF_DIR))  # starts the workers
    took = {}
    for name in QUERIES:
        began = time.time()
        timed(registry.QUERIES[name](spark, SF_DIR))
        took[name] = round(time.time() - began, 3)
    for name, make in published(spark).items():
        began = time.time()
        timed(make())
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
