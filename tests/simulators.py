"""Made-up bars for tests and timings: paths of the library's models with fixed parameters."""

import numpy as np
import pandas as pd

from quantflume.kernels import volatility as vol

START_MS, STEP_MS = 1_700_000_000_000 // 3_600_000 * 3_600_000, 60_000
FLOW_A, FLOW_B = (0.0, 0.4, 0.2), (0.4, 0.75, 0.3, 0.0)
FLOW = vol.Flow(dict(vol.GARCH), np.array(FLOW_A), np.array(FLOW_B), 0.5, 0.4, 0.2)


def flow_bars(n, seed, regime=None):
    path = vol.flow_path(FLOW, n, seed, regime=regime)
    before = np.concatenate([path["close"][:1], path["close"][:-1]])
    reach = np.exp(np.random.default_rng([seed, 2]).exponential(3e-4, (2, n)))
    ends = {"open": before, "high": np.maximum(before, path["close"]) * reach[0], "low": np.minimum(before, path["close"]) / reach[1]}
    return {"bar_ms": START_MS + STEP_MS * np.arange(n)} | ends | path


def synthetic(spark, kind, n, seeds, step=40):
    """Bars of a symbol for each seed, made inside tasks; "planted" ones have a regime that moves volatility two steps later."""

    def make(pdfs):
        for pdf in pdfs:
            for seed in pdf["seed"].tolist():
                made = flow_bars(n, seed, (0.001, 0.65, 2.0, 2 * step) if kind == "planted" else None)
                yield pd.DataFrame({"symbol": f"{kind}{seed}"} | {c: made[c] for c in ("bar_ms", "open", "high", "low", "close", "volume", "taker_buy")})

    df = spark.createDataFrame([(s,) for s in seeds], "seed long").repartition(len(seeds), "seed")
    return df.mapInPandas(make, "symbol string, bar_ms long, open double, high double, low double, close double, volume double, taker_buy double")
