"""The registered queries of the bar engine and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantflume.plans import backtest_queries, check_queries, join_queries, layer_queries, portfolio_queries, scan_queries, series_queries

_MODULES = (series_queries, backtest_queries, join_queries, layer_queries, portfolio_queries, scan_queries, check_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market states of the daily series by quantiles of the robust gap between price and its memory."""
    return QUERIES["state_by_energy"](spark, sf_dir)
