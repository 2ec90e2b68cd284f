"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from quantflume.plans import registry

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    plain = lambda v: None if v is None or v is pd.NA or v != v else v.item() if hasattr(v, "item") else v
    return sorted((tuple(map(plain, t)) for t in pdf.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(name, spark, duck, sf_dir):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    off = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not off, f"{len(off)} of {len(a)} rows differ, as {off[0]}"


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
