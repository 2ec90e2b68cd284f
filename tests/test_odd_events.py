"""Queries of ``events`` give what their SQL gives where three ticks share a time and some of their fields are missing."""

import duckdb
import pytest

from quantflume.plans import registry
from tests.test_oracles import rows

ID, VALUE = "event_id + k * 100000", "round(value + k * 7.31, 2)"
#: The columns that differ from three copies of the table with shifted ids.
ODD = {
    "no_id": {"event_id": f"CASE WHEN k <> 1 THEN {ID} END", "value": VALUE},
    "zeros": {"event_id": ID, "value": "CASE WHEN e.event_id * 7919 % 10 < 1 THEN 0.0 ELSE value END"},
    "no_time": {"event_id": ID, "value": VALUE, "ts": "CASE WHEN e.event_id % 7 <> 0 THEN ts END"},
    # 0 to 0.6 ms before the end of an hour; exactly half a millisecond among them
    "edges": {"event_id": ID, "value": VALUE, "ts": "date_trunc('hour', ts) + INTERVAL 1 HOUR - to_microseconds(e.event_id % 7 * 100)"},
    "before_1970": {"event_id": ID, "value": VALUE, "ts": "ts - INTERVAL 19727 DAY - to_microseconds(e.event_id % 2 * 500)"},
    "no_value": {"event_id": ID, "value": f"CASE WHEN (e.event_id + k) * 7919 % 5 <> 0 THEN {VALUE} END"},
}
CASES = [
    *[("no_id", q) for q in ("asof_nearest", "asof_tail_align", "column_profile", "common_timestamps", "dedup_keep_first", "dedup_keep_last", "dominant_type", "edge_fallback", "ema_memory", "ewm_std_12", "flow_design", "flow_z")],
    ("zeros", "ewm_std_12"),
    ("zeros", "dominant_type"),
    *[("no_time", q) for q in ("dominant_type", "ema_memory", "ewm_std_12", "flow_design", "flow_z")],
    *[("edges", q) for q in ("dedup_keep_first", "dedup_keep_last", "resample_ohlcv_15m", "resample_ohlcv_4h", "set_operations", "user_bars_1h")],
    *[("before_1970", q) for q in ("dedup_keep_first", "dedup_keep_last")],
    *[("no_value", q) for q in ("asof_nearest", "ema_memory", "ewm_std_12")],
]


@pytest.fixture(scope="module")
def odd(sf_dir, tmp_path_factory):
    made = {}
    for name, columns in ODD.items():
        made[name] = tmp_path_factory.mktemp(name)
        columns = {"event_id": ID, "ts": "ts", "user_id": "user_id", "event_type": "event_type", "value": "value", "props": "props"} | columns
        duckdb.sql(f"COPY (SELECT {', '.join(f'{x} AS {c}' for c, x in columns.items())} FROM '{sf_dir}/events.parquet' e, range(3) t(k) WHERE e.event_id < 3000) TO '{made[name]}/events.parquet' (FORMAT parquet)")
    return made


@pytest.mark.parametrize(("case", "query"), CASES)
def test_query_equals_its_sql_on_odd_events(case, query, odd, spark):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{odd[case]}/events.parquet'")
        want = con.execute(registry.ORACLES[query]).df()
    a, b = rows(registry.QUERIES[query](spark, str(odd[case])).toPandas()), rows(want)
    off = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert a and not off, f"{len(off)} of {len(a)} rows differ, as {off[0]}"
