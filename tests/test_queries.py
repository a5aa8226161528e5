"""Every query against its SQL, as the driver compares them."""

import math
from pathlib import Path

import duckdb
import pytest

from graticule import queries as q

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{DATA}/events.parquet')")
    return c


def normal(rows):
    return sorted(tuple("NaN" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows)


def test_every_query_has_sql():
    assert set(q.QUERIES) == set(q.ORACLES)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, con, name):
    df = q.QUERIES[name](spark, str(DATA))
    found = con.execute(q.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = [tuple(r[names.index(c)] for c in df.columns) for r in found.fetchall()]
    assert normal(map(tuple, df.collect())) == normal(want)


def test_increase_of_a_long_running_sum(spark, tmp_path):
    """Thousands of events add up to what they exactly are, to the sixth decimal."""
    table = spark.range(1, 20_001).selectExpr("timestamp_ntz '2024-01-02 00:00:00' + make_dt_interval(0, 0, 0, id * 4) AS ts", "0L AS user_id", "'click' AS event_type", "12345.67D AS value")
    table.write.parquet(f"{tmp_path}/events.parquet")
    found = {r.ts: r.value for r in q.QUERIES["promql_fn_increase"](spark, str(tmp_path)).collect()}
    # 19,999 steps in 79,996 s, four more at the start and half a step at the end
    assert abs(found[q.START + q.DAY] - 12345.67 * 20_000.5) < 1e-6
