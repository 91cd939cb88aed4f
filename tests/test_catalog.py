"""Every relational query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from chronofold.plans import catalog_io as catalog


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, small, name):
    ours = catalog.QUERIES[name](spark, small)
    theirs = duck.sql(catalog.SQL[name])
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    a = sorted(tuple(norm(r[c]) for c in cols) for r in ours.collect())
    at = [theirs.columns.index(c) for c in cols]
    assert a == sorted(tuple(norm(r[i]) for i in at) for r in theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_the_range_reaches_the_scan(spark, small):
    plan = catalog.QUERIES["time_range"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan
    assert "GreaterThanOrEqual(ts," in plan and "LessThan(ts," in plan


def test_cells_halfway_are_those_of_sql(spark, tmp_path):
    """0.105 and others are halfway between two hundredths as floats, and not as doubles."""
    halves = [(k + 0.5) / 100 for k in range(-40, 40)]
    rows = [(k, [x, 0.0]) for k, x in enumerate(halves)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = c.sql(f"select frame_id, kind, distance from ({catalog.SQL['template_kinds']})").fetchall()
    got = catalog.QUERIES["template_kinds"](spark, str(tmp_path)).select("frame_id", "kind", "distance").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 80
