"""Every registered query against its check SQL on the smallest tables."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def normal(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in pathlib.Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_every_query_is_checked():
    """Queries of the optional text package have tests of their own."""
    own = {name for name in QUERIES if name != "pipeline" and not name.startswith("op")}
    assert own <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_check(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    mine = sorted(tuple(normal(row[c]) for c in columns) for row in df.collect())
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in sorted(names)]
    theirs = sorted(tuple(normal(row[i]) for i in order) for row in found.fetchall())
    assert columns == sorted(names)
    assert mine == theirs


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_replayed_requests_are_logged_once(spark):
    """A job that dies after logging and before recording its requests logs them no second time."""
    from terraloom.streaming import requests
    from terraloom.workload.ingest_queries import asset_store
    from terraloom.workload.registry import Reader

    store, database, fetch = asset_store(Reader(spark, SF_DIR))
    wkt = "POLYGON ((172.6 -43.6, 172.7 -43.6, 172.7 -43.5, 172.6 -43.5, 172.6 -43.6))"
    batch = spark.createDataFrame([(1, wkt), (2, wkt)], "request_id bigint, wkt string")
    for handled in ("first", "second"):
        requests.handle_batch(store, fetch, f"{database}.{handled}", batch, 0)
    assert sorted(r["request_id"] for r in spark.table(store.coverage_log).collect()) == [1, 2]
