"""Queries on tables in which the derived snapshots repeat keys: orders with the keys that the new rows get."""

import duckdb
import pytest

from palimpsest.plans import catalog, states
from tests.test_catalog import comparable


@pytest.fixture(scope="module")
def overlapping(tmp_path_factory):
    """Orders 1 to 40, and 1,000,001 to 1,000,040 with other values, one of them equal to what is added."""
    path = tmp_path_factory.mktemp("overlapping")
    con = duckdb.connect()
    con.execute("CREATE TABLE o AS SELECT * FROM '/root/testdata/sf0.001/orders.parquet' WHERE o_orderkey BETWEEN 1 AND 80")
    con.execute("CREATE TABLE orders AS SELECT * FROM o WHERE o_orderkey <= 40 UNION ALL SELECT * REPLACE (o_orderkey + 999960 AS o_orderkey) FROM o WHERE o_orderkey > 40 AND o_orderkey <> 44 UNION ALL SELECT * REPLACE (1000004 AS o_orderkey) FROM o WHERE o_orderkey = 4")
    con.execute("INSERT INTO orders SELECT * REPLACE (5000000 AS o_orderkey) FROM o WHERE o_orderkey = 80")
    con.execute(f"COPY orders TO '{path}/orders.parquet'")
    return str(path), con


#: Those whose SQL gives a result on such tables.
NAMES = ["merge_report", "merge_counts", "merge_snapshot", "merge_attributes", "merge_conflicts", "cherry_pick_report", "patch_round_trip", "patch_reversed", "revert_clean"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, overlapping, name):
    path, con = overlapping
    got = catalog.QUERIES[name](spark, path)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert comparable(got.select(cols).collect()) == comparable(want)


@pytest.mark.parametrize("name", ["repo_merge", "repo_cherry_pick", "repo_rebase", "repo_rebase_log", "repo_revert_earlier", "repo_pull_request_merge", "repo_stage_features"])
def test_state_query(spark, overlapping, name):
    path, con = overlapping
    got = states.QUERIES[name](spark, path)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({states.ORACLES[name]})").fetchall()
    assert comparable(got.select(cols).collect()) == comparable(want)
