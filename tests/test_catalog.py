"""Registered queries against DuckDB on the smallest tables, and the driver's entry points."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest.plans import catalog, states

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        path = f"{SF}/{f}" + ("/*.parquet" if os.path.isdir(f"{SF}/{f}") else "")
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def comparable(rows):
    return sorted(tuple((x is None, str(round(x, 6) if isinstance(x, float) else x)) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, oracle, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = oracle.execute(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert comparable(got.select(cols).collect()) == comparable(want)


@pytest.mark.parametrize("name", sorted(states.ORACLES))
def test_state_query(spark, oracle, name):
    got = states.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = oracle.execute(f"SELECT {', '.join(cols)} FROM ({states.ORACLES[name]})").fetchall()
    assert want and comparable(got.select(cols).collect()) == comparable(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["features_added", "features_changed", "features_removed"]
    assert {*catalog.QUERIES, *states.QUERIES} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_training_operators(tmp_path, pipeline):
    """The rest stands without their two folders, with or without the pipeline's file."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    copy = tmp_path / "repo"
    shutil.copytree(Path(entry.__file__).parent, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    shutil.rmtree(copy / "palimpsest" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(sorted(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert said.stdout.strip().splitlines()[-1] == str(sorted({*catalog.QUERIES, *states.QUERIES}))


def test_unknown_commits_are_errors(spark):
    from palimpsest.operators import history

    rows = catalog.commits(spark, SF)
    graph = history.Graph.of(rows)
    for call in (lambda: graph.merge_base(1, -7), lambda: graph.ahead_behind(-7, 1), lambda: history.log(rows, graph, [-7])):
        with pytest.raises(ValueError, match="-7"):
            call()


def test_topological_order(spark):
    """Every commit comes before its parents."""
    from palimpsest.operators import history

    rows = catalog.commits(spark, SF)
    graph = history.Graph.of(rows)
    tip = max(graph.parents)
    order = [r["commit"] for r in history.log(rows, graph, [tip], topo=True).orderBy("at").collect()]
    assert set(order) == graph.reachable(tip) and len(order) > 8
    place = {c: n for n, c in enumerate(order)}
    assert all(place[c] < place[p] for c in order for p in graph.parents[c] if p in place)


def test_hash_bucket_rows(spark):
    """Rows by bucket, against XXH64 of each key outside Spark."""
    from collections import Counter

    import xxhash

    keys = [r["fid"] for r in catalog.base(spark, SF).select("fid").collect()]
    hashes = (xxhash.xxh64_intdigest(str(k), seed=42) for k in keys)
    want = Counter((h - (1 << 64) if h >> 63 else h) % 64 for h in hashes)
    got = {r["b"]: r["n"] for r in catalog.QUERIES["hash_bucket_rows"](spark, SF).collect()}
    assert got == want and len(got) == 64
