"""Commit graphs: what the driver holds of them, and their walks against plain Python."""

import random
import tracemalloc

import duckdb
from pyspark.sql import functions as F

from palimpsest.operators import history
from palimpsest.plans import catalog


def test_driver_holds_few_bytes_a_commit(spark):
    """A chain of 200,000 commits, and its whole log: before, 716 bytes a commit on the driver."""
    n = 200_000
    rows = spark.range(n).select(F.col("id").alias("commit"), F.when(F.col("id") > 0, F.array(F.col("id") - 1)).otherwise(F.array().cast("array<bigint>")).alias("parents"), F.timestamp_micros(F.col("id") * 1000).alias("ts"))
    tracemalloc.start()
    try:
        graph = history.Graph.of(rows)
        assert graph.ahead_behind(n - 1, n // 2) == (n - 1 - n // 2, 0) and graph.merge_base(n - 1, 7) == 7
        listed = [history.log(rows, graph, [n - 1], **how) for how in ({}, {"topo": True}, {"first_parent": True})]
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert held < 150 * n
    for log in listed:
        assert log.agg(F.count("commit"), F.min(F.col("commit") + F.col("at")), F.max(F.col("commit") + F.col("at"))).first()[:] == (n, n - 1, n - 1)


def test_walks(spark):
    """Graphs with merges, unknown parents, repeated rows, commits without parents or time, unordered rows, numbers and names."""
    draw = random.Random(5)
    for name in (int, str):
        dag = {k: sorted({draw.randrange(k) for _ in range(draw.choice([0, 1, 1, 2]))}) if k else [] for k in range(60)}
        dag[9] = [*dag[9], 999]  # not in the table
        when = {k: None if k == 4 else 1_000 + k for k in dag}
        kind = "long" if name is int else "string"
        listed = [(name(k), [name(p) for p in ps] if k != 0 else None, when[k]) for k, ps in dag.items()] + [(name(8), [name(p) for p in dag[8]], when[8])]
        draw.shuffle(listed)
        rows = spark.createDataFrame(listed, f"commit {kind}, parents array<{kind}>, ts long")
        up = {name(k): [name(p) for p in ps] for k, ps in dag.items()}

        def above(c):
            return {c}.union(*[above(p) for p in up[c] if p in up])

        for graph in (history.Graph.of(rows), history.Graph(up, {name(k): t for k, t in when.items()})):
            assert dict(graph.parents) == up and dict(graph.times) == {name(k): t for k, t in when.items()}
            assert {c: sorted(x) for c, x in graph.children.items()} == {c: sorted(k for k in up if c in up[k]) for c in up}
            for a, b in [(name(draw.randrange(60)), name(draw.randrange(60))) for _ in range(20)]:
                x, y = above(a), above(b)
                assert graph.reachable(a) == x and graph.reachable(a) - graph.reachable(b) == x - y and set(graph.reachable(a, b)) == x | y
                assert graph.ahead_behind(a, b) == (len(x - y), len(y - x))
                lower = set().union(*[above(p) for c in x & y for p in up[c] if p in up])
                assert graph.merge_bases(a, b) == sorted((x & y) - lower)
                for order in (graph.chronological(a, b), graph.topological(a, *([b] if b not in x and a not in y else []))):
                    assert len(order) == len(set(order)) and set(order) in (x, x | y)
                place = {c: k for k, c in enumerate(graph.topological(a))}
                assert all(place[c] < place[p] for c in place for p in up[c] if p in up)
            got = {r["commit"] for r in history.log(rows, graph, [name(59)], since=name(30)).select("commit").collect()}
            assert got == above(name(59)) - above(name(30))
            assert graph.children.get(name(-5), []) == [] and graph.reachable(name(-5)) == set()
    assert history.Graph({}).parents == {} and list(history.Graph.of(rows.limit(0)).parents) == []


def test_log_by_time_where_parents_are_later(spark, tmp_path):
    """The limited log of events whose times don't follow the graph, against its SQL."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (TIMESTAMP '2024-01-01' + to_seconds((event_id * 7919) % 100003) AS ts) FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(catalog.ORACLES["log_chronological_limit"]).fetchall()
    assert [tuple(r) for r in catalog.QUERIES["log_chronological_limit"](spark, str(tmp_path)).collect()] == want and want


def test_large_tables_are_walked_from_the_tips(spark, monkeypatch):
    """Of a table over WHOLE commits the driver holds the tips' ancestors alone, with the same answers; before, all of it."""
    monkeypatch.setattr(history.Graph, "WHOLE", 0)
    draw = random.Random(8)
    for name in (int, str):
        dag = {k: sorted({draw.randrange(max(0, k - 9), k) for _ in range(draw.choice([0, 1, 1, 2]))}) if k else [] for k in range(80)}
        dag[71] = [*dag[71], 999]  # not in the table
        kind = "long" if name is int else "string"
        rows = spark.createDataFrame([(name(k), [name(p) for p in ps], None if k == 4 else k) for k, ps in dag.items()], f"commit {kind}, parents array<{kind}>, ts long").repartition(3)
        whole, tips = history.Graph.of(rows), [name(71), name(78), name(30)]
        for asked in (1000, 0):
            monkeypatch.setattr(history.Graph, "ASKED", asked)
            part = history.Graph.of(rows, tips)
            assert set(part.ids.tolist()) == set(whole.reachable(*tips)) and len(part.ids) < 80
            for a, b in zip(tips, tips[1:] + tips[:1], strict=True):
                assert part.reachable(a) == set(whole.reachable(a)) and part.merge_bases(a, b) == whole.merge_bases(a, b) and part.ahead_behind(a, b) == whole.ahead_behind(a, b)
                assert part.topological(a) == whole.topological(a) and part.chronological(a, b) == whole.chronological(a, b) and part.first_parents(a) == whole.first_parents(a)
                assert part.parents[a] == whole.parents[a]
        assert len(history.Graph.of(rows, [name(500)]).ids) == 0
    chain = spark.range(300).select(F.col("id").alias("commit"), F.when(F.col("id") > 0, F.array(F.col("id") - 1)).otherwise(F.array().cast("array<bigint>")).alias("parents"), F.col("id").alias("ts"))
    monkeypatch.setattr(history.Graph, "LEVELS", 3)
    assert history.Graph.of(chain, [299]).first_parents(299) == list(range(299, -1, -1))  # too many levels: held whole
    graph = catalog._graph(spark, "/root/testdata/sf0.001")[1]
    assert len(graph.ids) == 1000  # three levels are too few there too
    monkeypatch.setattr(history.Graph, "LEVELS", 100)
    assert len(catalog._graph(spark, "/root/testdata/sf0.001")[1].ids) < 50
