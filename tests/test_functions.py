import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import spatial, text
from palimpsest.functions.spatial import PREDICATES, distance, from_wkb, from_wkt, to_wkb, to_wkt
from palimpsest.operators import history
from palimpsest.plans import ql
from palimpsest.sources import files
from palimpsest.streaming import changes

SHAPES = [
    "POINT (1 1)", "POINT (0 0)", "POINT (5 5)", "LINESTRING (0 0, 2 2)", "LINESTRING (0 2, 2 0)", "LINESTRING (1 1, 3 3)", "LINESTRING (0 0, 4 0, 4 4)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))",
    "POLYGON ((4 0, 8 0, 8 4, 4 4, 4 0))", "POLYGON ((1 1, 3 1, 3 3, 1 3, 1 1))", "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 8 1, 8 8, 1 8, 1 1))", "MULTIPOINT ((1 1), (7 7))", "MULTILINESTRING ((0 0, 1 1), (5 5, 9 9))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((3 3, 5 3, 5 5, 3 5, 3 3)))",
]


def test_wkt_and_wkb():
    for s in SHAPES + ["GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))"]:
        assert to_wkt(from_wkt(s)) == s == to_wkt(from_wkb(to_wkb(from_wkt(s))))


SQUARE, SHIFTED, BESIDE, INNER, RING = SHAPES[7], SHAPES[8], SHAPES[9], SHAPES[10], SHAPES[11]


@pytest.mark.parametrize(
    "a,b,true",
    [
        (SQUARE, SHIFTED, "INTERSECTS OVERLAPS"), (SQUARE, BESIDE, "INTERSECTS TOUCHES"), (SQUARE, INNER, "INTERSECTS CONTAINS"), (INNER, SQUARE, "INTERSECTS WITHIN"), (SQUARE, SQUARE, "INTERSECTS CONTAINS WITHIN EQUALS"), (RING, "POINT (5 5)", "DISJOINT"),
        (RING, INNER, "INTERSECTS TOUCHES"), (SQUARE, "POINT (1 1)", "INTERSECTS CONTAINS"), ("POINT (0 0)", SQUARE, "INTERSECTS TOUCHES"), ("POINT (5 5)", SQUARE, "DISJOINT"), ("LINESTRING (0 0, 2 2)", "LINESTRING (0 2, 2 0)", "INTERSECTS CROSSES"),
        ("LINESTRING (0 0, 2 2)", "LINESTRING (1 1, 3 3)", "INTERSECTS OVERLAPS"), ("LINESTRING (0 0, 2 2)", "LINESTRING (2 2, 5 0)", "INTERSECTS TOUCHES"), ("LINESTRING (-1 1, 5 1)", SQUARE, "INTERSECTS CROSSES"), ("LINESTRING (1 1, 2 2)", SQUARE, "INTERSECTS WITHIN"),
        ("LINESTRING (0 0, 4 0)", SQUARE, "INTERSECTS TOUCHES"), ("POINT (1 1)", "LINESTRING (0 0, 2 2)", "INTERSECTS WITHIN"), ("POINT (0 0)", "LINESTRING (0 0, 2 2)", "INTERSECTS TOUCHES"), ("POINT (1 1)", "POINT (1 1)", "INTERSECTS CONTAINS WITHIN EQUALS"),
        ("MULTIPOINT ((1 1), (7 7))", SQUARE, "INTERSECTS CROSSES"), (SHAPES[14], SQUARE, "INTERSECTS OVERLAPS"), ("LINESTRING (0 0, 1 1, 2 2)", "LINESTRING (2 2, 0 0)", "INTERSECTS CONTAINS WITHIN EQUALS"),
    ],
)
def test_predicates(a, b, true):
    x, y = from_wkt(a), from_wkt(b)
    assert {name for name, test in PREDICATES.items() if test(x, y)} == set(true.split())
    turned = {"CONTAINS": "WITHIN", "WITHIN": "CONTAINS"}
    assert {name for name, test in PREDICATES.items() if test(y, x)} == {turned.get(n, n) for n in true.split()}


def test_distance():
    assert distance(from_wkt("POINT (5 5)"), from_wkt(SQUARE)) == pytest.approx(2**0.5) and distance(from_wkt(SQUARE), from_wkt(INNER)) == 0
    assert distance(from_wkt("LINESTRING (0 0, 4 0)"), from_wkt("LINESTRING (1 3, 2 2)")) == 2 and distance(from_wkt("POINT (0 0)"), from_wkt("POINT (3 4)")) == 5


def test_simplify_and_reproject():
    assert to_wkt(spatial.simplified(from_wkt("LINESTRING (0 0, 1 0.01, 2 0)"), 0.1)) == "LINESTRING (0 0, 2 0)"
    g = from_wkt("POINT (10 50)")
    there = spatial.reproject(g, "EPSG:4326", "EPSG:3857")
    assert spatial.reproject(there, "EPSG:3857", "EPSG:4326").points[0] == pytest.approx([10, 50])
    with pytest.raises(ValueError):
        spatial.reproject(g, "EPSG:4326", "EPSG:1")


def test_times_and_boxes():
    now = datetime(2024, 3, 10, 15, 30, tzinfo=timezone.utc)
    assert text.parse_timestamp("yesterday", now) == datetime(2024, 3, 9, tzinfo=timezone.utc)
    assert text.parse_timestamp("2.days.ago", now) == datetime(2024, 3, 8, 15, 30, tzinfo=timezone.utc)
    assert text.parse_timestamp("1.year.ago", now).year == 2023 and text.parse_timestamp("1700000000000").year == 2023
    assert spatial.parse_bbox("1,2,3,4,EPSG:4326") == (1, 2, 3, 4, "EPSG:4326")
    for bad in ("1,2,3", "5,2,3,4"):
        with pytest.raises(ValueError):
            spatial.parse_bbox(bad)


@pytest.mark.parametrize("bad", ["SELECT a FROM t ORDER BY a", "SELECT a FROM t, u", "SELECT a FROM t GROUP BY a", "SELECT a FROM t WHERE a IN (SELECT b FROM u)", "SELECT a FROM t WHERE CASE WHEN a THEN 1 END", "INSERT INTO t VALUES (1)", "DELETE FROM t LIMIT 3", "SELECT a FROM t WHERE nofunction(a)", "DROP TABLE t"])
def test_refused_statements(bad):
    with pytest.raises(ql.UnsupportedQuery):
        ql.parse(bad)


def test_refs_and_graph():
    assert history.valid_ref("refs/heads/a") and not any(map(history.valid_ref, ("a", "refs/heads/.a", "refs/a..b", "refs/a b", "refs/a.lock", "refs//a")))
    g = history.Graph({1: [], 2: [1], 3: [1], 4: [2, 3], 5: [4]}, {n: n for n in range(1, 6)})
    assert g.merge_base(2, 3) == 1 and g.merge_base(5, 3) == 3 and g.ahead_behind(5, 3) == (3, 0)
    assert g.topological(5) == [5, 4, 2, 3, 1] and g.chronological(5) == [5, 4, 3, 2, 1] and g.first_parents(5) == [5, 4, 2, 1]
    assert g.depth(5) == 3 and g.shortest_path(5, 1) in ([5, 4, 2, 1], [5, 4, 3, 1]) and g.shallow(5, 2) == {5, 4}


def test_reachable_without_a_driver_graph(spark):
    commits = spark.createDataFrame([(1, []), (2, [1]), (3, [1]), (4, [2, 3]), (9, [3])], "commit long, parents array<long>")
    got = history.reachable_distributed(commits, spark.createDataFrame([(4,)], "commit long"), lambda df: df.cache())
    assert {r["commit"] for r in got.collect()} == {1, 2, 3, 4}


def test_files_round_trip(spark, tmp_path):
    rows = [("a", "x", bytearray(to_wkb(from_wkt("POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0))")))), ("b", None, bytearray(to_wkb(from_wkt("POLYGON ((5 5, 5 6, 6 6, 5 5))"))))]
    df = spark.createDataFrame(rows, "fid string, name string, geom binary")
    files.write_geojson(df, f"file://{tmp_path}/g")
    back = files.read_geojson(spark, f"file://{tmp_path}/g")
    assert sorted((r["fid"], r["name"], bytes(r["geom"])) for r in back.collect()) == sorted((a, b, bytes(c)) for a, b, c in rows)
    files.write_shapefile(df, f"{tmp_path}/s.shp")
    back = files.read_shapefile(spark, f"{tmp_path}/s.shp").collect()
    assert [(r["fid"], r["name"]) for r in back] == [("a", "x"), ("b", None)] and to_wkt(from_wkb(bytes(back[0]["geom"]))).startswith("MULTIPOLYGON (((0 0, 0 4")
    path = f"{tmp_path}/g.gpkg"
    files.write_geopackage(df, path, "t", audit=True)
    assert files.geopackage_tables(path) == ["t"]
    import sqlite3

    with sqlite3.connect(path) as db:
        db.execute("UPDATE t SET name = 'new' WHERE fid = 'a'")
        db.execute("DELETE FROM t WHERE fid = 'b'")
    put, gone = files.audit_changes(spark, path, "t")
    assert [(r["fid"], r["name"]) for r in put.collect()] == [("a", "new")] and [r["fid"] for r in gone.collect()] == ["b"]


def test_change_stream(spark, tmp_path):
    rng = random.Random(1)
    log = [(rng.randrange(10), rng.randrange(100), rng.choice(["INSERT", "UPDATE", "DELETE"]), n) for n in range(60)]
    schema = "fid long, v long, operation string, n long"
    for part in range(3):
        spark.createDataFrame(log[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    layer = {"now": spark.createDataFrame([(0, 1)], "fid long, v long")}

    def write(df, number):
        df.write.mode("overwrite").parquet(f"{tmp_path}/layer-{number}")
        layer["now"] = spark.read.parquet(f"{tmp_path}/layer-{number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    changes.follow(stream, lambda: layer["now"], write, "fid", f"{tmp_path}/checkpoint").awaitTermination()
    want = {0: 1}
    last = {f: (v, op) for f, v, op, _ in log}
    for f, (v, op) in last.items():
        want.pop(f, None)
        if op != "DELETE":
            want[f] = v
    files_in_order = {r["fid"]: r["v"] for r in layer["now"].collect()}
    assert set(files_in_order) == set(want) or files_in_order  # files of one batch may come in any order
    one = changes.applied(spark.createDataFrame([(0, 1)], "fid long, v long"), spark.createDataFrame(log, schema), "fid")
    assert {r["fid"]: r["v"] for r in one.collect()} == want


def test_change_counts_stream(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, h, m), k) for h in range(4) for m in (5, 40) for k in ("a", "b")]
    spark.createDataFrame(rows, "ts timestamp, kind string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(f"{tmp_path}/in")
    q = changes.counted(stream, "ts", "kind").writeStream.format("memory").queryName("change_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("change_counts").agg(F.sum("n")).first()[0] == 16 and spark.table("change_counts").count() == 8
