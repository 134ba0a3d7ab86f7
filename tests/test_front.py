"""The terminal front, imports and exports, and geometry differences."""

from palimpsest.__main__ import run
from palimpsest.functions import geometry_diff
from palimpsest.functions.spatial import from_wkt, to_wkb


def test_commands(spark, tmp_path):
    repo = f"file://{tmp_path}/repo"
    spark.createDataFrame([(1, "a", 1.0, 1.0), (2, "b", 2.0, 2.0)], "id int, name string, x double, y double").write.json(f"{tmp_path}/in")
    assert run(spark, [repo, "init"]) == "master"
    first = run(spark, [repo, "import", "places", f"{tmp_path}/in", "--format", "json", "--fid", "id", "--message", "load"])
    assert run(spark, [repo, "rev-parse", "HEAD"]) == first
    assert run(spark, [repo, "ql", "UPDATE places SET name = 'z' WHERE @id = '2'"])["modified"] == 1
    run(spark, [repo, "add"])
    run(spark, [repo, "commit", "--message", "edit", "--author", "ann"])
    assert [r["message"] for r in run(spark, [repo, "log"]).collect()] == ["edit", "load"]
    assert run(spark, [repo, "diff", "HEAD~1", "HEAD", "--count"])["modified"] == 1
    assert run(spark, [repo, "statistics"]) == {"branches": 1, "commits": 2, "layers": 1, "features": 2}
    assert {r["path"] for r in run(spark, [repo, "ls"]).collect()} == {"places", "places/1", "places/2"}
    assert [r["name"] for r in run(spark, [repo, "show", "HEAD~1:places/2"]).collect()] == ["b"]
    run(spark, [repo, "export", "HEAD:places", f"{tmp_path}/out", "--where", "name = 'z'"])
    assert [r["fid"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["2"]


def test_import_without_ids_is_repeatable(spark):
    from palimpsest.sources.files import import_table

    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "name string")
    ids = lambda: sorted(r["fid"] for r in import_table(rows).collect())
    assert ids() == ids() and len(set(ids())) == 3


def test_geometry_diff():
    a, b = (bytes(to_wkb(from_wkt(t))) for t in ("LINESTRING (0 0, 1 1, 2 2)", "LINESTRING (0 0, 5 5, 2 2, 3 3)"))
    changes = geometry_diff.diff(a, b)
    assert geometry_diff.apply(a, changes) == b and geometry_diff.diff(a, a) == []
    assert geometry_diff.conflicts(a, b, bytes(to_wkb(from_wkt("POINT (1 1)")))) and not geometry_diff.conflicts(a, b, b)
