import pytest
from pyspark.sql import functions as F

from palimpsest.operators.repository import MergeConflict, Repo, RepositoryError


def points(spark, *rows):
    return spark.createDataFrame(list(rows), "fid string, sp string, ip int, x double, y double")


P1, P2, P3 = ("Points.1", "a", 1000, 1.0, 1.0), ("Points.2", "b", 2000, 2.0, 2.0), ("Points.3", "c", 3000, 3.0, 3.0)


@pytest.fixture
def repo(spark, tmp_path):
    r = Repo(spark, f"file://{tmp_path}/repo", buckets=2)
    r.config("user.name", "ann")
    r.insert("Points", points(spark, P1, P2))
    r.add()
    r.commit("first")
    return r


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_commit_status_log(repo, spark):
    assert repo.status()["staged"]["added"] == 0
    repo.insert("Points", points(spark, P3))
    assert repo.status()["unstaged"]["added"] == 1
    with pytest.raises(RepositoryError):
        repo.commit("nothing staged")
    repo.add("Points")
    second = repo.commit("second")
    assert repo.resolve("HEAD~") == repo.resolve(second + "^1") != second
    assert [r["message"] for r in repo.log().collect()] == ["second", "first"]
    assert repo.diff_count("HEAD~1", "HEAD") == {"added": 1, "modified": 0, "removed": 0, "trees_added": 0, "trees_changed": 1, "trees_removed": 0}
    repo.commit("better", amend=True)
    assert [r["message"] for r in repo.log().collect()] == ["better", "first"]


def test_stage_single_feature_and_clean(repo, spark):
    repo.insert("Points", points(spark, P3, ("Points.4", "d", 4, 4.0, 4.0)))
    repo.add("Points/Points.3")
    assert repo.status()["staged"]["added"] == 1 and repo.status()["unstaged"]["added"] == 1
    repo.clean()
    assert repo.status()["unstaged"]["added"] == 0


def test_merge_attributes_and_conflict(repo, spark):
    repo.create_branch("side")
    repo.insert("Points", points(spark, ("Points.1", "a", 1500, 1.0, 1.0)))
    repo.add()
    repo.commit("number")
    repo.checkout("side")
    repo.insert("Points", points(spark, ("Points.1", "z", 1000, 1.0, 1.0)))
    repo.add()
    repo.commit("text")
    repo.checkout("master")
    assert repo.merge_dry_run("master", "side") == 0
    repo.merge("side")
    assert ("Points.1", "z", 1500, 1.0, 1.0) in rows(repo.snapshot("HEAD:Points"))
    assert len(repo.meta["commits"][repo.head()]["parents"]) == 2
    repo.create_branch("other", "HEAD~1")
    repo.checkout("other")
    repo.insert("Points", points(spark, ("Points.1", "a", 9, 1.0, 1.0)))
    repo.add()
    repo.commit("clash")
    repo.checkout("master")
    repo.insert("Points", points(spark, ("Points.1", "z", 10, 1.0, 1.0)))
    repo.add()
    repo.commit("ten")
    with pytest.raises(MergeConflict):
        repo.merge("other")
    assert len(repo.conflicts("Points")) == 1
    with pytest.raises(RepositoryError):
        repo.commit("not yet")
    repo.checkout("other", paths=["Points"], side="theirs")
    repo.commit("resolved")
    assert ("Points.1", "a", 9, 1.0, 1.0) in rows(repo.snapshot("HEAD:Points"))


def test_fast_forward_reset_revert_cherry_pick(repo, spark):
    repo.create_branch("side")
    repo.checkout("side")
    repo.insert("Points", points(spark, P3))
    repo.add()
    third = repo.commit("three")
    repo.checkout("master")
    assert repo.merge("side") == third
    repo.revert("HEAD")
    assert len(rows(repo.snapshot("HEAD:Points"))) == 2
    repo.reset("HEAD~1", "hard")
    assert repo.head() == third
    repo.reset("HEAD~1", "hard")
    repo.cherry_pick("side")
    assert len(rows(repo.snapshot("Points"))) == 3


def test_rebase_and_squash(repo, spark):
    repo.create_branch("side")
    repo.insert("Points", points(spark, P3))
    repo.add()
    repo.commit("main work")
    repo.checkout("side")
    for n in (1, 2):
        repo.insert("Lines", points(spark, (f"L{n}", "l", n, 0.0, 0.0)))
        repo.add()
        repo.commit(f"line {n}")
    repo.rebase("master")
    assert [r["message"] for r in repo.log().collect()] == ["line 2", "line 1", "main work", "first"]
    repo.squash("HEAD~1", "HEAD", "lines")
    assert [r["message"] for r in repo.log().collect()] == ["lines", "main work", "first"]
    assert repo.layers("HEAD") == ["Lines", "Points"]


def test_remotes_and_pull_request(repo, spark, tmp_path):
    other = Repo.clone(spark, repo.store.path, f"file://{tmp_path}/clone")
    other.insert("Points", points(spark, P3))
    other.add()
    other.commit("from the clone", author="bob")
    assert other.push("origin") == 1
    repo.reset("HEAD", "hard")
    assert len(rows(repo.snapshot("Points"))) == 3
    repo.create_branch("feature")
    repo.checkout("feature")
    repo.delete("Points", F.col("fid") == "Points.1")
    repo.add()
    repo.commit("drop one")
    repo.pull_request(1, "feature")
    health = repo.pull_request_health(1)
    assert (health["commits"], health["behind"], health["conflicts"], health["layers"]) == (1, 0, 0, ["Points"])
    repo.merge_pull_request(1)
    assert repo.find_pull_request(1)["state"] == "merged"
    repo.checkout("master")
    other.pull("origin")
    assert len(rows(other.snapshot("Points"))) == 2


def test_tags_branches_config_transactions(repo, spark):
    repo.tag("v1", message="one")
    assert repo.tags()["v1"] == repo.resolve("v1")
    repo.create_branch("x")
    repo.rename_branch("x", "y")
    assert repo.branches() == ["master", "y"]
    with pytest.raises(RepositoryError):
        repo.delete_branch("master")
    repo.delete_branch("y")
    repo.config("a.b", "c")
    assert repo.config("a.b") == "c"
    head = repo.head()
    with pytest.raises(RepositoryError):
        repo.update_ref("refs/heads/master", head, old="wrong")
    t = repo.begin()
    repo.insert("Points", points(spark, P3))
    repo.add()
    new = repo.commit("later")
    repo.reset("HEAD~1", "hard")
    repo.transaction_update(t, "refs/heads/master", new)
    repo.end(t)
    assert repo.head() == new


def test_query_language(repo, spark):
    assert repo.ql("INSERT INTO Points (\"@id\", sp, ip) VALUES ('Points.9', 'n', -5)") == {"added": 1, "modified": 0, "removed": 0}
    assert rows(repo.ql("SELECT ip FROM Points WHERE ip > 1000")) == [("Points.2", 2000)]
    assert rows(repo.ql('SELECT ip FROM "HEAD:Points"')) == [("Points.1", 1000), ("Points.2", 2000)]
    assert repo.ql("UPDATE Points SET sp = 'u' WHERE @id = 'Points.1'")["modified"] == 1
    assert repo.ql("DELETE FROM Points WHERE ip < 0")["removed"] == 1
    assert repo.ql("SELECT count(*) FROM Points").first()[0] == 2


def test_index_blame_patch(repo, spark):
    repo.create_index("Points", "x", "y", (-10.0, -10.0, 10.0, 10.0), ["ip"])
    repo.insert("Points", points(spark, ("Points.1", "a", 1001, 1.0, 1.5), P3))
    repo.add()
    second = repo.commit("change")
    assert {(r["fid"], r["y"], r["ip"]) for r in repo.index("Points").collect()} == {("Points.1", 1.5, 1001), ("Points.2", 2.0, 2000), ("Points.3", 3.0, 3000)}
    found = {(r["fid"], r["attribute"]): r["commit"] for r in repo.blame("Points").collect()}
    assert found["Points.1", "ip"] == second and found["Points.1", "sp"] != second
    patch = {k: v.cache() for k, v in repo.create_patch("HEAD~1", "HEAD").items()}
    repo.reset("HEAD~1", "hard")
    repo.apply_patch(patch)
    assert len(rows(repo.snapshot("Points"))) == 3
    repo.apply_patch(patch, reverse=True)
    assert repo.status()["unstaged"] == {"added": 0, "modified": 0, "removed": 0, "trees_added": 0, "trees_changed": 0, "trees_removed": 0}


def test_two_writers_and_a_killed_write(repo, spark, tmp_path):
    """The slower of two writers is refused, an edit is applied to the newer state, and a half-written state is no state."""
    from palimpsest.sources.store import StateChanged

    other = Repo(spark, repo.store.path, buckets=2)
    stale = other.meta
    repo.config("user.name", "cid")
    stale["config"]["user.name"] = "dan"
    with pytest.raises(StateChanged):
        other._save(stale)
    assert other.config("user.name") == "cid"
    (tmp_path / "repo" / "state" / "half.tmp").write_text('{"refs"')
    other.create_branch("side")
    assert repo.branches() == ["master", "side"] and repo.config("user.name") == "cid"
    for n in range(30):
        repo.config("n", str(n))
    assert len(repo.store.states()) == repo.store.KEPT and other.config("n") == "29"


def test_geojson_a_feature_a_line(spark, tmp_path):
    from palimpsest.sources.files import read_geojson

    lines = [f'{{"type": "Feature", "id": "{n}", "geometry": {{"type": "Point", "coordinates": [{n}, 1]}}, "properties": {{"name": "p{n}"}}}}' for n in range(3)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "lines.json").write_text("\n".join([*lines, ""]))
    (tmp_path / "in" / "whole.json").write_text('{"type": "FeatureCollection", "features": [' + lines[0].replace('"0"', '"9"') + "]}")
    got = read_geojson(spark, f"file://{tmp_path}/in")
    assert sorted((r["fid"], r["name"]) for r in got.collect()) == [("0", "p0"), ("1", "p1"), ("2", "p2"), ("9", "p0")]
    assert got.where("geom is null").count() == 0
