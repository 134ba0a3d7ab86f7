"""A repository of versioned tables: working tree, index, commits, refs and the operations that move them.

State is a small JSON document; rows are immutable snapshots, so staging, committing, branching and resetting move
pointers, and only operations that make new rows write any. A tree is {layer: [key column, snapshot id]}.
"""

from __future__ import annotations

import copy
import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.identity import with_identity
from palimpsest.operators import diff as d
from palimpsest.operators import history, merge
from palimpsest.operators.index import build, updated
from palimpsest.operators.snapshot import adapt, entries
from palimpsest.plans import ql
from palimpsest.sources.files import import_table
from palimpsest.sources.files import write as write_files
from palimpsest.sources.store import StateChanged, Store

HEAD, MASTER = "HEAD", "refs/heads/master"


class RepositoryError(ValueError):
    """An operation that the present state doesn't allow."""


class MergeConflict(RepositoryError):
    """A merge with conflicts; they are recorded and the working tree keeps ours."""


class Repo:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.store = spark, Store(spark, path, buckets)
        self.hooks: dict[str, list[Callable]] = {"pre_commit": [], "post_commit": [], "post_update_refs": []}
        if not self.store.states():
            self._save({"refs": {HEAD: f"ref: {MASTER}"}, "commits": {}, "tags": {}, "work": {}, "stage": {}, "config": {}, "conflicts": [], "indexes": {}, "remotes": {}, "pulls": {}, "transactions": {}, "reflog": [], "state": {}, "filter": {}})

    # --- state

    @property
    def meta(self) -> dict:
        return self.store.read_meta()

    def _save(self, meta: dict) -> None:
        self.store.write_meta(meta)

    def _edit(self, change: Callable[[dict], object]):
        """Applies a change to the state; to the newer one where another writer was faster."""
        for attempt in range(10):
            meta = self.meta
            out = change(meta)
            try:
                self._save(meta)
                return out
            except StateChanged:
                if attempt == 9:
                    raise

    @staticmethod
    def _deref(refs: dict, name: str) -> tuple[str, str | None]:
        """(ref that a name finally stands for, its commit)."""
        while isinstance(refs.get(name), str) and refs[name].startswith("ref: "):
            name = refs[name][5:]
        return name, refs.get(name)

    def head(self) -> str | None:
        return self._deref(self.meta["refs"], HEAD)[1]

    def branch(self) -> str | None:
        """The current branch, None on a detached head."""
        value = self.meta["refs"][HEAD]
        return value[5:].removeprefix("refs/heads/") if value.startswith("ref: ") else None

    def _move(self, meta: dict, name: str, commit: str | None, reason: str) -> None:
        target, old = self._deref(meta["refs"], name)
        if commit is None:
            meta["refs"].pop(target, None)
        else:
            meta["refs"][target] = commit
        meta["reflog"].append([target, old, commit, reason, int(time.time() * 1000)])

    def graph(self) -> history.Graph:
        commits = self.meta["commits"]
        return history.Graph({c: v["parents"] for c, v in commits.items()}, {c: v["ts"] for c, v in commits.items()})

    def commits(self) -> DataFrame:
        rows = [(c, v["parents"], v["author"], v["committer"], v["ts"], v["message"]) for c, v in self.meta["commits"].items()]
        return self.spark.createDataFrame(rows, "commit string, parents array<string>, author string, committer string, ts long, message string")

    def resolve(self, spec: str) -> str | None:
        meta = self.meta
        tags = {f"refs/tags/{t}": v["commit"] for t, v in meta["tags"].items()}
        return history.rev_parse(spec, {**meta["refs"], **tags}, self.graph())

    def tree(self, spec: str = "WORK_HEAD") -> dict:
        """{layer: [key, snapshot]} of WORK_HEAD, STAGE_HEAD or a revision."""
        meta = self.meta
        if spec in ("WORK_HEAD", "STAGE_HEAD"):
            return meta["work" if spec == "WORK_HEAD" else "stage"]
        if spec == HEAD and self.head() is None:
            return {}
        commit = self.resolve(spec)
        return meta["commits"][commit]["tree"] if commit else {}

    def snapshot(self, spec: str) -> DataFrame:
        """The rows of ``revision:layer``."""
        revision, layer = ql.split_table(spec)
        tree = self.tree(revision)
        if layer not in tree:
            raise RepositoryError(f"no layer {layer} at {revision}")
        return self.store.read(tree[layer][1])

    def key(self, layer: str) -> str:
        for tree in (self.tree(), self.tree("STAGE_HEAD"), self.tree(HEAD)):
            if layer in tree:
                return tree[layer][0]
        raise RepositoryError(f"no layer {layer}")

    def layers(self, spec: str = "WORK_HEAD") -> list[str]:
        return sorted(self.tree(spec))

    # --- working tree and index

    def write(self, layer: str, df: DataFrame, key: str = "fid") -> None:
        """Replaces a layer in the working tree."""
        name = self.store.write(df, key)
        self._edit(lambda m: m["work"].__setitem__(layer, [key, name]))

    def insert(self, layer: str, df: DataFrame, key: str = "fid") -> None:
        work = self.tree()
        self.write(layer, merge.upsert(self.store.read(work[layer][1]), df, key) if layer in work else df, key)

    def delete(self, layer: str, condition=None) -> None:
        """Removes the layer, or the rows for which the condition is true."""
        if condition is None:
            self._edit(lambda m: m["work"].pop(layer, None))
        else:
            rows = self.snapshot(layer)
            self.write(layer, rows.where(~F.coalesce(condition, F.lit(False))), self.key(layer))

    def _changes(self, old: dict, new: dict, layer: str) -> DataFrame:
        key = (new.get(layer) or old.get(layer))[0]
        a, b = (old.get(layer) or [None, None])[1], (new.get(layer) or [None, None])[1]
        if a and b:
            return d.pruned_diff(self.store.with_buckets(a), self.store.with_buckets(b), key, self.store.buckets, self.store.digests(a), self.store.digests(b))
        there = self.store.read(a or b)
        return d.diff(there, there.limit(0), key) if a else d.diff(there.limit(0), there, key)

    def diff(self, old: str, new: str, layer: str) -> DataFrame:
        return self._changes(self.tree(old), self.tree(new), layer)

    def changed(self, old: str, new: str) -> list[str]:
        """Layers that differ, by their digests."""
        a, b = self.tree(old), self.tree(new)
        return sorted(n for n in {*a, *b} if not self.store.same((a.get(n) or [0, None])[1], (b.get(n) or [0, None])[1]))

    def diff_count(self, old: str, new: str) -> dict[str, int]:
        out = {"added": 0, "modified": 0, "removed": 0, "trees_added": 0, "trees_changed": 0, "trees_removed": 0}
        a, b = self.tree(old), self.tree(new)
        for layer in self.changed(old, new):
            out["trees_added" if layer not in a else "trees_removed" if layer not in b else "trees_changed"] += 1
            if layer in a and layer in b:
                for k, v in d.counts(self._changes(a, b, layer)).first().asDict().items():
                    out[k] += v
            else:  # a whole layer is counted without reading its rows
                out["added" if layer in b else "removed"] += self.store.count((b.get(layer) or a.get(layer))[1])
        return out

    def status(self) -> dict:
        return {"branch": self.branch(), "staged": self.diff_count(HEAD, "STAGE_HEAD"), "unstaged": self.diff_count("STAGE_HEAD", "WORK_HEAD"), "conflicts": len(self.meta["conflicts"])}

    def add(self, *paths: str, update_only: bool = False) -> None:
        """Stages all changes, those of layers, or those of single features (``layer/key``)."""
        meta = self.meta
        work, stage = meta["work"], meta["stage"]
        features: dict[str, list[str]] = {}
        for path in paths or sorted({*work, *stage}):
            layer, _, fid = path.partition("/")
            if fid:
                features.setdefault(layer, []).append(fid)
            elif layer not in work:
                stage.pop(layer, None)
            elif not update_only or layer in stage:
                stage[layer] = work[layer]
            else:
                continue
            meta["conflicts"] = [c for c in meta["conflicts"] if c["layer"] != layer or (fid and str(c["key"]) != fid)]
        for layer, fids in features.items():
            key = work[layer][0] if layer in work else stage[layer][0]
            part = self._changes(stage, work, layer).where(F.col(key).cast("string").isin(fids))
            target = self.store.read(stage[layer][1]) if layer in stage else self.store.read(work[layer][1]).limit(0)
            stage[layer] = [key, self.store.write(merge.apply_patch(part, target, key), key)]
        self._save(meta)

    def remove(self, *paths: str) -> None:
        """Takes layers or features out of the working tree and the index."""
        for path in paths:
            layer, _, fid = path.partition("/")
            self.delete(layer, F.col(self.key(layer)).cast("string") == fid if fid else None)
            self.add(path if fid else layer)

    def clean(self, *layers: str) -> None:
        """Drops features that the index doesn't have."""
        work, stage = self.tree(), self.tree("STAGE_HEAD")
        for layer in layers or sorted(work):
            if layer not in stage:
                self.delete(layer)
            else:
                key = work[layer][0]
                self.write(layer, self.store.read(work[layer][1]).join(self.store.read(stage[layer][1]).select(key), key, "left_semi"), key)

    # --- commits

    def _commit_object(self, meta: dict, tree: dict, parents: list[str], message: str, author: str | None, committer: str | None = None, ts: int | None = None) -> str:
        last = max([0, *(meta["commits"][p]["ts"] for p in parents)])
        body = {"tree": copy.deepcopy(tree), "parents": parents, "message": message, "author": author or meta["config"].get("user.name"), "committer": committer or meta["config"].get("user.name") or author, "ts": ts or max(int(time.time() * 1000), last + 1)}
        name = hashlib.sha1(json.dumps(body, sort_keys=True).encode()).hexdigest()
        meta["commits"][name] = body
        return name

    def commit(self, message: str, author: str | None = None, amend: bool = False, allow_empty: bool = False, paths: list[str] | None = None, ts: int | None = None) -> str:
        """Commits the index. ``paths`` takes only those layers of it; ``amend`` replaces the last commit."""
        for hook in self.hooks["pre_commit"]:
            hook(self)
        meta = self.meta
        if meta["conflicts"]:
            raise RepositoryError("there are unresolved conflicts")
        head = self._deref(meta["refs"], HEAD)[1]
        now = meta["commits"][head]["tree"] if head else {}
        tree = {**now, **{p: meta["stage"][p] for p in paths if p in meta["stage"]}} if paths else meta["stage"]
        if amend and not head:
            raise RepositoryError("there is no commit to amend")
        if not amend and not allow_empty and "MERGE_HEAD" not in meta["refs"] and set(tree) == set(now) and all(self.store.same(tree[n][1], now[n][1]) for n in tree):
            raise RepositoryError("nothing to commit")
        parents = meta["commits"][head]["parents"] if amend else [head] if head else []
        if merged := meta["refs"].pop("MERGE_HEAD", None):
            parents = [*parents, merged]
        name = self._commit_object(meta, tree, parents, message or meta["state"].pop("message", ""), author, ts=ts)
        self._move(meta, HEAD, name, "commit (amend)" if amend else "commit")
        self._save(meta)
        for hook in self.hooks["post_commit"]:
            hook(self, name)
        self._refresh_indexes(name)
        return name

    def log(self, until: str = HEAD, **options) -> DataFrame:
        tip = self.resolve(until)
        since = options.pop("since", None)
        return history.log(self.commits(), self.graph(), [tip], since=self.resolve(since) if since else None, **options)

    def merge_base(self, a: str, b: str) -> str | None:
        return self.graph().merge_base(self.resolve(a), self.resolve(b))

    def blame(self, layer: str, until: str = HEAD) -> DataFrame:
        """Who last changed each attribute of each feature, along first parents."""
        commits = self.graph().first_parents(self.resolve(until))[::-1]
        rows, last = None, None
        for n, c in enumerate(commits):
            tree = self.meta["commits"][c]["tree"]
            if layer in tree and tree[layer][1] != last:
                last = tree[layer][1]
                one = self.store.read(last).withColumn("commit", F.lit(c)).withColumn("at", F.lit(n))
                rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
        key = self.key(layer)
        return history.blame(rows, key, [c for c in rows.columns if c not in (key, "commit", "at")], ["at"]).join(self.store.read(last).select(key), key, "left_semi")

    # --- objects, imports and exports

    def show(self, spec: str) -> DataFrame:
        """One feature (``revision:layer/key``) or one layer's rows."""
        revision, path = ql.split_table(spec)
        layer, _, fid = path.partition("/")
        rows = self.snapshot(f"{revision}:{layer}")
        return rows.where(F.col(self.tree(revision)[layer][0]).cast("string") == fid) if fid else rows

    def identified(self, spec: str) -> DataFrame:
        """A layer's rows with their object and feature-type ids."""
        revision, layer = ql.split_table(spec)
        return with_identity(self.snapshot(spec), self.tree(revision)[layer][0])

    def cat(self, object_id: str, revision: str = HEAD) -> list[DataFrame]:
        """The rows, layer by layer, whose object id begins so."""
        return [self.identified(f"{revision}:{layer}").where(F.col("object_id").startswith(object_id)) for layer in self.layers(revision)]

    def listing(self, revision: str = HEAD) -> DataFrame:
        """All entries of a revision, for ``snapshot.ls_tree``."""
        tree = self.tree(revision)
        keys = {k for k, _ in tree.values()}
        return entries({n: self.store.read(snap).select(F.col(k).alias("fid")) for n, (k, snap) in tree.items()}, "fid") if keys else self.spark.createDataFrame([], "path string, parent_path string, type string, depth int")

    def import_layer(self, layer: str, df: DataFrame, fid: str | None = None, where: str | None = None, overwrite: bool = False, alter: bool = False, message: str | None = None) -> str | None:
        """A source table into the working tree, and with a message added and committed too.

        ``overwrite`` replaces the layer instead of adding to it; without ``alter`` rows take the layer's schema.
        """
        work = self.tree()
        schema = {k: v for k, v in self.snapshot(layer).dtypes if k != "fid"} if layer in work and not alter and not overwrite else None
        rows = import_table(df, fid, where, schema)
        self.write(layer, rows) if overwrite else self.insert(layer, rows)
        if message is None:
            return None
        self.add(layer)
        return self.commit(message)

    def export(self, spec: str, path: str, kind: str = "parquet", box: tuple[float, float, float, float] | None = None, x: str = "x", y: str = "y", where: str | None = None, schema: dict[str, str] | None = None) -> None:
        """A layer of a revision to files, within a box, filtered and retyped on demand."""
        rows = self.snapshot(spec)
        rows = rows.where(F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3])) if box else rows
        rows = adapt(rows.where(where) if where else rows, schema) if schema else rows.where(where) if where else rows
        write_files(rows, path, kind)

    def export_diff(self, old: str, new: str, layer: str, path: str, kind: str = "parquet", use_old: bool = False) -> None:
        """The changed features' new side, or the old one, to files."""
        changed = self.diff(old, new, layer).select(self.key(layer))
        write_files(self.snapshot(f"{old if use_old else new}:{layer}").join(changed, self.key(layer), "left_semi"), path, kind)

    def statistics(self) -> dict[str, int]:
        """Branches, commits, layers and features of the head."""
        tree = self.tree(HEAD)
        return {"branches": len(self.branches()), "commits": len(self.meta["commits"]), "layers": len(tree), "features": sum(self.store.count(s) for _, s in tree.values())}

    # --- branches, tags, refs, configuration

    def create_branch(self, name: str, source: str = HEAD, force: bool = False, orphan: bool = False) -> None:
        full = f"refs/heads/{name}"
        if not history.valid_ref(full):
            raise RepositoryError(f"not a branch name: {name}")
        if full in self.meta["refs"] and not force:
            raise RepositoryError(f"the branch {name} is there already")
        target = None if orphan else self.resolve(source)
        if orphan:
            self._edit(lambda m: m["refs"].__setitem__(HEAD, f"ref: {full}"))
        else:
            self._edit(lambda m: self._move(m, full, target, "branch"))

    def branches(self, remote: bool = False) -> list[str]:
        prefix = "refs/remotes/" if remote else "refs/heads/"
        return sorted(r.removeprefix(prefix) for r in self.meta["refs"] if r.startswith(prefix))

    def delete_branch(self, name: str) -> None:
        if name == self.branch():
            raise RepositoryError("the current branch can't be deleted")
        self._edit(lambda m: (m["refs"].pop(f"refs/heads/{name}"), [m["config"].pop(k) for k in list(m["config"]) if k.startswith(f"branch.{name}.")]))

    def rename_branch(self, old: str, new: str, force: bool = False) -> None:
        if f"refs/heads/{new}" in self.meta["refs"] and not force:
            raise RepositoryError(f"the branch {new} is there already")

        def change(m):
            m["refs"][f"refs/heads/{new}"] = m["refs"].pop(f"refs/heads/{old}")
            if m["refs"][HEAD] == f"ref: refs/heads/{old}":
                m["refs"][HEAD] = f"ref: refs/heads/{new}"

        self._edit(change)

    def tag(self, name: str, spec: str = HEAD, message: str = "") -> None:
        commit = self.resolve(spec)
        if name in self.meta["tags"]:
            raise RepositoryError(f"the tag {name} is there already")
        self._edit(lambda m: m["tags"].__setitem__(name, {"commit": commit, "message": message, "tagger": m["config"].get("user.name")}))

    def tags(self) -> dict[str, str]:
        return {k: v["commit"] for k, v in sorted(self.meta["tags"].items())}

    def delete_tag(self, name: str) -> None:
        self._edit(lambda m: m["tags"].pop(name))

    def update_ref(self, name: str, new: str | None, old: str | None = None, reason: str = "") -> None:
        """Compare and set: with ``old`` given, the ref must have that value."""
        meta = self.meta
        if old is not None and self._deref(meta["refs"], name)[1] != old:
            raise RepositoryError(f"{name} has changed")
        self._move(meta, name, new, reason)
        self._save(meta)
        for hook in self.hooks["post_update_refs"]:
            hook(self, [name])

    def update_refs(self, changes: dict[str, str | None], reason: str = "") -> None:
        """All of them or none."""
        self._edit(lambda m: [self._move(m, k, v, reason) for k, v in changes.items()])
        for hook in self.hooks["post_update_refs"]:
            hook(self, list(changes))

    def update_sym_ref(self, name: str, target: str) -> None:
        self._edit(lambda m: m["refs"].__setitem__(name, f"ref: {target}"))

    def refs(self, prefix: str = "") -> dict[str, str]:
        return {k: v for k, v in sorted(self.meta["refs"].items()) if k.startswith(prefix)}

    def clean_refs(self) -> None:
        self._edit(lambda m: [m["refs"].pop(r, None) for r in ("MERGE_HEAD", "ORIG_HEAD", "CHERRY_PICK_HEAD")])

    def config(self, key: str | None = None, value: str | None = None, unset: bool = False):
        if key is None:
            return dict(self.meta["config"])
        if unset:
            return self._edit(lambda m: m["config"].pop(key, None))
        return self.meta["config"].get(key) if value is None else self._edit(lambda m: m["config"].__setitem__(key, value))

    # --- moving the head

    def checkout(self, spec: str, paths: list[str] | None = None, force: bool = False, side: str | None = None) -> None:
        """A branch or commit, or single layers of it into the working tree; ``side`` is ours or theirs in a conflict."""
        meta = self.meta
        if side:
            source = self._deref(meta["refs"], HEAD)[1] if side == "ours" else meta["refs"].get("MERGE_HEAD")
            spec = source or spec
        tree = self.tree(spec)
        if paths:
            for p in paths:
                if p not in tree:
                    raise RepositoryError(f"no layer {p} at {spec}")
                meta["work"][p] = meta["stage"][p] = tree[p]
                meta["conflicts"] = [c for c in meta["conflicts"] if c["layer"] != p]
        else:
            if not force and (self.changed(HEAD, "STAGE_HEAD") or self.changed("STAGE_HEAD", "WORK_HEAD")):
                raise RepositoryError("there are changes that aren't committed")
            full = f"refs/heads/{spec}"
            meta["refs"][HEAD] = f"ref: {full}" if full in meta["refs"] else self.resolve(spec)
            meta["work"], meta["stage"], meta["conflicts"] = copy.deepcopy(tree), copy.deepcopy(tree), []
        self._save(meta)

    def reset(self, spec: str = HEAD, mode: str = "mixed", paths: list[str] | None = None) -> None:
        """soft moves the head, mixed the index too, hard the working tree too; with paths only the index's layers."""
        if mode not in ("soft", "mixed", "hard"):
            raise RepositoryError(f"reset {mode} isn't supported")
        tree, commit, meta = self.tree(spec), self.resolve(spec), self.meta
        if paths:
            for p in paths:
                meta["stage"].pop(p, None)
                if p in tree:
                    meta["stage"][p] = tree[p]
        else:
            meta["refs"]["ORIG_HEAD"] = self._deref(meta["refs"], HEAD)[1]
            self._move(meta, HEAD, commit, f"reset --{mode}")
            if mode != "soft":
                meta["stage"], meta["conflicts"] = copy.deepcopy(tree), []
                meta["refs"].pop("MERGE_HEAD", None)
            if mode == "hard":
                meta["work"] = copy.deepcopy(tree)
        self._save(meta)

    # --- merging

    def _merged_tree(self, base: dict, ours: dict, theirs: dict, favour: str | None) -> tuple[dict, list[dict]]:
        """The merged tree and the conflicts, layer by layer; layers that one side alone changed are taken whole."""
        out, found = {}, []
        name = lambda t, n: (t.get(n) or [None, None])[1]
        for layer in sorted({*base, *ours, *theirs}):
            b, o, t = (name(x, layer) for x in (base, ours, theirs))
            if self.store.same(o, t) or self.store.same(b, t):
                if layer in ours:
                    out[layer] = ours[layer]
            elif self.store.same(b, o):
                if layer in theirs:
                    out[layer] = theirs[layer]
            elif o is None or t is None:
                found.append({"layer": layer, "key": None, "ancestor": b, "ours": o, "theirs": t})
                out[layer] = ours.get(layer) or theirs[layer]
            else:
                key = ours[layer][0]
                mine, other = self.store.read(o), self.store.read(t)
                ancestor = self.store.read(b) if b else mine.limit(0)
                ancestor, mine, other = merge.apart(key, ancestor, mine, other)
                if not favour:
                    found += [{"layer": layer, **r.asDict()} | {key: r[key][key], "key": r[key][key]} for r in merge.conflicts(ancestor, mine, other, key).collect()]
                out[layer] = [key, self.store.write(merge.together(merge.merge(ancestor, mine, other, key, favour), key), key)]
        return out, found

    def merge(self, *specs: str, message: str = "", no_ff: bool = False, ff_only: bool = False, favour: str | None = None, no_commit: bool = False, author: str | None = None) -> str:
        """Merges revisions into the head. Several at once only without conflicts."""
        for spec in specs:
            meta, graph = self.meta, self.graph()
            head, other = self.head(), self.resolve(spec)
            if other in graph.reachable(head):
                raise RepositoryError("there is nothing to merge")
            base = graph.merge_base(head, other)
            if base is None:
                raise RepositoryError("there is no common ancestor")
            if base == head and not no_ff and not no_commit:
                meta["refs"]["ORIG_HEAD"] = head
                self._move(meta, HEAD, other, "merge: fast-forward")
                meta["work"], meta["stage"] = copy.deepcopy(meta["commits"][other]["tree"]), copy.deepcopy(meta["commits"][other]["tree"])
                self._save(meta)
                continue
            if ff_only:
                raise RepositoryError("the merge isn't a fast-forward")
            trees = [meta["commits"][c]["tree"] for c in (base, head, other)]
            tree, found = self._merged_tree(*trees, favour)
            if found and len(specs) > 1:
                raise MergeConflict(f"{len(found)} conflicts; merge one revision at a time")
            meta = self.meta
            meta["refs"]["ORIG_HEAD"], meta["refs"]["MERGE_HEAD"] = head, other
            meta["work"], meta["stage"], meta["conflicts"] = copy.deepcopy(tree), copy.deepcopy(tree), found
            text = message or f"Merge {spec}"
            meta["state"]["message"] = text
            self._save(meta)
            if found:
                raise MergeConflict(f"{len(found)} conflicts")
            if not no_commit:
                self.commit(text, author)
        return self.head()

    def abort_merge(self) -> None:
        self.reset("ORIG_HEAD", "hard")
        self.clean_refs()

    def conflicts(self, prefix: str = "") -> list[dict]:
        return [c for c in self.meta["conflicts"] if c["layer"].startswith(prefix)]

    def merge_dry_run(self, ours: str, theirs: str) -> int:
        """How many conflicts a merge would have."""
        base = self.merge_base(ours, theirs)
        trees = [self.tree(base) if base else {}, self.tree(ours), self.tree(theirs)]
        return len(self._merged_tree(*trees, None)[1])

    def _replayed(self, parent: dict, commit: dict, head: dict) -> tuple[dict, int]:
        """The head with one commit's changes, and how many conflict."""
        out, bad = dict(head), 0
        for layer in sorted({*parent, *commit}):
            p, c = ((t.get(layer) or [None, None])[1] for t in (parent, commit))
            if self.store.same(p, c):
                continue
            key = (commit.get(layer) or parent[layer])[0]
            some = self.store.read(c or p)
            a, b = (self.store.read(x) if x else some.limit(0) for x in (p, c))
            h = self.store.read(head[layer][1]) if layer in head else some.limit(0)
            a, b, h = merge.apart(key, a, b, h)
            report = merge.commit_conflicts(a, b, h, key)
            bad += report.where("outcome = 'CONFLICT'").count()
            out[layer] = [key, self.store.write(merge.together(merge.apply_outcomes(h, report, key), key), key)]
            if c is None and not self.store.count(out[layer][1]):
                out.pop(layer)
        return out, bad

    def _apply(self, parent: dict, commit: dict, message: str, author: str | None, what: str) -> str:
        tree, bad = self._replayed(parent, commit, self.tree(HEAD))
        if bad:
            raise MergeConflict(f"{what}: {bad} conflicts")
        self._edit(lambda m: (m["refs"].__setitem__("ORIG_HEAD", self.head()), m.__setitem__("work", copy.deepcopy(tree)), m.__setitem__("stage", copy.deepcopy(tree))))
        return self.commit(message, author, allow_empty=True)

    def cherry_pick(self, spec: str) -> str:
        body = self.meta["commits"][self.resolve(spec)]
        parent = self.meta["commits"][body["parents"][0]]["tree"] if body["parents"] else {}
        return self._apply(parent, body["tree"], body["message"], body["author"], "cherry-pick")

    def revert(self, spec: str) -> str:
        name = self.resolve(spec)
        body = self.meta["commits"][name]
        parent = self.meta["commits"][body["parents"][0]]["tree"] if body["parents"] else {}
        return self._apply(body["tree"], parent, f"Revert '{body['message']}'", None, "revert")

    def abort_revert(self) -> None:
        self.reset("ORIG_HEAD", "hard")
        self.clean_refs()

    def rebase(self, upstream: str, onto: str | None = None, squash: str | None = None) -> str:
        """Replays the head's own commits on another; a conflict stops it, to be continued, skipped or aborted."""
        graph, head = self.graph(), self.head()
        up = self.resolve(upstream)
        own = graph.reachable(head) - graph.reachable(up)
        todo = [c for c in graph.first_parents(head) if c in own][::-1]
        target = self.resolve(onto) if onto else up
        self._edit(lambda m: m["state"].__setitem__("rebase", {"todo": todo, "head": head, "squash": squash}))
        self.reset(target, "hard")
        self._edit(lambda m: m["refs"].__setitem__("ORIG_HEAD", head))
        return self.continue_rebase()

    def continue_rebase(self, skip: bool = False) -> str:
        state = self.meta["state"].get("rebase")
        if not state:
            raise RepositoryError("no rebase is going on")
        start = self.head()
        while state["todo"]:
            name = state["todo"][0]
            if not skip:
                body = self.meta["commits"][name]
                parent = self.meta["commits"][body["parents"][0]]["tree"] if body["parents"] else {}
                self._apply(parent, body["tree"], body["message"], body["author"], "rebase")
            skip = False
            state["todo"].pop(0)
            self._edit(lambda m: m["state"].__setitem__("rebase", state))
        if state["squash"] and self.head() != start:
            self.reset(start, "soft")
            self.commit(state["squash"], allow_empty=True)
        self._edit(lambda m: m["state"].pop("rebase"))
        return self.head()

    def abort_rebase(self) -> None:
        head = self.meta["state"]["rebase"]["head"]
        self._edit(lambda m: m["state"].pop("rebase"))
        self.reset(head, "hard")

    def squash(self, since: str, until: str = HEAD, message: str = "") -> str:
        """Makes one commit of a first-parent range, both ends included, and replays what follows."""
        graph = self.graph()
        first, last, head = self.resolve(since), self.resolve(until), self.head()
        line = graph.first_parents(head)
        if first not in line or last not in line or line.index(first) < line.index(last):
            raise RepositoryError("the range isn't on the head's first-parent line")
        inside = line[line.index(last) : line.index(first) + 1]
        if any(len(graph.children.get(c, [])) > 1 for c in inside[1:]) or any(len(graph.parents[c]) > 1 for c in inside):
            raise RepositoryError("a branch or merge begins inside the range")
        meta = self.meta
        body = meta["commits"][last]
        now = self._commit_object(meta, body["tree"], meta["commits"][first]["parents"], message or body["message"], body["author"], ts=body["ts"])
        for c in reversed(line[: line.index(last)]):
            b = meta["commits"][c]
            now = self._commit_object(meta, b["tree"], [now, *b["parents"][1:]], b["message"], b["author"], b["committer"], b["ts"])
        self._move(meta, HEAD, now, "squash")
        self._save(meta)
        return now

    # --- patches

    def create_patch(self, old: str, new: str) -> dict[str, DataFrame]:
        return {layer: self.diff(old, new, layer) for layer in self.changed(old, new)}

    def apply_patch(self, patch: dict[str, DataFrame], partial: bool = False, reverse: bool = False) -> None:
        for layer, entries in patch.items():
            key = self.key(layer)
            self.write(layer, merge.apply_patch(merge.reversed_patch(entries, key) if reverse else entries, self.snapshot(layer), key, partial), key)

    # --- indexes

    def create_index(self, layer: str, x: str, y: str, bounds: tuple[float, float, float, float], extra: list[str] | None = None, full_history: bool = False) -> None:
        info = {"layer": layer, "x": x, "y": y, "bounds": list(bounds), "extra": extra or [], "snapshots": {}}
        self._edit(lambda m: m["indexes"].__setitem__(f"{layer}/{x},{y}", info))
        tips = self.graph().reachable(self.head()) if full_history and self.head() else [self.head()] if self.head() else []
        for commit in tips:
            self._refresh_indexes(commit)

    def _refresh_indexes(self, commit: str) -> None:
        """Brings each index up to a commit, from the parent's index where there is one."""
        meta = self.meta
        body = meta["commits"][commit]
        for name, info in meta["indexes"].items():
            if info["layer"] not in body["tree"]:
                continue
            key, snap = body["tree"][info["layer"]]
            if snap in info["snapshots"]:
                continue
            parent = next((meta["commits"][p]["tree"].get(info["layer"]) for p in body["parents"]), None)
            args = (key, info["x"], info["y"], tuple(info["bounds"]), info["extra"])
            if parent and parent[1] in info["snapshots"]:
                rows = updated(self.store.read(info["snapshots"][parent[1]]), self.store.read(parent[1]), self.store.read(snap), *args)
            else:
                rows = build(self.store.read(snap), *args)
            written = self.store.write(rows, key)
            self._edit(lambda m, n=name, s=snap, w=written: m["indexes"][n]["snapshots"].__setitem__(s, w))

    def index(self, layer: str, spec: str = HEAD) -> DataFrame | None:
        snap = self.tree(spec)[layer][1]
        found = next((i["snapshots"][snap] for i in self.meta["indexes"].values() if i["layer"] == layer and snap in i["snapshots"]), None)
        return self.store.read(found) if found else None

    def update_index(self, name: str, extra: list[str] | None = None, bounds: tuple[float, float, float, float] | None = None) -> None:
        def change(m):
            info = m["indexes"][name]
            info["snapshots"] = {}
            info["extra"] = extra if extra is not None else info["extra"]
            info["bounds"] = list(bounds) if bounds else info["bounds"]

        self._edit(change)
        if self.head():
            self._refresh_indexes(self.head())

    def drop_index(self, name: str) -> None:
        self._edit(lambda m: m["indexes"].pop(name))

    def indexes(self) -> list[dict]:
        return [{"name": k, **{a: b for a, b in v.items() if a != "snapshots"}} for k, v in sorted(self.meta["indexes"].items())]

    # --- transactions

    def begin(self) -> str:
        name = uuid.uuid4().hex
        self._edit(lambda m: m["transactions"].__setitem__(name, {"refs": dict(m["refs"]), "began": int(time.time() * 1000), "base": self._deref(m["refs"], HEAD)[1]}))
        return name

    def transaction_update(self, name: str, ref: str, commit: str) -> None:
        self._edit(lambda m: m["transactions"][name]["refs"].__setitem__(ref, commit))

    def end(self, name: str, abort: bool = False, rebase: bool = False) -> None:
        """Brings the transaction's refs in; one that moved on meanwhile is merged, or rebased."""
        held = self.meta["transactions"][name]
        if not abort:
            for ref, commit in held["refs"].items():
                now = self.meta["refs"].get(ref)
                if commit == now or commit.startswith("ref: "):
                    continue
                if now is None or now in self.graph().reachable(commit):
                    self.update_ref(ref, commit, reason="transaction")
                    if ref == self._deref(self.meta["refs"], HEAD)[0]:
                        self.reset(commit, "hard")
                elif ref.startswith("refs/heads/") and commit not in self.graph().reachable(now):
                    here = self.branch()
                    self.checkout(ref.removeprefix("refs/heads/"), force=True)
                    if rebase:
                        theirs = self.head()
                        self.reset(commit, "hard")
                        self.rebase(theirs)
                    else:
                        self.merge(commit, message="Merge transaction")
                    if here and here != self.branch():
                        self.checkout(here, force=True)
        self._edit(lambda m: m["transactions"].pop(name))

    # --- remotes

    def add_remote(self, name: str, url: str) -> None:
        if name in self.meta["remotes"]:
            raise RepositoryError(f"the remote {name} is there already")
        self._edit(lambda m: m["remotes"].__setitem__(name, url))

    def remove_remote(self, name: str) -> None:
        self._edit(lambda m: (m["remotes"].pop(name), [m["refs"].pop(r) for r in list(m["refs"]) if r.startswith(f"refs/remotes/{name}/")]))

    def remotes(self) -> dict[str, str]:
        return dict(self.meta["remotes"])

    def ls_remote(self, name: str) -> dict[str, str]:
        return Repo(self.spark, self.remotes()[name]).refs("refs/heads/")

    def _send(self, source: Repo, target: Repo, tips: list[str], depth: int | None = None) -> int:
        """Copies commits that the target lacks, and their snapshots; returns how many commits went."""
        graph, have, meta = source.graph(), set(target.meta["commits"]), source.meta
        wanted = set().union(*[graph.shallow(t, depth) if depth else graph.reachable(t) for t in tips]) - have if tips else set()
        for c in wanted:
            for _, snap in meta["commits"][c]["tree"].values():
                target.store.copy_from(source.store, snap)
        target._edit(lambda m: m["commits"].update({c: meta["commits"][c] for c in wanted}))
        return len(wanted)

    def fetch(self, name: str, prune: bool = False, depth: int | None = None, tags: bool = True) -> dict[str, str]:
        """Brings a remote's branches into refs/remotes; returns what changed: ADDED, UPDATED or REMOVED."""
        other = Repo(self.spark, self.remotes()[name])
        theirs = other.refs("refs/heads/")
        self._send(other, self, list(theirs.values()), depth)
        mine = {history.map_ref(r, f"refs/remotes/{name}/", "refs/heads/"): c for r, c in self.refs(f"refs/remotes/{name}/").items()}
        out = {r: "UPDATED" if r in mine else "ADDED" for r, c in theirs.items() if mine.get(r) != c}
        out |= {r: "REMOVED" for r in mine if r not in theirs} if prune else {}
        changes = {history.map_ref(r, "refs/heads/", f"refs/remotes/{name}/"): theirs.get(r) for r in out}
        self._edit(lambda m: ([self._move(m, r, c, "fetch") for r, c in changes.items()], tags and [m["tags"].setdefault(t, v) for t, v in other.meta["tags"].items() if v["commit"] in m["commits"]]))
        return out

    def push(self, name: str, branch: str | None = None, force: bool = False) -> int:
        branch = branch or self.branch()
        other, ref = Repo(self.spark, self.remotes()[name]), f"refs/heads/{branch}"
        tip, now = self.meta["refs"][ref], other.meta["refs"].get(ref)
        if now and now not in self.graph().reachable(tip) and not force:
            raise RepositoryError("the remote branch has commits that this one lacks")
        sent = self._send(self, other, [tip])
        other.update_ref(ref, tip, reason="push")
        self._edit(lambda m: self._move(m, f"refs/remotes/{name}/{branch}", tip, "push"))
        return sent

    def pull(self, name: str, branch: str | None = None, rebase: bool = False) -> str:
        branch = branch or self.branch()
        self.fetch(name)
        source = f"refs/remotes/{name}/{branch}"
        if self.head() is None:
            self.reset(source, "hard")
            return self.head()
        if self.resolve(source) in self.graph().reachable(self.head()):
            return self.head()
        return self.rebase(source) if rebase else self.merge(source)

    @staticmethod
    def clone(spark: SparkSession, url: str, path: str, depth: int | None = None, branch: str | None = None) -> Repo:
        source, out = Repo(spark, url), Repo(spark, path)
        out.add_remote("origin", url)
        out.fetch("origin", depth=depth)
        name = branch or source.branch() or "master"
        if f"refs/remotes/origin/{name}" in out.meta["refs"]:
            out._edit(lambda m: (m["refs"].__setitem__(f"refs/heads/{name}", m["refs"][f"refs/remotes/origin/{name}"]), m["refs"].__setitem__(HEAD, f"ref: refs/heads/{name}")))
            out.reset(HEAD, "hard")
        return out

    # --- pull requests

    def pull_request(self, number: int, source: str, target: str = "master", title: str = "") -> dict:
        if self.merge_base(source, target) is None:
            raise RepositoryError("the branches have no common ancestor")
        body = {"id": number, "source": source, "target": target, "title": title, "state": "open", "origin": self.resolve(target)}
        self._edit(lambda m: m["pulls"].__setitem__(str(number), body))
        return body

    def pull_requests(self) -> list[dict]:
        return [self.meta["pulls"][k] for k in sorted(self.meta["pulls"], key=int)]

    def find_pull_request(self, number: int) -> dict | None:
        return self.meta["pulls"].get(str(number))

    def pull_request_health(self, number: int) -> dict:
        p = self.meta["pulls"][str(number)]
        ahead, behind = self.graph().ahead_behind(self.resolve(p["source"]), self.resolve(p["target"]))
        base = self.merge_base(p["source"], p["target"])
        return {"state": p["state"], "commits": ahead, "behind": behind, "conflicts": self.merge_dry_run(p["target"], p["source"]), "layers": self.changed(base, p["source"])}

    def merge_pull_request(self, number: int) -> str:
        health, p = self.pull_request_health(number), self.meta["pulls"][str(number)]
        if p["state"] != "open" or not health["commits"] or health["conflicts"]:
            raise RepositoryError(f"can't be merged: {health}")
        here = self.branch()
        self.checkout(p["target"], force=True)
        out = self.merge(p["source"], message=p["title"] or f"Merge pull request {number}", no_ff=True)
        self._edit(lambda m: m["pulls"][str(number)].__setitem__("state", "merged"))
        if here and here != p["target"]:
            self.checkout(here, force=True)
        return out

    def close_pull_request(self, number: int) -> None:
        if self.meta["pulls"][str(number)]["state"] == "merged":
            raise RepositoryError("it is merged")
        self._edit(lambda m: m["pulls"][str(number)].__setitem__("state", "closed"))

    def delete_pull_request(self, number: int) -> None:
        self._edit(lambda m: m["pulls"].pop(str(number)))

    # --- query language

    def ql(self, text: str) -> DataFrame | dict[str, int]:
        """SELECT gives rows; INTO, INSERT, UPDATE and DELETE change the working tree and give counts."""
        first = ql.parse(text)
        revision, layer = ql.split_table(first.table)
        if first.kind == "INSERT":
            source = self._select(first.source) if first.source else None
            st = ql.parse(text, self.key(layer))
            return self._counted(lambda: self.write(layer, ql.insert(st, self.snapshot(layer), source, self.key(layer)), self.key(layer)))
        st = ql.parse(text, self.key(layer) if revision in ("WORK_HEAD", "STAGE_HEAD") else self.tree(revision)[layer][0])
        if st.kind == "SELECT":
            rows = self._select(st)
            if not st.into:
                return rows
            target = ql.split_table(st.into)[1]
            return self._counted(lambda: self.insert(target, rows, self.key(layer)))
        change = ql.update if st.kind == "UPDATE" else ql.delete
        return self._counted(lambda: self.write(layer, change(st, self.snapshot(layer)), self.key(layer)))

    def _select(self, st: ql.Statement) -> DataFrame:
        revision, layer = ql.split_table(st.table)
        tree = self.tree(revision)
        if layer not in tree:
            raise RepositoryError(f"no table {st.table}")
        return ql.select(st, self.store.read(tree[layer][1]), tree[layer][0])

    def _counted(self, change: Callable[[], None]) -> dict[str, int]:
        before = self.tree()
        change()
        meta = self.meta
        out = {"added": 0, "modified": 0, "removed": 0}
        for layer in sorted({*before, *meta["work"]}):
            if not self.store.same((before.get(layer) or [0, None])[1], (meta["work"].get(layer) or [0, None])[1]):
                for k, v in d.counts(self._changes(before, meta["work"], layer)).first().asDict().items():
                    out[k] += v
        return out
