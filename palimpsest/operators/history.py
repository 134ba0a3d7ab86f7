"""The commit graph: reachability, logs, ancestors, blame and revision specs.

A commits table has commit, parents (ordered array), author, committer, ts and message. Orders that are sequential by
nature (topological order, ancestors) walk the (commit, parents) pairs on the driver, which holds them in arrays, of a
large table only those above the tips; ``Graph.LIMIT`` bounds how many it takes. Everything about the rows themselves
stays a DataFrame.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import deque
from collections.abc import Callable, Mapping, Set
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def edges(commits: DataFrame) -> DataFrame:
    """(commit, nth, parent), one row per parent."""
    return commits.select("commit", F.posexplode("parents").alias("nth", "parent"))


class Marked(Set):
    """A set of a graph's commits: a flag for each commit of the graph."""

    def __init__(self, graph: Graph, flags: bytearray | np.ndarray):
        self.graph, self.flags = graph, np.frombuffer(flags, dtype=np.uint8).astype(bool) if isinstance(flags, bytearray) else flags

    @classmethod
    def _from_iterable(cls, it) -> set:
        return set(it)

    def places(self) -> np.ndarray:
        return np.flatnonzero(self.flags)

    def __contains__(self, c) -> bool:
        at = self.graph.place(c)
        return at >= 0 and bool(self.flags[at])

    def __iter__(self):
        places = self.places()
        for k in range(0, len(places), 1 << 16):
            yield from self.graph.ids[places[k : k + (1 << 16)]].tolist()

    def __len__(self) -> int:
        return int(np.count_nonzero(self.flags))

    def __and__(self, other):
        return Marked(self.graph, self.flags & other.flags) if isinstance(other, Marked) and other.graph is self.graph else super().__and__(other)

    def __sub__(self, other):
        return Marked(self.graph, self.flags & ~other.flags) if isinstance(other, Marked) and other.graph is self.graph else super().__sub__(other)


class Links(Mapping):
    """Commits with something of each, by a function of the commit's place."""

    def __init__(self, graph: Graph, of: Callable[[int], object]):
        self.graph, self.of = graph, of

    def __getitem__(self, c):
        at = self.graph.place(c)
        if at < 0:
            raise KeyError(c)
        return self.of(at)

    def __iter__(self):
        ids = self.graph.ids
        for k in range(0, len(ids), 1 << 16):
            yield from ids[k : k + (1 << 16)].tolist()

    def __len__(self) -> int:
        return len(self.graph.ids)


def _packed(batches):
    """Each batch of (commit, parents, ts) as one compressed row, so that the driver's JVM holds little of it."""
    for batch in batches:
        if len(batch):
            held = pa.BufferOutputStream()
            with pa.ipc.new_stream(held, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([held.getvalue().to_pybytes()], pa.binary())], names=["rows"])


def _unpacked(packed: bytes) -> tuple[np.ndarray, ...]:
    """(ids, numbers of parents, parents, times) of a compressed batch."""
    part = pa.ipc.open_stream(packed).read_next_batch()
    up = part.column("parents").flatten().to_numpy(zero_copy_only=False)
    return part.column("commit").to_numpy(zero_copy_only=False), part.column("parents").value_lengths().to_numpy(), up, part.column("ts").fill_null(Graph.NO_TIME).to_numpy()


def _starts(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=out[1:])
    return out


class Graph:
    """Commits with their ordered parents and, if given, times, in arrays by the rank of the commit's id.

    Commit k has the parents ``up[starts[k] : starts[k + 1]]``, by their ranks, -1 for one that isn't in the table; ``lost``
    has the places of those and their ids. That is some 20 bytes a commit and 4 a link, beside a flag or a number a
    commit in the walks.
    """

    LIMIT = 20_000_000
    #: Commits that are held whole whatever the tips are; levels that are asked for, and how many commits by a filter.
    WHOLE, LEVELS, ASKED = 1_000_000, 100, 1000
    NO_TIME = np.iinfo(np.int64).min

    def __init__(self, parents: dict, times: dict | None = None):
        times = times or {}
        ids = np.array(list(parents), dtype=None if parents and all(isinstance(c, int) for c in parents) else object)
        linked = [p for ps in parents.values() for p in ps]
        at = [self.NO_TIME if (t := times.get(c)) is None else round(t.timestamp() * 1_000_000) if hasattr(t, "timestamp") else t for c in parents]
        self._pack(ids, np.array([len(ps) for ps in parents.values()], dtype=np.int64), np.array(linked, dtype=ids.dtype if all(isinstance(p, int) for p in linked) else object), np.array(at, dtype=None if at else np.int64))

    @staticmethod
    def of(commits: DataFrame, tips: list | None = None) -> Graph:
        """The graph of all commits. With ``tips``, of more than ``WHOLE`` commits only their ancestors, found level by
        level, are held, which is all that walks from these tips need; histories of over ``LEVELS`` levels are held whole.
        """
        time = F.unix_micros(F.col("ts").cast("timestamp")) if "timestamp" in dict(commits.dtypes)["ts"] else F.col("ts").cast("long")
        rows = commits.where("commit is not null").select("commit", F.coalesce("parents", F.array().cast(commits.schema["parents"].dataType)).alias("parents"), time.alias("ts"))
        kind = np.int64 if dict(commits.dtypes)["commit"] in ("tinyint", "smallint", "int", "bigint") else object
        n, links = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("parents")), F.lit(0))).first()
        out = Graph.__new__(Graph)
        if tips is not None and n > Graph.WHOLE and (found := Graph._ancestors(rows, tips, kind)):
            out._pack(*found)
            return out
        if n > Graph.LIMIT:
            raise ValueError(f"over {Graph.LIMIT} commits: walk the edges as a DataFrame instead")
        ids, counts, linked, at = np.empty(n, dtype=kind), np.empty(n, dtype=np.int32), np.empty(links, dtype=kind), np.empty(n, dtype=np.int64)
        k = m = 0
        for x in rows.mapInArrow(_packed, "rows binary").toLocalIterator():  # the driver's JVM holds a partition at a time
            part = _unpacked(x["rows"])
            k, m = k + len(part[0]), m + len(part[2])
            ids[k - len(part[0]) : k], counts[k - len(part[0]) : k], linked[m - len(part[2]) : m], at[k - len(part[0]) : k] = part
        out._pack(ids, counts, linked, at)
        return out

    @staticmethod
    def _ancestors(rows: DataFrame, tips: list, kind: type) -> tuple[np.ndarray, ...] | None:
        """(ids, numbers of parents, parents, times) of the tips and all above them; None where the levels don't end."""
        held: list[tuple[np.ndarray, ...]] = [(np.empty(0, dtype=kind), np.empty(0, dtype=np.int32), np.empty(0, dtype=kind), np.empty(0, dtype=np.int64))]
        seen = level = np.unique(np.array([t for t in tips if t is not None], dtype=kind))
        for _ in range(Graph.LEVELS):
            if not len(level):
                return tuple(np.concatenate(x) for x in zip(*held, strict=True))
            asked = rows.where(F.col("commit").isin(level.tolist())) if len(level) <= Graph.ASKED else rows.join(_listed(rows.sparkSession, level).drop("at"), "commit", "left_semi")
            parts = [_unpacked(x["rows"]) for x in asked.mapInArrow(_packed, "rows binary").collect()]
            held += parts
            above = np.unique(np.concatenate([x[2] for x in parts])) if parts else seen[:0]
            at = np.minimum(np.searchsorted(seen, above), len(seen) - 1)
            level = above[seen[at] != above]
            seen = np.sort(np.concatenate([seen, level]))
            if len(seen) > Graph.LIMIT:
                return None
        return None

    def _pack(self, ids: np.ndarray, counts: np.ndarray, linked: np.ndarray, times: np.ndarray) -> None:
        starts = _starts(counts)
        if len(ids) > 1 and not (ids[1:] > ids[:-1]).all():  # of rows that repeat a commit the last one holds
            order = np.argsort(ids, kind="stable")
            order = order[np.append(ids[order][1:] != ids[order][:-1], True)]
            ids, counts, times, begins = ids[order], counts[order], times[order], starts[order]
            starts = _starts(counts)
            linked = linked[np.repeat(begins - starts[:-1], counts) + np.arange(starts[-1])]
        self.ids, self.starts, self._times = ids, starts, times
        self.up = np.full(len(linked), -1, dtype=np.int32)
        for k in range(0, len(linked) if len(ids) else 0, 1 << 20):
            part = linked[k : k + (1 << 20)]
            at = np.minimum(np.searchsorted(ids, part), len(ids) - 1)
            self.up[k : k + len(part)] = np.where(ids[at] == part, at, -1)
        lost = np.flatnonzero(self.up < 0)
        self.lost = (lost, linked[lost])

    @property
    def parents(self) -> Links:  # not kept, as a cycle of references would keep the arrays
        return Links(self, self._parents)

    @property
    def times(self) -> Links:
        return Links(self, lambda k: None if self._times[k] == self.NO_TIME else self._times[k].item())

    def place(self, c) -> int:
        """The rank of a commit's id, -1 where it isn't in the table."""
        if not len(self.ids) or isinstance(c, str) != isinstance(self.ids[0], str) or c is None:
            return -1
        k = int(np.searchsorted(self.ids, c))
        return k if k < len(self.ids) and self.ids[k] == c else -1

    def _parents(self, k: int) -> list:
        where, names = self.lost
        return [self.ids[p : p + 1].tolist()[0] if p >= 0 else names[np.searchsorted(where, n) :][:1].tolist()[0] for n, p in enumerate(self.up[self.starts[k] : self.starts[k + 1]].tolist(), int(self.starts[k]))]

    @cached_property
    def _down(self) -> tuple[np.ndarray, np.ndarray]:
        known = np.flatnonzero(self.up >= 0)
        order = known[np.argsort(self.up[known], kind="stable")]
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.starts))[order], np.searchsorted(self.up[order], np.arange(len(self.ids) + 1))

    @property
    def children(self) -> Links:
        owner, cuts = self._down
        return Links(self, lambda k: self.ids[owner[cuts[k] : cuts[k + 1]]].tolist())

    def check(self, *tips) -> None:
        """An unknown commit is an error, not one without history."""
        if missing := [t for t in tips if t not in self.parents]:
            raise ValueError(f"no such commit: {', '.join(map(str, missing))}")

    def _places(self, tips) -> list[int]:
        return [k for k in map(self.place, tips) if k >= 0]

    def reachable(self, *tips, until: Set | None = None) -> Marked:
        seen, todo = bytearray(len(self.ids)), self._places(tips)
        stop = bytearray(len(self.ids))
        for k in self._places(until or ()):
            stop[k] = 1
        starts, up = memoryview(self.starts), memoryview(self.up)
        while todo:
            k = todo.pop()
            if not seen[k] and not stop[k]:
                seen[k] = 1
                todo += [p for p in up[starts[k] : starts[k + 1]] if p >= 0 and not seen[p]]
        return Marked(self, seen)

    def merge_bases(self, a, b) -> list:
        """Common ancestors that aren't ancestors of another one."""
        self.check(a, b)
        common = (self.reachable(a) & self.reachable(b)).flags
        links = self.up[np.repeat(common, np.diff(self.starts))]  # ancestors of common ones are common, so a parent of one is what is left out
        lower = np.zeros(len(self.ids), dtype=bool)
        lower[links[links >= 0]] = True
        return self.ids[common & ~lower].tolist()

    def merge_base(self, a, b):
        """The best common ancestor: of several the latest, then the largest."""
        found = self.merge_bases(a, b)
        return max(found, key=lambda c: (self._times[self.place(c)], c)) if found else None

    def ahead_behind(self, a, b) -> tuple[int, int]:
        self.check(a, b)
        x, y = self.reachable(a), self.reachable(b)
        return len(x - y), len(y - x)

    def _first_parents(self, tip) -> np.ndarray:
        out, k = array("i"), self.place(tip)
        starts, up = memoryview(self.starts), memoryview(self.up)
        while k >= 0:
            out.append(k)
            k = up[starts[k]] if starts[k] < starts[k + 1] else -1
        return np.frombuffer(out, dtype=np.int32) if out else np.zeros(0, dtype=np.int32)

    def first_parents(self, tip) -> list:
        return self.ids[self._first_parents(tip)].tolist()

    def depth(self, commit) -> int:
        """Fewest steps to a root."""
        todo, seen = deque([(commit, 0)]), {commit}
        while todo:
            c, d = todo.popleft()
            if not self.parents.get(c):
                return d
            for p in self.parents[c]:
                if p not in seen:
                    seen.add(p)
                    todo.append((p, d + 1))
        return 0

    def shortest_path(self, a, b) -> list:
        """From a up to its ancestor b, both included; empty if there is none."""
        came, todo = {a: None}, deque([a])
        while todo:
            c = todo.popleft()
            if c == b:
                out = [c]
                while came[out[-1]] is not None:
                    out.append(came[out[-1]])
                return out[::-1]
            for p in self.parents.get(c, ()):
                if p not in came:
                    came[p] = c
                    todo.append(p)
        return []

    def _chronological(self, *tips) -> np.ndarray:
        heap, seen, out = [], bytearray(len(self.ids)), array("i")
        starts, up, at = memoryview(self.starts), memoryview(self.up), memoryview(self._times)
        todo = self._places(tips)
        while True:
            for k in todo:
                if k >= 0 and not seen[k]:
                    seen[k] = 1
                    heapq.heappush(heap, (-at[k], k))
            if not heap:
                return np.frombuffer(out, dtype=np.int32) if out else np.zeros(0, dtype=np.int32)
            k = heapq.heappop(heap)[1]
            out.append(k)
            todo = up[starts[k] : starts[k + 1]]

    def chronological(self, *tips) -> list:
        """Latest first among what is open, a commit after all that lead to it there; commits without a time last."""
        return self.ids[self._chronological(*tips)].tolist()

    def _by_time(self, *tips) -> np.ndarray:
        places = self.reachable(*tips).places()
        return places[np.lexsort((places, self._times[places]))[::-1]]

    def _topological(self, *tips) -> np.ndarray:
        inside = self.reachable(*tips).flags
        links = self.up[np.repeat(inside, np.diff(self.starts))]
        waiting = memoryview(np.bincount(links[links >= 0], minlength=len(self.ids)).astype(np.int32))
        starts, up, out = memoryview(self.starts), memoryview(self.up), array("i")
        todo = [k for k in dict.fromkeys(reversed(self._places(tips))) if not waiting[k]]
        while todo:
            k = todo.pop()
            out.append(k)
            for p in reversed(up[starts[k] : starts[k + 1]]):
                if p >= 0:
                    waiting[p] -= 1
                    if not waiting[p]:
                        todo.append(p)
        return np.frombuffer(out, dtype=np.int32) if out else np.zeros(0, dtype=np.int32)

    def topological(self, *tips) -> list:
        """Children before parents, one line at a time."""
        return self.ids[self._topological(*tips)].tolist()

    def shallow(self, tip, depth: int) -> set:
        """Commits within ``depth`` generations of the tip."""
        seen, level = set(), {tip}
        for _ in range(depth):
            seen |= level
            level = {p for c in level for p in self.parents.get(c, ()) if p in self.parents} - seen
        return seen

    def is_sparse_between(self, a, b, sparse: set) -> bool:
        """Whether a sparse commit lies on the way from a to its ancestor b."""
        return bool((self.reachable(a) - self.reachable(b)) & sparse)


def _listed(spark: SparkSession, ids: np.ndarray, name: str = "commit") -> DataFrame:
    kind = pa.int64() if ids.dtype.kind == "i" else pa.string()
    return spark.createDataFrame(pa.table({name: pa.array(ids, kind), "at": pa.array(np.arange(len(ids), dtype=np.int64))}))


def log(commits: DataFrame, graph: Graph, tips: list, since=None, author: str | None = None, committer: str | None = None, after=None, before=None, skip: int = 0, limit: int | None = None, first_parent: bool = False, topo: bool = False, by_time: bool = False, paths: DataFrame | None = None) -> DataFrame:
    """Commits reachable from the tips and not from ``since``, in order (column ``at``).

    ``author`` and ``committer`` are regular expressions for the whole name; commits without a name pass. ``paths`` is
    a table with the commits that touched the wanted paths. ``by_time`` goes by the times alone, so that a parent with a
    later time comes before its child. Times are inclusive. Unknown tips are errors.
    """
    graph.check(*tips, *([] if since is None else [since]))
    order = graph._first_parents(tips[0]) if first_parent else graph._topological(*tips) if topo else graph._by_time(*tips) if by_time else graph._chronological(*tips)
    if since is not None:
        order = order[~graph.reachable(since).flags[order]]
    out = commits.join(_listed(commits.sparkSession, graph.ids[order]), "commit")
    for column, pattern in (("author", author), ("committer", committer)):
        if pattern is not None:
            out = out.where(F.col(column).isNull() | F.col(column).rlike(f"^(?:{pattern})$"))
    if after is not None:
        out = out.where(F.col("ts") >= F.lit(after))
    if before is not None:
        out = out.where(F.col("ts") <= F.lit(before))
    if paths is not None:
        out = out.join(paths.select("commit").distinct(), "commit", "left_semi")
    out = out.orderBy("at")
    out = out.offset(skip) if skip else out
    return out.limit(limit) if limit is not None else out


def reachable_rows(commits: DataFrame, graph: Graph, tip) -> DataFrame:
    return commits.join(_listed(commits.sparkSession, graph.ids[graph.reachable(tip).places()]).drop("at"), "commit", "left_semi")


def reachable_distributed(commits: DataFrame, tips: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Reachability without a driver-side graph: a frontier loop that drops what it has seen.

    ``store`` cuts the lineage of each step (checkpoint, or a written table). Takes as many steps as the longest way.
    """
    links = edges(commits).select("commit", "parent")
    seen = frontier = store(tips.select("commit").distinct())
    while True:
        frontier = store(frontier.join(links, "commit").select(F.col("parent").alias("commit")).distinct().join(seen, "commit", "left_anti"))
        if not frontier.limit(1).count():
            return seen
        seen = store(seen.unionByName(frontier))


def touched_paths(versions: DataFrame, path: str, value: list[str]) -> DataFrame:
    """(commit, path) where a path's values differ from its version before, by ts then commit."""
    w = Window.partitionBy(path).orderBy("ts", "commit")
    before = F.lag(F.struct(*value)).over(w)
    return versions.select("commit", path, F.struct(*value).alias("now"), before.alias("before")).where(~F.col("now").eqNullSafe(F.col("before"))).select("commit", path)


def commit_at(commits: DataFrame, when) -> DataFrame:
    """The latest commit strictly before a time, ties to the larger id: a running maximum, no sort."""
    return commits.where(F.col("ts") < F.lit(when)).agg(F.max(F.struct("ts", "commit")).alias("m")).where("m is not null").select("m.commit", "m.ts")


def blame(versions: DataFrame, key: str, attrs: list[str], order: list[str]) -> DataFrame:
    """Per key and attribute: its present value (text) and the commit that last changed it.

    ``versions`` has a row for each commit that wrote the key. One window over the key's versions finds the changes and
    one aggregation the last of each attribute; the first version changes every attribute.
    """
    w = Window.partitionBy(key).orderBy(*order)
    rows = versions.select(key, "commit", *order, *attrs, F.row_number().over(w).alias("__n"), *[F.lag(a).over(w).alias(f"__was_{a}") for a in attrs])
    place = F.struct(*order)
    changed = lambda a: F.when((F.col("__n") == 1) | ~F.col(a).eqNullSafe(F.col(f"__was_{a}")), place)
    last = rows.groupBy(key).agg(*[F.max_by("commit", changed(a)).alias(f"__c_{a}") for a in attrs], *[F.max_by(F.struct(F.col(a).cast("string").alias("v")), place).alias(f"__v_{a}") for a in attrs])
    return last.select(key, F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"__v_{a}.v").alias("value"), F.col(f"__c_{a}").alias("commit")) for a in attrs])).alias("b")).select(key, "b.*")


def missing_objects(nodes: DataFrame, objects: DataFrame, column: str = "object_id") -> DataFrame:
    """Integrity: nodes whose object isn't there."""
    return nodes.join(objects.select(column).distinct(), column, "left_anti")


def rev_parse(spec: str, refs: dict[str, str], graph: Graph) -> str | None:
    """``HEAD``, ref names (short too), id prefixes, ``^``, ``^n`` and ``~n``; None for a missing parent.

    An ambiguous prefix raises, as does a spec that names nothing.
    """
    base, steps = re.match(r"^(.*?)((?:\^\d*|~\d*)*)$", spec).groups()
    found = next((refs[n] for n in (base, f"refs/heads/{base}", f"refs/tags/{base}", f"refs/remotes/{base}") if n in refs), None)
    while isinstance(found, str) and found.startswith("ref: "):
        found = refs.get(found[5:])
    if found is None:
        hits = [c for c in graph.parents if str(c).startswith(base)] if base else []
        exact = [c for c in hits if str(c) == base]
        if len(exact or hits) != 1:
            raise ValueError(f"{'ambiguous' if hits else 'unknown'} revision: {spec}")
        found = (exact or hits)[0]
    for mark, count in re.findall(r"([\^~])(\d*)", steps):
        n = int(count) if count else 1
        if mark == "^" and n:
            parents = graph.parents.get(found, [])
            found = parents[n - 1] if n <= len(parents) else None
        elif mark == "~":
            for _ in range(n):
                found = (graph.parents.get(found) or [None])[0]
        if found is None:
            return None
    return found


def valid_ref(name: str) -> bool:
    """Whether a full ref name keeps the usual rules: two parts at least, no empty or dotted ones, no odd marks."""
    if "/" not in name or name == "@" or "@{" in name or ".." in name or re.search(r"[\x00-\x20\x7f~^:?*\[\\]", name):
        return False
    return all(p and not p.startswith(".") and not p.endswith((".lock", ".")) for p in name.split("/"))


def map_ref(name: str, source: str, target: str) -> str:
    """Moves a ref from one namespace to another."""
    return target + name[len(source) :] if name.startswith(source) else name


def stats(commits: DataFrame) -> DataFrame:
    """Commits, authors, merges and roots."""
    return commits.agg(F.count(F.lit(1)).alias("commits"), F.countDistinct("author").alias("authors"), F.count(F.when(F.size("parents") > 1, 1)).alias("merges"), F.count(F.when(F.size("parents") == 0, 1)).alias("roots"))


def named(column: str, pattern: str) -> Column:
    return F.col(column).isNull() | F.col(column).rlike(f"^(?:{pattern})$")
