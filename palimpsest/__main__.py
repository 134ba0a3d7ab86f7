"""``python -m palimpsest REPOSITORY COMMAND ...``: a thin terminal front of ``Repo``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from palimpsest.operators.repository import Repo


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="palimpsest")
    out.add_argument("repository")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, **flags) -> None:
        c = commands.add_parser(name)
        for a in arguments:
            c.add_argument(a.rstrip("?*"), nargs="?" if a.endswith("?") else "*" if a.endswith("*") else None)
        for flag, kind in flags.items():
            c.add_argument(f"--{flag.replace('_', '-')}", **({"action": "store_true"} if kind is bool else {"type": kind}))

    for name in ("init", "status", "branches", "tags", "conflicts", "show-ref", "index-list", "remotes", "statistics"):
        command(name)
    command("add", "paths*", update_only=bool)
    command("commit", message=str, author=str, amend=bool, allow_empty=bool)
    command("log", "until?", since=str, author=str, skip=int, limit=int, first_parent=bool, topo=bool)
    command("diff", "old", "new", "layer?", count=bool)
    command("ls", "revision?")
    command("show", "spec")
    command("ql", "statement")
    command("checkout", "spec", force=bool)
    command("branch", "name", "source?", delete=bool, force=bool)
    command("tag", "name", "spec?", delete=bool)
    command("merge", "specs*", message=str, no_ff=bool, ff_only=bool, favour=str, no_commit=bool)
    command("rebase", "upstream", onto=str, squash=str)
    command("cherry-pick", "spec")
    command("revert", "spec")
    command("reset", "spec?", mode=str)
    command("merge-base", "a", "b")
    command("rev-parse", "spec")
    command("blame", "layer")
    command("config", "key?", "value?")
    command("clone", "url", depth=int)
    for name in ("fetch", "pull", "push"):
        command(name, "remote")
    command("import", "layer", "path", format=str, fid=str, where=str, overwrite=bool, message=str)
    command("export", "spec", "path", format=str, where=str)
    return out


def run(spark: SparkSession, argv: list[str]):
    """What the command gives: rows, a value or nothing."""
    a = parser().parse_args(argv)
    if a.command == "clone":
        return Repo.clone(spark, a.url, a.repository, a.depth).head()
    r = Repo(spark, a.repository)
    some = lambda *names: {n: getattr(a, n) for n in names if getattr(a, n) not in (None, False)}
    return {
        "init": lambda: r.branch(), "status": r.status, "branches": r.branches, "tags": r.tags, "conflicts": r.conflicts, "show-ref": r.refs, "index-list": r.indexes, "remotes": r.remotes, "statistics": r.statistics,
        "add": lambda: r.add(*a.paths, update_only=a.update_only), "commit": lambda: r.commit(a.message or "", a.author, a.amend, a.allow_empty), "log": lambda: r.log(a.until or "HEAD", **some("since", "author", "skip", "limit", "first_parent", "topo")),
        "diff": lambda: r.diff_count(a.old, a.new) if a.count or not a.layer else r.diff(a.old, a.new, a.layer), "ls": lambda: r.listing(a.revision or "HEAD"), "show": lambda: r.show(a.spec), "ql": lambda: r.ql(a.statement), "checkout": lambda: r.checkout(a.spec, force=a.force),
        "branch": lambda: r.delete_branch(a.name) if a.delete else r.create_branch(a.name, a.source or "HEAD", a.force), "tag": lambda: r.delete_tag(a.name) if a.delete else r.tag(a.name, a.spec or "HEAD"), "merge": lambda: r.merge(*a.specs, **some("message", "no_ff", "ff_only", "favour", "no_commit")),
        "rebase": lambda: r.rebase(a.upstream, a.onto, a.squash), "cherry-pick": lambda: r.cherry_pick(a.spec), "revert": lambda: r.revert(a.spec), "reset": lambda: r.reset(a.spec or "HEAD", a.mode or "mixed"), "merge-base": lambda: r.merge_base(a.a, a.b), "rev-parse": lambda: r.resolve(a.spec), "blame": lambda: r.blame(a.layer),
        "config": lambda: r.config(a.key, a.value), "fetch": lambda: r.fetch(a.remote), "pull": lambda: r.pull(a.remote), "push": lambda: r.push(a.remote),
        "import": lambda: r.import_layer(a.layer, spark.read.format(a.format or "parquet").load(a.path), a.fid, a.where, a.overwrite, message=a.message), "export": lambda: r.export(a.spec, a.path, a.format or "parquet", where=a.where),
    }[a.command]()


def main(argv: list[str]) -> None:
    out = run(SparkSession.builder.appName("palimpsest").getOrCreate(), argv)
    if isinstance(out, DataFrame):
        print("\t".join(out.columns))
        n = 0
        for n, row in enumerate(out.toLocalIterator(), 1):
            print("\t".join("" if v is None else str(v) for v in row))
        print(f"total: {n}")
    elif out is not None:
        print(out if isinstance(out, str) else json.dumps(out, default=str))


if __name__ == "__main__":
    main(sys.argv[1:])
