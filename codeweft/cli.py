"""Command line: analyse a tree, then ask. Exit codes: 0 an answer, 1 no such thing, 2 bad use, 3 nothing analysed."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .operators.filters import QueryError
from .plans.engine import Options
from .plans.workspace import Workspace
from .sources import export, tree

VERBS = ("overview", "find", "refs", "symbol", "room", "file", "tree", "imports", "entries", "calls", "impact", "tests", "state", "orphans", "source", "stale")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeweft", description=__doc__)
    p.add_argument("--store", help="folder of the analysed tables; else the nearest .codeweft from here up")
    p.add_argument("--fresh", action="store_true", help="analyse again before the answer if files have changed")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb, what in (("init", "analyse a source tree into a new store in it"), ("analyze", "analyse a source tree into the store")):
        a = sub.add_parser(verb, help=what)
        a.add_argument("root", nargs="?", default=".")
        a.add_argument("--exclude", action="append", default=[])
    sub.add_parser("update", help="analyse the store's tree again if its files have changed")
    sub.add_parser("guide", help="say what each verb answers")
    for verb in VERBS:
        v = sub.add_parser(verb)
        v.add_argument("ref", nargs="*" if verb in ("tests", "tree", "imports", "stale") else "?" if verb in ("overview", "entries", "orphans") else 1)
        v.add_argument("--depth", type=int)
        v.add_argument("--limit", type=int)
        v.add_argument("--direction")
        v.add_argument("--mermaid", action="store_true")
        v.add_argument("--since", help="for tests: changes since this commit")
    return p


def answer(ws: Workspace, args: argparse.Namespace) -> object:
    ref = args.ref[0] if isinstance(args.ref, list) and args.ref else args.ref or None
    opt = {k: getattr(args, k) for k in ("depth", "limit", "direction") if getattr(args, k) is not None}
    if args.mermaid:
        return ws.diagram(args.verb, ref, **opt)
    if args.verb == "tests":
        return ws.tests_for(args.ref or tree.changed(".", args.since), **opt)
    if args.verb == "stale":
        return ws.stale(tree.manifest(tree.scan(ws.nodes.sparkSession, ref or ".")))
    run = {"calls": ws.calls_of}.get(args.verb) or getattr(ws, args.verb)
    return run(ref, **opt) if ref is not None else run(**opt)


GUIDE = """init or analyze first; update, or --fresh with any verb, follows later changes.
overview: counts, entries, hubs, cycles    find, refs: symbols by name, and every place where a name is written
symbol, room, source, file: one symbol, its neighbours, its text, one file    tree, imports: folders, and files' imports
entries, orphans, calls: where code starts, what nothing calls, what follows from a call
impact, tests, state: what a change reaches, the tests to run, the state in use    stale: files changed since the analysis
An answer that was cut says so: lists have *_more, closures truncated."""


def store_of(named: str | None, at: str = ".") -> str:
    """The store that is named, or the nearest one from ``at`` up, or a new one there."""
    here = os.path.abspath(at)
    while named is None and not os.path.isdir(os.path.join(here, ".codeweft")):
        if os.path.dirname(here) == here:
            return os.path.join(os.path.abspath(at), ".codeweft")
        here = os.path.dirname(here)
    return named or os.path.join(here, ".codeweft")


def refreshed(ws: Workspace, store: str, always: bool = False) -> tuple[Workspace, bool]:
    """The workspace of the store's tree as it is now, and whether it was analysed again."""
    spark, row = ws.nodes.sparkSession, ws.tables["settings"].first()
    if not always and not any(ws.stale(tree.manifest(tree.scan(spark, row["root"], exclude=row["exclude"]))).values()):
        return ws, False
    ws = Workspace.build(spark, row["root"], Options(exclude=row["exclude"]))
    ws.save(store)
    return ws, True


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("codeweft").getOrCreate()
    try:
        if args.verb == "guide":
            print(GUIDE)
            return 0
        store = os.path.join(args.root, ".codeweft") if args.verb == "init" and not args.store else store_of(args.store)
        if args.verb in ("init", "analyze"):
            print(Workspace.build(spark, args.root, Options(exclude=args.exclude)).save(store))
            return 0
        ws = Workspace.load(spark, store)
        if args.verb == "update":
            print("analysed again" if refreshed(ws, store)[1] else "nothing has changed")
            return 0
        got = answer(refreshed(ws, store)[0] if args.fresh else ws, args)
    except QueryError as error:
        print(error, file=sys.stderr)
        return 1
    except TypeError as error:
        print(error, file=sys.stderr)
        return 2
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or isinstance(error, FileNotFoundError) or "FileNotFound" in str(error):
            print(f"nothing analysed in {store}", file=sys.stderr)
            return 3
        raise
    print(got if isinstance(got, str) else export.compact(got))
    return 0


if __name__ == "__main__":
    sys.exit(main())
