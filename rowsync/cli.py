"""Command line: python -m rowsync.cli COMMAND ...; tables in lists are separated by semicolons."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import __version__
from .api import Engine
from .model import RowsyncError
from .sources import sources


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rowsync", description="Compare, patch and merge keyed tables.")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument("--driver", default="sqlite", help="kind of the datasets")
        c.add_argument("--skip-tables", default="")
        c.add_argument("--include-tables", default="")
        for a in args:
            c.add_argument(a.rstrip("?"), nargs="?" if a.endswith("?") else None)
        return c

    c = command("diff", "base", "modified", "out?", text="changes between two datasets")
    c.add_argument("--json", action="store_true")
    c.add_argument("--summary", action="store_true")
    command("apply", "data", "changeset", text="apply a changeset")
    command("rebase-diff", "base", "ours", "theirs_changeset", "out", "conflicts?", text="our changes, rewritten to follow theirs")
    command("rebase-db", "base", "ours", "theirs", "conflicts?", text="bring their changes into ours")
    command("invert", "data", "changeset", "out", text="the changeset that undoes another")
    command("concat", "data", "first", "second", "out", text="one changeset for two")
    command("as-json", "data", "changeset", "out?", text="a changeset as JSON")
    command("as-summary", "data", "changeset", text="numbers of changes by table")
    c = command("copy", "source", "target", text="copy a dataset")
    c.add_argument("--target-driver", default="")
    command("schema", "data", "out?", text="the tables' schemas as JSON")
    command("dump", "data", "out", text="all rows as inserts")
    sub.add_parser("drivers", help="kinds of datasets")
    sub.add_parser("version", help="this program's version")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "drivers":
        print("\n".join(sources()))
        return 0
    if a.command == "version":
        print(__version__)
        return 0
    try:
        return _run(a)
    except RowsyncError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1


def _out(text: str, path: str | None) -> None:
    if path:
        with open(path, "w") as f:
            f.write(text)
    else:
        print(text)


def _run(a: argparse.Namespace) -> int:
    names = lambda s: [x for x in s.split(";") if x]
    spark = SparkSession.builder.getOrCreate()
    e = Engine(spark, names(a.skip_tables), names(a.include_tables))
    data = e.open(a.driver, next(getattr(a, x) for x in ("base", "data", "source") if hasattr(a, x)))
    tables = {n: data.table(n) for n in data.list_tables()}
    keys = {n: t.keys for n, t in tables.items()}
    if a.command == "diff":
        changes = e.diff(data, e.open(a.driver, a.modified))
        if a.json:
            _out(e.to_json(changes, tables), a.out)
        elif a.summary:
            _out(str(e.summary(changes)), a.out)
        elif a.out:
            e.save(changes, tables, a.out)
        else:
            print(e.count(changes))
    elif a.command == "apply":
        e.apply(data, {n: c.drop("seq") for n, c in e.load(a.changeset, tables).items()})
    elif a.command == "rebase-diff":
        out, conflicts = e.rebase_changes(e.diff(data, e.open(a.driver, a.ours)), e.load(a.theirs_changeset, tables), keys)
        e.save(out, tables, a.out)
        conflicts = {n: c for n, c in conflicts.items() if not c.isEmpty()}
        if a.conflicts and conflicts:
            _out(e.conflicts_json(conflicts, tables), a.conflicts)
    elif a.command == "rebase-db":
        conflicts = e.rebase(data, e.open(a.driver, a.ours), e.open(a.driver, a.theirs))
        if a.conflicts and conflicts:
            _out(e.conflicts_json(conflicts, tables), a.conflicts)
    elif a.command == "invert":
        e.save(e.invert({n: c.drop("seq") for n, c in e.load(a.changeset, tables).items()}), tables, a.out)
    elif a.command == "concat":
        e.save(e.concat([e.load(a.first, tables), e.load(a.second, tables)], keys), tables, a.out)
    elif a.command == "as-json":
        _out(e.to_json(e.load(a.changeset, tables), tables), a.out)
    elif a.command == "as-summary":
        print(e.summary(e.load(a.changeset, tables)))
    elif a.command == "copy":
        kind = a.target_driver or a.driver
        e.copy(data, e.open(kind, a.target, **({"create": True} if kind in ("sqlite", "postgres") else {})))
    elif a.command == "schema":
        _out(e.schema(data), a.out)
    elif a.command == "dump":
        e.save(e.dump(data), tables, a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
