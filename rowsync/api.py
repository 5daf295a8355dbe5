"""The engine: what can be done with datasets of several tables."""

from __future__ import annotations

import base64
import json
import logging
import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .model import ConflictError, RowsyncError, TableFilter, UnsupportedError
from .operators import apply as ap
from .operators import changes as ch
from .operators import diff as df_
from .operators import rebase as rb
from .plans.storage import stored
from .schema import check_compatible, check_tables, schema_document
from .sources import is_source, open_dataset, sources
from .sources.changeset import from_log, read_changesets, to_log, write_changeset

log = logging.getLogger("rowsync")
Changes = dict[str, DataFrame]
#: Entries of a table that are written to the log at most when they don't fit; ``apply_conflicts`` has them all.
WARNED = 1000
LEVELS = ("nothing", "error", "warning", "info", "debug")


class Engine:
    """Operations on datasets (``sources.open_dataset``). Changes are a change frame for each table.

    ``logger(level, message)`` gets messages up to ``level`` (LEVELS); Python's logging does if there is none.
    """

    version = __version__

    def __init__(self, spark: SparkSession, skip: list[str] | tuple = (), include: list[str] | tuple = (), logger: Callable[[str, str], None] | None = None, level: str = "info"):
        self.spark, self.filter = spark, TableFilter(frozenset(skip), frozenset(include))
        self.logger, self.level = logger, level

    def say(self, level: str, message: str) -> None:
        if LEVELS.index(level) > LEVELS.index(self.level):
            return
        if self.logger:
            self.logger(level, message)
        else:
            log.log(getattr(logging, level.upper()), message)

    def _warn(self, what: str, table: str, changed: DataFrame, columns: list[str], keys: list[str]) -> None:
        """A conflict and the entries that it is about; a message for each, so at most WARNED of them."""
        for r in ch.to_json(changed.limit(WARNED), table, columns, keys).collect():
            self.say("warning", f"conflict: {what}: {r['json']}")

    sources = staticmethod(lambda: list(sources()))
    is_source = staticmethod(is_source)

    def open(self, name: str, where: str, **options):
        return open_dataset(self.spark, name, where, tables=self.filter, **options)

    def _keyed(self, ds) -> list:
        out = []
        for t in map(ds.table, ds.list_tables()):
            if t.keys:
                out.append(t)
            else:
                self.say("info", f"table {t.name} has no primary key and is passed over")
        return out

    @staticmethod
    def _datetimes(table) -> list[str]:
        return [c.name for c in table.columns if c.type == "datetime" and not c.primary_key]

    def diff(self, base, modified) -> Changes:
        check_tables(base.list_tables(), modified.list_tables())
        out = {}
        for t in self._keyed(base):
            check_compatible(t, modified.table(t.name))
            out[t.name] = df_.diff(base.scan(t.name), modified.scan(t.name).select(*[c.name for c in t.columns]), t.keys, self._datetimes(t))
        return out

    def dump(self, ds) -> Changes:
        return {t.name: df_.dump(ds.scan(t.name), t.keys) for t in self._keyed(ds)}

    def invert(self, changes: Changes) -> Changes:
        return {n: ch.invert(c) for n, c in changes.items()}

    def concat(self, parts: list[Changes], keys: dict[str, list[str]]) -> Changes:
        if len(parts) < 2:
            raise UnsupportedError("at least two change sets are needed")
        names = sorted({n for p in parts for n in p})
        return {n: ch.concat(own, keys[n]) if len(own := [p[n] for p in parts if n in p]) > 1 else own[0] for n in names}

    def has_changes(self, changes: Changes) -> bool:
        return any(map(ch.has_changes, changes.values()))

    def count(self, changes: Changes) -> int:
        return sum(c.count() for c in changes.values())

    def summary(self, changes: Changes) -> list[dict]:
        return [r.asDict() for r in ch.summary(changes).orderBy("table").collect()] if changes else []

    def rebase_changes(self, ours: Changes, theirs: Changes, keys: dict[str, list[str]]) -> tuple[Changes, dict[str, DataFrame]]:
        """(our changes after theirs, conflicts by table); tables that they didn't touch pass unchanged."""
        out, conflicts = {}, {}
        for n, mine in ours.items():
            if n not in theirs or not ch.has_changes(theirs[n]):
                out[n] = mine
                continue
            r = rb.rebase(stored(mine, "ours"), stored(theirs[n], "theirs"), keys[n])
            out[n] = r.changes.drop("seq")
            conflicts[n] = r.conflicts
        return out, conflicts

    def apply(self, ds, changes: Changes, foreign_keys: list | None = None, unique: dict[str, list[list[str]]] | None = None) -> list[str]:
        """Write all changes or none; the names of the tables that they reached.

        A database takes the changed rows and checks its own constraints. Elsewhere fit, keys, null, unique and foreign key
        constraints (``foreign_keys``; the dataset's own where it knows any) are checked on the result first.
        """
        changes = {n: c for n, c in changes.items() if self.filter.takes(n)}
        for n in changes:
            if n not in ds.list_tables():
                raise RowsyncError(f"there is no table {n}")
        if not changes:
            return []
        if hasattr(ds, "apply_changes"):
            ds.apply_changes(changes, self._warn_row)
            return sorted(changes)
        after, tables = {}, {n: ds.table(n) for n in changes}
        for n, c in changes.items():
            t = tables[n]
            names = [x.name for x in t.columns]
            after[n] = ap.apply(ds.scan(n), c, t.keys, self._datetimes(t), lambda bad, n=n, names=names, t=t: self._warn("entries don't fit", n, bad, names, t.keys))
        state = lambda n: after.get(n) if n in after else ds.scan(n)
        for n, d in after.items():
            t = tables[n]
            for cols in [t.keys, *(unique or {}).get(n, [])]:
                if not ap.unique_violations(d, cols).isEmpty():
                    raise ConflictError(f"values of {', '.join(cols)} in {n} are not unique")
            if not ap.null_violations(d, [c.name for c in t.columns if c.not_null]).isEmpty():
                raise ConflictError(f"a column of {n} that must not be null is null")
        for f in (ds.foreign_keys() if hasattr(ds, "foreign_keys") else ()) if foreign_keys is None else foreign_keys:
            if (f.table in after or f.parent in after) and not ap.foreign_key_violations(state(f.table), [f.column], state(f.parent), [f.parent_column]).isEmpty():
                raise ConflictError(f"{f.table}.{f.column} refers to rows that {f.parent} lacks")
        ds.write(after)
        return sorted(changes)

    def _warn_row(self, what: str, table, row) -> None:
        """One change that a database refused, as JSON."""
        if LEVELS.index(self.level) >= LEVELS.index("warning"):
            cells = [{"column": k} | _sides(row, c) for k, c in enumerate(table.columns) if c.primary_key or row[f"changed_{c.name}"]]
            self.say("warning", f"conflict: {what}: " + json.dumps({"table": table.name, "type": row["op"], "changes": cells}, default=_as_json))

    def rebase(self, base, ours, theirs, **checks) -> dict[str, DataFrame]:
        """Bring their changes into ``ours``; conflicts by table. Tables that they didn't change are left alone."""
        check_tables(base.list_tables(), ours.list_tables())
        b_t = {n: stored(c, "theirs") for n, c in self.diff(base, theirs).items()}
        b_t = {n: c for n, c in b_t.items() if ch.has_changes(c)}
        merged, conflicts = {}, {}
        for n, theirs_of in b_t.items():
            t = base.table(n)
            check_compatible(t, ours.table(n))
            b_o = stored(df_.diff(base.scan(n), ours.scan(n).select(*[c.name for c in t.columns]), t.keys, self._datetimes(t)), "ours")
            if ch.has_changes(b_o):
                merged[n], conflicts[n] = rb.merge(b_o, theirs_of, t.keys, self._datetimes(t))
            else:
                merged[n] = theirs_of
        if merged:
            conflicts = {n: stored(c, "conflicts") for n, c in conflicts.items()}
            self.apply(ours, {n: stored(c, "merged") for n, c in merged.items()}, **checks)
        return {n: c for n, c in conflicts.items() if not c.isEmpty()}

    def copy(self, source, target) -> None:
        """All tables of ``source``, with their schemas, into the empty ``target``."""
        tables = [source.table(n) for n in source.list_tables()]
        if hasattr(target, "create_tables"):
            target.create_tables(tables)
        target.write({t.name: source.scan(t.name) for t in tables}, {t.name: t.keys for t in tables})

    def schema(self, ds) -> str:
        return schema_document([ds.table(n) for n in ds.list_tables()])

    def to_json(self, changes: Changes, tables: dict) -> str:
        entries = []
        for n in sorted(changes):
            t = tables[n]
            entries += [json.loads(r["json"]) for r in ch.to_json(changes[n], n, [c.name for c in t.columns], t.keys).select("json").toLocalIterator()]
        return json.dumps({"rowsync": entries}, indent=2)

    def write_json(self, changes: Changes, tables: dict, path: str) -> None:
        """Every entry as a line of JSON, written by the executors to a folder; for more changes than one machine holds."""
        each = [ch.to_json(c, n, [x.name for x in tables[n].columns], tables[n].keys).select(F.col("json").alias("value")) for n, c in sorted(changes.items())]
        reduce(DataFrame.unionByName, each).write.text(path)

    def conflicts_json(self, conflicts: dict[str, DataFrame], tables: dict) -> str:
        out = []
        for n in sorted(conflicts):
            t, rows = tables[n], {}
            place = {c.name: k for k, c in enumerate(t.columns)}
            for r in conflicts[n].toLocalIterator():
                rows.setdefault(str(r[t.keys[0]]), []).append({"column": place[r["column"]], "base": r["base"], "old": r["theirs"], "new": r["ours"]})
            out += [{"table": n, "type": "conflict", "fid": k, "changes": v} for k, v in rows.items()]
        return json.dumps({"rowsync": out}, indent=2)

    def save(self, changes: Changes, tables: dict, path: str) -> int:
        """Write a changeset file; an empty one if there are no changes."""
        logs = [to_log(c, n, [x.name for x in tables[n].columns], tables[n].keys) for n, c in sorted(changes.items())]
        if not logs:
            open(path, "wb").close()
            return 0
        out = logs[0]
        for x in logs[1:]:
            out = out.unionByName(x)
        return write_changeset(out, path)

    def load(self, path: str, tables: dict) -> Changes:
        if os.path.exists(path) and not os.path.getsize(path):
            return {}
        entries = read_changesets(self.spark, path)
        shapes = {r["table"]: list(r["pk_flags"]) for r in entries.select("table", "pk_flags").distinct().collect() if self.filter.takes(r["table"])}
        for n, flags in shapes.items():
            if n not in tables:
                raise RowsyncError(f"there is no table {n}")
            if len(flags) != len(tables[n].columns):
                raise RowsyncError(f"{path} has another number of columns for table {n}")
            if flags != [c.primary_key for c in tables[n].columns]:
                raise RowsyncError(f"{path} has another primary key for table {n}")
        return {n: from_log(entries, tables[n]) for n in sorted(shapes)}

    def entries(self, path: str) -> DataFrame:
        return read_changesets(self.spark, path).where(F.col("table").isNotNull())


def _sides(row, c) -> dict:
    old, new = (row[c.name],) * 2 if c.primary_key else (row[f"old_{c.name}"], row[f"new_{c.name}"])
    has_old, has_new = row["op"] != "insert", row["op"] == "insert" if c.primary_key else row["op"] != "delete"
    return ({"old": old} if has_old else {}) | ({"new": new} if has_new else {})


def _as_json(v) -> str:
    return base64.b64encode(bytes(v)).decode() if isinstance(v, (bytes, bytearray)) else str(v)
