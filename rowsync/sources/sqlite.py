"""SQLite and GeoPackage files, by Python's own library; a file is on one machine and is read there."""

from __future__ import annotations

import os
import re
import sqlite3
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from ..functions import gpkg
from ..model import Column, ConflictError, Crs, ForeignKey, Geometry, RowsyncError, Table, TableFilter
from ..plans import ship
from ..schema import base_type, struct_of, written_type
from .rowwise import Clash, entries, quoted, statement, write_rows

# A GeoPackage's application id, its bookkeeping tables and the reference systems that it always has.
APPLICATION_ID = 0x47504B47
METADATA = (
    "CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER NOT NULL PRIMARY KEY, organization TEXT NOT NULL, "
    "organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)",
    "CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', "
    "last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER, "
    "CONSTRAINT fk_gc_r_srs_id FOREIGN KEY (srs_id) REFERENCES gpkg_spatial_ref_sys(srs_id))",
    "CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, "
    "z TINYINT NOT NULL, m TINYINT NOT NULL, CONSTRAINT pk_geom_cols PRIMARY KEY (table_name, column_name))",
    "INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES ('Undefined Cartesian SRS', -1, 'NONE', -1, 'undefined', 'undefined Cartesian coordinate reference system')",
    "INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES ('Undefined geographic SRS', 0, 'NONE', 0, 'undefined', 'undefined geographic coordinate reference system')",
)
#: What a GeoPackage's own triggers call: a function of a geometry blob each.
SPATIAL_FUNCTIONS = {
    "ST_IsEmpty": lambda b: int(b is None),
    "ST_MinX": lambda b: b and b[0],
    "ST_MaxX": lambda b: b and b[1],
    "ST_MinY": lambda b: b and b[2],
    "ST_MaxY": lambda b: b and b[3],
}


def _plain(v):
    """A value as the library binds it."""
    if isinstance(v, bytearray):
        return bytes(v)
    if hasattr(v, "isoformat"):
        return str(v)
    return int(v) if isinstance(v, bool) else v


class SqliteDataset:
    def __init__(self, spark: SparkSession | None, where: str, tables: TableFilter = TableFilter(), create: bool = False, overwrite: bool = False):
        if not create and not os.path.exists(where):
            raise RowsyncError(f"there is no file {where}")
        if create and os.path.exists(where):
            if not overwrite:
                raise RowsyncError(f"there is already a file {where}")
            os.remove(where)
        self.spark, self.where, self.filter = spark, where, tables

    def connect(self) -> sqlite3.Connection:
        """A connection that enforces foreign keys and knows the functions that a GeoPackage's triggers call."""
        db = sqlite3.connect(self.where)
        for name, of in SPATIAL_FUNCTIONS.items():
            db.create_function(name, 1, lambda blob, of=of: None if blob is None else of(gpkg.bounds(bytes(blob))), deterministic=True)
        db.execute("PRAGMA foreign_keys = 1")
        return db

    def list_tables(self) -> list[str]:
        with self.connect() as db:
            names = [n for n, sql in db.execute("SELECT name, sql FROM sqlite_master WHERE type = 'table'") if not (sql or "").upper().startswith("CREATE VIRTUAL")]
        return sorted(n for n in names if self.filter.takes(n))

    def triggers(self) -> list[tuple[str, str]]:
        """(name, SQL) of the triggers that users made."""
        mine = re.compile(r"gpkg_|rtree_|trigger_(insert|delete)_feature_count_")
        with self.connect() as db:
            return [(n, s) for n, s in db.execute("SELECT name, sql FROM sqlite_master WHERE type = 'trigger' ORDER BY name") if not mine.match(n)]

    def foreign_keys(self) -> list[ForeignKey]:
        out = []
        with self.connect() as db:
            for t in self.list_tables():
                out += [ForeignKey(t, r[3], r[2], r[4]) for r in db.execute(f"PRAGMA foreign_key_list({quoted(t)})")]
        return out

    def table(self, name: str) -> Table:
        with self.connect() as db:
            info = db.execute(f"PRAGMA table_info({quoted(name)})").fetchall()
            if not info:
                raise RowsyncError(f"there is no table {name} in {self.where}")
            has = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE name IN ('gpkg_geometry_columns', 'gpkg_spatial_ref_sys')")}
            shapes, crs = {}, None
            if "gpkg_geometry_columns" in has:
                for column, kind, srs, z, m in db.execute("SELECT column_name, geometry_type_name, srs_id, z, m FROM gpkg_geometry_columns WHERE table_name = ?", (name,)):
                    shapes[column] = Geometry(kind, srs, bool(z), bool(m))
                    if "gpkg_spatial_ref_sys" in has and (r := db.execute("SELECT organization, organization_coordsys_id, definition FROM gpkg_spatial_ref_sys WHERE srs_id = ?", (srs,)).fetchone()):
                        crs = Crs(srs, *r)
        columns = []
        for _, column, kind, not_null, _, pk in info:
            base = "geometry" if column in shapes else base_type(kind, "sqlite")
            columns.append(Column(column, base, kind, bool(pk), bool(not_null), bool(pk) and base == "integer", shapes.get(column)))
        return Table(name, tuple(columns), crs)

    def scan(self, name: str, partitions: int = 1) -> DataFrame:
        """The table's rows, dates and times as text; in ranges of the row id if several partitions are asked for."""
        t, where = self.table(name), self.where
        text = {"datetime", "date"}
        schema = T.StructType([T.StructField(f.name, T.StringType() if c.type in text else f.dataType) for f, c in zip(struct_of(t).fields, t.columns, strict=True)])
        kinds = [c.type for c in t.columns]
        names = ", ".join(quoted(c.name) for c in t.columns)
        with self.connect() as db:
            low, high = db.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {quoted(name)}").fetchone() if partitions > 1 else (0, -1)
        width = max(1, -(-(high - low + 1) // partitions))
        ranges = [(low + k * width, low + (k + 1) * width) for k in range(partitions)] if partitions > 1 else [None]

        def cast(v, kind: str):
            if v is None:
                return None
            if kind == "boolean":
                return bool(v)
            if kind == "double":
                return float(v)
            return v if kind in ("integer", "blob", "geometry") else str(v)

        def rows(batches: Iterator) -> Iterator:
            import pandas as pd

            for pdf in batches:
                for a, b in zip(pdf["a"], pdf["b"], strict=True):
                    db = sqlite3.connect(where)
                    cur = db.execute(f"SELECT {names} FROM {quoted(name)}" + (f" WHERE rowid >= {a} AND rowid < {b}" if b > a else ""))
                    while got := cur.fetchmany(10_000):
                        cols = list(zip(*got, strict=True))
                        yield pd.DataFrame({c.name: pd.Series([cast(v, k) for v in x], dtype=object) for c, k, x in zip(t.columns, kinds, cols, strict=True)})
                    db.close()

        ship(self.spark)
        parts = self.spark.createDataFrame([r or (0, 0) for r in ranges], "a long, b long").repartition(len(ranges))
        return parts.mapInPandas(rows, schema)

    def create_metadata(self, db: sqlite3.Connection) -> None:
        """Make the file a GeoPackage, if it isn't one."""
        db.execute(f"PRAGMA application_id = {APPLICATION_ID}")
        for sql in METADATA:
            db.execute(sql)

    def create_tables(self, tables: list[Table]) -> None:
        with self.connect() as db:
            self.create_metadata(db)
            for t in tables:
                cols = [f"{quoted(c.name)} {written_type(c, 'sqlite')}{' NOT NULL' if c.not_null else ''}" for c in t.columns]
                key = f", PRIMARY KEY ({', '.join(map(quoted, t.keys))})" if t.keys else ""
                for c in t.columns:
                    if not c.geometry:
                        continue
                    if t.crs:
                        db.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, ?, '')", (f"{t.crs.auth_name}:{t.crs.auth_code}", t.crs.srs_id, t.crs.auth_name, t.crs.auth_code, t.crs.wkt))
                    db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, 0, 0, 0, 0, ?)", (t.name, t.name, c.geometry.srs_id))
                    db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, ?, ?, ?, ?, ?)", (t.name, c.name, c.geometry.type, c.geometry.srs_id, int(c.geometry.has_z), int(c.geometry.has_m)))
                db.execute(f"CREATE TABLE {quoted(t.name)} ({', '.join(cols)}{key})")

    @contextmanager
    def _transaction(self) -> Iterator[sqlite3.Connection]:
        """All or nothing, without the users' triggers, which come back at the end; foreign keys are checked there."""
        triggers, db = self.triggers(), self.connect()
        db.isolation_level = None
        try:
            db.execute("BEGIN IMMEDIATE")
            db.execute("PRAGMA defer_foreign_keys = 1")
            for name, _ in triggers:
                db.execute(f"DROP TRIGGER {quoted(name)}")
            yield db
            for _, sql in triggers:
                db.execute(sql)
            db.execute("COMMIT")
        except sqlite3.IntegrityError as e:
            raise ConflictError(str(e)) from e
        finally:
            if db.in_transaction:
                db.execute("ROLLBACK")
            db.close()

    def apply_changes(self, changes: dict[str, DataFrame], warn: Callable[[str, Table, Row], None] = lambda *_: None) -> None:
        """Write the changed rows alone; rows stream through the driver, where the file is. ConflictError: nothing was written."""
        tables = {n: self.table(n) for n in changes}
        with self._transaction() as db:

            def run(t: Table, r: Row) -> int:
                sql, values = statement(t, quoted(t.name), r, lambda _: "?", "IS")
                try:
                    return db.execute(sql, [_plain(v) for v in values]).rowcount
                except sqlite3.IntegrityError as e:
                    raise Clash(str(e)) from e

            write_rows(entries(changes, tables), run, warn)

    def write(self, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None) -> None:
        """Replace all rows of existing tables, in one transaction."""
        with self._transaction() as db:
            for name, df in tables.items():
                db.execute(f"DELETE FROM {quoted(name)}")
                rows = (tuple(map(_plain, r)) for r in df.toLocalIterator())
                db.executemany(f"INSERT INTO {quoted(name)} ({', '.join(map(quoted, df.columns))}) VALUES ({', '.join('?' * len(df.columns))})", rows)

    def copy_to(self, where: str) -> None:
        """A consistent copy, also of a file in use; overwrites the destination."""
        if os.path.exists(where):
            os.remove(where)
        with sqlite3.connect(self.where) as db, sqlite3.connect(where) as to:
            db.backup(to)
