"""Tables of a PostgreSQL schema by JDBC; the driver's jar must be on the class path."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import gpkg
from ..model import Column, ConflictError, Crs, ForeignKey, Geometry, RowsyncError, Table, TableFilter
from ..schema import base_type, geometry_details, struct_of, written_type
from .rowwise import Clash, entries, quoted, statement, write_rows

#: How a timestamp is read, and how the interchange format has it.
ISO_MICROS = """'YYYY-MM-DD"T"HH24:MI:SS.US"Z"'"""


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class JdbcDataset:
    """``where`` is the JDBC url. ``partition``: for large tables, {table: (column, lower, upper, n)}.

    Geometries are GeoPackage blobs on this side and the database's own on the other; timestamps are ISO text with
    microseconds. ``create``: make the schema, ``overwrite`` drops what it held.
    """

    def __init__(self, spark: SparkSession, where: str, schema: str = "public", tables: TableFilter = TableFilter(), partition: dict | None = None, fetch_size: int = 10_000, create: bool = False, overwrite: bool = False, **options: str):
        self.spark, self.url, self.schema, self.filter, self.partition = spark, where, schema, tables, partition or {}
        self.options = {"driver": "org.postgresql.Driver", "fetchsize": str(fetch_size)} | options
        if create:
            self.execute(self.schema_sql(overwrite))

    def query(self, sql: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, query=sql, **self.options).load()

    @contextmanager
    def _connection(self) -> Iterator:
        """A JDBC connection of the driver's with one transaction; rolled back unless the body ends."""
        jvm = self.spark.sparkContext._jvm
        jvm.java.lang.Class.forName(self.options["driver"])
        p = jvm.java.util.Properties()
        for k in ("user", "password"):
            if k in self.options:
                p.setProperty(k, self.options[k])
        db = jvm.java.sql.DriverManager.getConnection(self.url, p)
        try:
            db.setAutoCommit(False)
            yield db
            db.commit()
        except BaseException:
            db.rollback()
            raise
        finally:
            db.close()

    def execute(self, statements: list[str]) -> None:
        with self._connection() as db:
            for sql in statements:
                db.createStatement().execute(sql)

    def target(self, name: str) -> str:
        return f"{quoted(self.schema)}.{quoted(name)}"

    # --- SQL, as text so that it can be looked at without a database

    def schema_sql(self, overwrite: bool = False) -> list[str]:
        return [f"DROP SCHEMA IF EXISTS {quoted(self.schema)} CASCADE"] * overwrite + [f"CREATE SCHEMA IF NOT EXISTS {quoted(self.schema)}"]

    def tables_sql(self) -> str:
        return f"SELECT tablename FROM pg_catalog.pg_tables WHERE schemaname = {literal(self.schema)}"

    def columns_sql(self, name: str) -> str:
        """Column names, types, key and null flags and sequences, in order; the key comes from the primary index alone."""
        return (
            "SELECT a.attname AS name, format_type(a.atttypid, a.atttypmod) AS kind, a.attnotnull AS not_null, coalesce(a.attnum = ANY(i.indkey), false) AS pk, "
            f"pg_get_serial_sequence({literal(self.target(name))}, a.attname) IS NOT NULL AS serial FROM pg_attribute a "
            "LEFT JOIN pg_index i ON i.indrelid = a.attrelid AND i.indisprimary "
            f"WHERE a.attrelid = {literal(self.target(name))}::regclass AND a.attnum > 0 AND NOT a.attisdropped ORDER BY a.attnum"
        )

    def geometry_sql(self, name: str) -> str:
        """Geometry columns with their type, number of coordinates and reference system."""
        return (
            "SELECT g.f_geometry_column AS name, g.type, g.coord_dimension AS dimension, g.srid, r.auth_name, r.auth_srid, r.srtext FROM geometry_columns g "
            f"LEFT JOIN spatial_ref_sys r ON r.srid = g.srid WHERE g.f_table_schema = {literal(self.schema)} AND g.f_table_name = {literal(name)}"
        )

    def foreign_keys_sql(self) -> str:
        return (
            "SELECT c.conrelid::regclass::text AS child, a.attname AS col, p.relname AS parent, b.attname AS parent_col, k.relname AS child_name FROM pg_constraint c "
            "JOIN pg_class k ON k.oid = c.conrelid JOIN pg_class p ON p.oid = c.confrelid JOIN pg_namespace n ON n.oid = k.relnamespace "
            "CROSS JOIN LATERAL unnest(c.conkey, c.confkey) AS u(x, y) JOIN pg_attribute a ON a.attrelid = c.conrelid AND a.attnum = u.x "
            f"JOIN pg_attribute b ON b.attrelid = c.confrelid AND b.attnum = u.y WHERE c.contype = 'f' AND n.nspname = {literal(self.schema)}"
        )

    def select_sql(self, t: Table) -> str:
        """All columns; geometries as well-known binary, timestamps as ISO text."""

        def of(c: Column) -> str:
            q = quoted(c.name)
            if c.type == "geometry":
                return f"ST_AsBinary({q}) AS {q}"
            return f"to_char({q}, {ISO_MICROS}) AS {q}" if c.type == "datetime" else q

        return f"SELECT {', '.join(map(of, t.columns))} FROM {self.target(t.name)}"

    def create_sql(self, t: Table) -> str:
        if not t.keys:
            raise RowsyncError(f"table {t.name} has no primary key")
        cols = [f"{quoted(c.name)} {written_type(c, 'postgres')}{' NOT NULL' if c.not_null else ''}" for c in t.columns]
        return f"CREATE TABLE {self.target(t.name)} ({', '.join(cols)}, PRIMARY KEY ({', '.join(map(quoted, t.keys))}))"

    def sequence_sql(self, t: Table) -> list[str]:
        """Statements that raise the sequences of a table's keys to the greatest key; they never go down."""
        out = []
        for c in t.columns:
            if c.primary_key and c.auto_increment:
                seq = f"pg_get_serial_sequence({literal(self.target(t.name))}, {literal(c.name)})"
                out.append(
                    f"SELECT setval({seq}, m.top) FROM (SELECT max({quoted(c.name)}) AS top FROM {self.target(t.name)}) m "
                    f"WHERE m.top > coalesce((SELECT s.last_value FROM pg_sequences s WHERE format('%I.%I', s.schemaname, s.sequencename)::regclass = {seq}::regclass), 0)"
                )
        return out

    def marker(self, t: Table, column: str) -> str:
        """What stands for a value in a statement: a parameter, cast from its text."""
        c = next(x for x in t.columns if x.name == column)
        if c.type == "geometry":
            return f"ST_GeomFromWKB(decode(?, 'hex'), {c.geometry.srs_id if c.geometry else 0})"
        return "decode(?, 'hex')" if c.type == "blob" else f"CAST(? AS {c.type_db or written_type(c, 'postgres')})"

    @staticmethod
    def value(c: Column, v) -> str | None:
        """A value as the text that its parameter takes."""
        if v is None:
            return None
        if c.type == "geometry":
            return bytes(v)[gpkg.size_of_header(bytes(v)) :].hex()
        if c.type == "blob":
            return bytes(v).hex()
        return str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, float) else str(v)

    # --- reading

    def list_tables(self) -> list[str]:
        return sorted(r[0] for r in self.query(self.tables_sql()).collect() if self.filter.takes(r[0]))

    def foreign_keys(self) -> list[ForeignKey]:
        return [ForeignKey(r["child_name"], r["col"], r["parent"], r["parent_col"]) for r in self.query(self.foreign_keys_sql()).collect()]

    def table(self, name: str) -> Table:
        rows = self.query(self.columns_sql(name)).collect()
        if not rows:
            raise RowsyncError(f"there is no table {name} in schema {self.schema}")
        shapes, crs = {}, None
        if any(base_type(r["kind"], "postgres") == "geometry" for r in rows):
            for g in self.query(self.geometry_sql(name)).collect():
                shapes[g["name"]] = Geometry(*_shape(g["type"], g["srid"], g["dimension"]))
                crs = crs or (Crs(g["srid"], g["auth_name"], g["auth_srid"], g["srtext"]) if g["auth_name"] else None)
        return Table(name, tuple(Column(r["name"], base_type(r["kind"], "postgres"), r["kind"], r["pk"], r["not_null"], r["serial"], shapes.get(r["name"])) for r in rows), crs)

    def scan(self, name: str) -> DataFrame:
        t = self.table(name)
        reader = self.spark.read.format("jdbc").options(url=self.url, dbtable=f"({self.select_sql(t)}) AS t", **self.options)
        if name in self.partition:
            column, low, high, n = self.partition[name]
            reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=n)
        return self.decoded(reader.load(), t)

    def decoded(self, df: DataFrame, t: Table) -> DataFrame:
        """What ``select_sql`` gave, as this engine has it: numbers by base type, geometries with a header, times as text."""
        kinds = {f.name: f.dataType for f in struct_of(t).fields}

        def of(c: Column):
            if c.type == "geometry":
                return gpkg.from_wkb(F.col(c.name), c.geometry.srs_id if c.geometry else 0).alias(c.name)
            return F.col(c.name).cast("string" if c.type in ("datetime", "date") else kinds[c.name]).alias(c.name)

        return df.select(*map(of, t.columns))

    # --- writing

    def create_tables(self, tables: list[Table]) -> None:
        self.execute([self.create_sql(t) for t in tables if not t.name.startswith("gpkg_")])

    def apply_changes(self, changes: dict[str, DataFrame], warn: Callable[[str, Table, Row], None] = lambda *_: None) -> None:
        """Write the changed rows in one transaction, foreign keys checked at its end, then raise the sequences."""
        from py4j.protocol import Py4JJavaError

        tables = {n: self.table(n) for n in changes}
        try:
            with self._connection() as db:
                db.createStatement().execute("SET CONSTRAINTS ALL DEFERRED")

                def run(t: Table, r: Row) -> int:
                    sql, values = statement(t, self.target(t.name), r, lambda c: self.marker(t, c), "IS NOT DISTINCT FROM")
                    p, point = db.prepareStatement(sql), db.setSavepoint()
                    for k, (c, v) in enumerate(zip(placed(t, r), values, strict=True), 1):
                        p.setString(k, self.value(c, v))
                    try:
                        return p.executeUpdate()
                    except Py4JJavaError as e:
                        if not _is_constraint(e):
                            raise
                        db.rollback(point)
                        raise Clash(str(e.java_exception.getMessage())) from e
                    finally:
                        p.close()

                write_rows(entries(changes, tables), run, warn)
                for t in tables.values():
                    for sql in self.sequence_sql(t):
                        db.createStatement().execute(sql)
        except Py4JJavaError as e:
            if _is_constraint(e):
                raise ConflictError(str(e.java_exception.getMessage())) from e
            raise

    def write(self, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None) -> None:
        """All rows of some tables, as inserts into what ``create_tables`` made."""
        from ..operators.diff import dump

        self.apply_changes({n: dump(df, (keys or {}).get(n) or self.table(n).keys) for n, df in tables.items()})


def _shape(kind: str, srid: int, dimension: int) -> tuple[str, int, bool, bool]:
    flat, z, m = geometry_details(kind, dimension)
    return flat, srid, z, m


def _is_constraint(e) -> bool:
    """Whether the database refused a row: SQL states of class 23."""
    state = getattr(e.java_exception, "getSQLState", lambda: None)()
    return bool(state) and state.startswith("23")


def placed(t: Table, r: Row) -> list[Column]:
    """The columns that the values of ``statement`` belong to, in order."""
    if r["op"] == "insert":
        return list(t.columns)
    old = [c for c in t.columns if c.primary_key or r[f"changed_{c.name}"]]
    return old if r["op"] == "delete" else [c for c in old if not c.primary_key] + old
