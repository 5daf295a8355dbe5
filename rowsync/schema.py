"""Types of the databases and of Spark, schema compatibility, the schema document."""

from __future__ import annotations

import json
import re

from pyspark.sql import types as T

from .model import Column, RowsyncError, Table

# The databases' names of the base types.
SQLITE_TYPES = {
    "integer": ("int", "integer", "smallint", "mediumint", "bigint", "tinyint"),
    "double": ("double", "real", "double precision", "float"),
    "boolean": ("bool", "boolean"),
    "blob": ("blob",),
    "datetime": ("datetime",),
    "date": ("date",),
}
POSTGRES_TYPES = {
    "integer": ("integer", "smallint", "bigint"),
    "double": ("double precision", "real", "numeric", "decimal"),
    "boolean": ("boolean",),
    "blob": ("bytea",),
    "datetime": ("timestamp without time zone",),
    "date": ("date",),
}
GEOMETRY_TYPES = ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION", "GEOMETRY")
WRITTEN = {
    "sqlite": {"integer": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "text": "TEXT", "blob": "BLOB", "datetime": "DATETIME", "date": "DATE"},
    "postgres": {"integer": "integer", "double": "double precision", "boolean": "boolean", "text": "text", "blob": "bytea", "datetime": "timestamp", "date": "date"},
}
SPARK_TYPES = {"integer": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "text": T.StringType(), "blob": T.BinaryType(), "geometry": T.BinaryType(), "datetime": T.TimestampNTZType(), "date": T.DateType()}


def base_type(db_type: str, driver: str) -> str:
    """The base type of a database's type name; text for what isn't known."""
    name = re.sub(r"\s*\(.*\)\s*$", "", db_type).strip().lower()
    if driver == "postgres" and db_type.lower().startswith("geometry") or driver == "sqlite" and name.upper() in GEOMETRY_TYPES:
        return "geometry"
    known = SQLITE_TYPES if driver == "sqlite" else POSTGRES_TYPES
    return next((base for base, names in known.items() if name in names), "text")


def written_type(column: Column, driver: str) -> str:
    """The type name to create a column with."""
    if column.type == "geometry":
        g = column.geometry
        if driver == "sqlite":
            return g.type if g else "GEOMETRY"
        return f"geometry({g.type}{'Z' * g.has_z}{'M' * g.has_m}, {g.srs_id})" if g else "geometry"
    if driver == "postgres" and column.type == "integer" and column.auto_increment:
        return "serial"
    return WRITTEN[driver][column.type]


def geometry_details(name: str, dimension: int) -> tuple[str, bool, bool]:
    """(flat name, has z, has m) of a geometry type name and its number of coordinates."""
    flat = name.upper()
    has_m = flat.endswith("M")
    flat = re.sub(r"(ZM|Z|M)$", "", flat)
    if flat not in GEOMETRY_TYPES:
        raise RowsyncError(f"geometry type {name} is not supported")
    return flat, dimension == 4 or (dimension == 3 and not has_m), dimension == 4 or (dimension == 3 and has_m)


def table_of(name: str, schema: T.StructType, keys: list[str]) -> Table:
    """The description of a DataFrame's table."""
    kinds = {T.ByteType: "integer", T.ShortType: "integer", T.IntegerType: "integer", T.LongType: "integer", T.FloatType: "double", T.DoubleType: "double", T.DecimalType: "double", T.BooleanType: "boolean", T.BinaryType: "blob", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.DateType: "date"}
    return Table(name, tuple(Column(f.name, kinds.get(type(f.dataType), "text"), f.dataType.simpleString(), f.name in keys, f.name in keys or not f.nullable) for f in schema.fields))


def struct_of(table: Table) -> T.StructType:
    return T.StructType([T.StructField(c.name, SPARK_TYPES[c.type], not c.not_null) for c in table.columns])


def check_tables(base: list[str], modified: list[str]) -> None:
    if sorted(base) != sorted(modified):
        raise RowsyncError(f"the tables differ: {', '.join(sorted(base))} and {', '.join(sorted(modified))}")


def check_compatible(base: Table, modified: Table) -> None:
    if not base.compatible(modified):
        raise RowsyncError(f"the schemas of table {base.name} differ")


def schema_document(tables: list[Table], root: str = "rowsync_schema") -> str:
    """All tables as JSON text under the key ``root``."""
    out = []
    for t in tables:
        columns = []
        for c in t.columns:
            x: dict = {"name": c.name, "type": c.type, "type_db": c.type_db}
            x |= {k: True for k in ("primary_key", "not_null", "auto_increment") if getattr(c, k)}
            if c.geometry:
                x["geometry"] = {"type": c.geometry.type, "srs_id": str(c.geometry.srs_id)} | {k: True for k in ("has_z", "has_m") if getattr(c.geometry, k)}
            columns.append(x)
        entry: dict = {"table": t.name, "columns": columns}
        if t.crs:
            entry["crs"] = {"srs_id": t.crs.srs_id, "auth_name": t.crs.auth_name, "auth_code": t.crs.auth_code, "wkt": t.crs.wkt}
        out.append(entry)
    return json.dumps({root: out}, indent=2)
