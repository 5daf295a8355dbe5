"""What all parts share: operations, table descriptions, errors.

A *change frame* holds the changes of one table, a row each: its key columns, ``op`` ("insert", "update" or "delete"),
and for every other column c ``old_c``, ``new_c`` and ``changed_c``. ``changed_c`` is what tells an unchanged cell from
a cell set to null; an update's unchanged cells are null in both. An insert has no old values, a delete no new ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Operation codes of the binary format.
OP_CODES = {"insert": 18, "update": 23, "delete": 9}
OP_NAMES = {v: k for k, v in OP_CODES.items()}
OP_RANK = {"insert": 0, "delete": 1, "update": 2}


class RowsyncError(Exception):
    """Anything that can't be done."""


class ConflictError(RowsyncError):
    """Changes that don't fit the data; nothing was written."""


class UnsupportedError(RowsyncError):
    """Tables or changes of a kind that an operation doesn't take."""


@dataclass(frozen=True)
class Geometry:
    type: str
    srs_id: int
    has_z: bool = False
    has_m: bool = False


@dataclass(frozen=True)
class Crs:
    srs_id: int
    auth_name: str
    auth_code: int
    wkt: str = field(default="", compare=False)


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    type_db: str = field(default="", compare=False)
    primary_key: bool = False
    not_null: bool = False
    auto_increment: bool = False
    geometry: Geometry | None = None


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    crs: Crs | None = None

    @property
    def keys(self) -> list[str]:
        return [c.name for c in self.columns if c.primary_key]

    @property
    def others(self) -> list[str]:
        return [c.name for c in self.columns if not c.primary_key]

    def compatible(self, other: Table) -> bool:
        """Same names, base types, keys, nullability and geometry, whatever the databases call the types."""
        return self.name == other.name and self.columns == other.columns and (self.crs is None) == (other.crs is None) and (self.crs is None or self.crs.srs_id == other.crs.srs_id)


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class TableFilter:
    """Which tables take part: all but ``skip``, or only ``include``; not both."""

    skip: frozenset[str] = frozenset()
    include: frozenset[str] = frozenset()

    def __post_init__(self):
        if self.skip and self.include:
            raise RowsyncError("tables to skip and tables to include can't be given together")

    # Names of bookkeeping tables.
    SYSTEM_PREFIXES = ("gpkg_", "rtree_")
    SYSTEM_TABLES = ("sqlite_sequence",)

    def takes(self, name: str) -> bool:
        if name.startswith(self.SYSTEM_PREFIXES) or name in self.SYSTEM_TABLES:
            return False
        return name in self.include if self.include else name not in self.skip
