"""Where tables and changesets come from and go to, by name."""

from __future__ import annotations

from ..model import RowsyncError


def sources() -> dict[str, type]:
    from .jdbc import JdbcDataset
    from .parquet import ParquetDataset
    from .sqlite import SqliteDataset

    return {"parquet": ParquetDataset, "sqlite": SqliteDataset, "postgres": JdbcDataset}


def is_source(name: str) -> bool:
    return name in sources()


def open_dataset(spark, name: str, where: str, **options):
    """A dataset: ``list_tables``, ``table(name)`` (description), ``scan(name)``, and, where it can be written, ``write``."""
    if not is_source(name):
        raise RowsyncError(f"there is no source called {name}; there are {', '.join(sources())}")
    return sources()[name](spark, where, **options)
