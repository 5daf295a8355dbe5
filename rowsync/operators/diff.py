"""Differences of two versions of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normal_datetime
from ..model import UnsupportedError

#: Names that a change frame needs for itself.
RESERVED = ("op", "seq")


def _columns(base: DataFrame, modified: DataFrame, keys: list[str]) -> list[str]:
    if not keys:
        raise UnsupportedError("a table without a primary key can't be compared")
    if base.columns != modified.columns:
        raise UnsupportedError(f"the columns differ: {base.columns} and {modified.columns}")
    _check_names(keys)
    return [c for c in base.columns if c not in keys]


def _check_names(keys: list[str]) -> None:
    if taken := [k for k in keys if k in RESERVED]:
        raise UnsupportedError(f"a key column can't be named {taken[0]}: a change frame has a column of that name")


def equal(kind: T.DataType, a: Column, b: Column, by_instant: bool) -> Column:
    """Null-safe equality of two cells; datetimes by instant, rounded to milliseconds."""
    if not by_instant:
        return a.eqNullSafe(b)
    return normal_datetime(a, kind).eqNullSafe(normal_datetime(b, kind))


def same(base: DataFrame, c: str, a: Column, b: Column, datetimes: list[str]) -> Column:
    """``equal`` for two cells of column ``c`` of ``base``."""
    return equal(base.schema[c].dataType, a, b, c in datetimes)


def any_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols, F.lit(False))


def diff(base: DataFrame, modified: DataFrame, keys: list[str], datetimes: list[str] | tuple = ()) -> DataFrame:
    """The change frame from ``base`` to ``modified``: one full outer join, one shuffle of each side.

    Rows with a null key match nothing, so each is deleted and inserted. ``datetimes`` lists columns to compare by
    instant. Keys must be unique on both sides.
    """
    cols = _columns(base, modified, keys)
    b = base.select(*[F.col(k).alias(f"__b_{k}") for k in keys], *[F.col(c).alias(f"__o_{c}") for c in cols], F.lit(True).alias("__in_b"))
    m = modified.select(*[F.col(k).alias(f"__m_{k}") for k in keys], *[F.col(c).alias(f"__n_{c}") for c in cols], F.lit(True).alias("__in_m"))
    j = b.join(m, [F.col(f"__b_{k}") == F.col(f"__m_{k}") for k in keys], "full_outer")
    differs = {c: ~same(base, c, F.col(f"__o_{c}"), F.col(f"__n_{c}"), list(datetimes)) for c in cols}
    op = F.when(F.col("__in_b").isNull(), "insert").when(F.col("__in_m").isNull(), "delete").when(any_of(list(differs.values())), "update")
    out = j.withColumn("op", op).where(F.col("op").isNotNull())
    update = F.col("op") == "update"
    key = [F.when(F.col("__in_b").isNotNull(), F.col(f"__b_{k}")).otherwise(F.col(f"__m_{k}")).alias(k) for k in keys]
    cells = []
    for c in cols:
        changed = ~update | differs[c]
        cells += [F.when(changed, F.col(f"__o_{c}")).alias(f"old_{c}"), F.when(changed, F.col(f"__n_{c}")).alias(f"new_{c}"), changed.alias(f"changed_{c}")]
    return out.select(*key, "op", *cells)


def find_inserted(base: DataFrame, modified: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``modified`` whose key ``base`` lacks."""
    _columns(base, modified, keys)
    return modified.join(base.select(*keys), keys, "left_anti")


def find_deleted(base: DataFrame, modified: DataFrame, keys: list[str]) -> DataFrame:
    return find_inserted(modified, base, keys)


def find_modified(base: DataFrame, modified: DataFrame, keys: list[str], datetimes: list[str] | tuple = ()) -> DataFrame:
    """Updates alone: an inner join on the key and a null-safe comparison."""
    return diff_inner(base, modified, keys, datetimes)


def diff_inner(base: DataFrame, modified: DataFrame, keys: list[str], datetimes: list[str] | tuple) -> DataFrame:
    cols = _columns(base, modified, keys)
    b, m = base.select(*keys, *[F.col(c).alias(f"__o_{c}") for c in cols]), modified.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in cols])
    differs = {c: ~same(base, c, F.col(f"__o_{c}"), F.col(f"__n_{c}"), list(datetimes)) for c in cols}
    out = b.join(m, keys).where(any_of(list(differs.values())))
    cells = [x for c in cols for x in (F.when(differs[c], F.col(f"__o_{c}")).alias(f"old_{c}"), F.when(differs[c], F.col(f"__n_{c}")).alias(f"new_{c}"), differs[c].alias(f"changed_{c}"))]
    return out.select(*keys, F.lit("update").alias("op"), *cells)


def dump(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows as inserts."""
    if not keys:
        raise UnsupportedError("a table without a primary key can't be dumped")
    _check_names(keys)
    cols = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.lit("insert").alias("op"), *[x for c in cols for x in (F.lit(None).cast(df.schema[c].dataType).alias(f"old_{c}"), F.col(c).alias(f"new_{c}"), F.lit(True).alias(f"changed_{c}"))])
