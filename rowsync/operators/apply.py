"""Applying changes, all or nothing, and checks of the result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ConflictError, RowsyncError
from ..plans.storage import stored
from .changes import others
from .diff import same


def check_shape(columns: list[str], changes: DataFrame, keys: list[str]) -> None:
    """The changes must be of a table with these columns and this key."""
    cols = others(changes)
    if sorted(c for c in changes.columns if c in columns and c not in cols) != sorted(keys):
        raise RowsyncError("the changes are of a table with another primary key")
    if sorted([*keys, *cols]) != sorted(columns):
        raise RowsyncError("the changes are of a table with other columns")


def apply_plan(table: DataFrame, changes: DataFrame, keys: list[str], datetimes: list[str] | tuple = ()) -> DataFrame:
    """Table and changes side by side, with ``status``: null (no change), "applied", "constraint" or "no_change".

    An insert needs a free key; an update needs the old values of the cells that it changes; a delete needs all of them.
    """
    cols = others(changes)
    check_shape(table.columns, changes, keys)
    t = table.select(*[F.col(k).alias(f"__t_{k}") for k in keys], *[F.col(c).alias(f"__v_{c}") for c in cols], F.lit(True).alias("__in_t"))
    j = t.join(changes, [F.col(f"__t_{k}") == F.col(k) for k in keys], "full_outer")
    fits = lambda need: reduce(lambda a, b: a & b, [~need(c) | same(table, c, F.col(f"__v_{c}"), F.col(f"old_{c}"), list(datetimes)) for c in cols], F.lit(True))
    there = F.col("__in_t").isNotNull()
    ok_update, ok_delete = there & fits(lambda c: F.col(f"changed_{c}")), there & fits(lambda c: F.lit(True))
    status = (
        F.when(F.col("op") == "insert", F.when(there, "constraint").otherwise("applied"))
        .when(F.col("op") == "update", F.when(ok_update, "applied").otherwise("no_change"))
        .when(F.col("op") == "delete", F.when(ok_delete, "applied").otherwise("no_change"))
    )
    return j.withColumn("status", status)


def apply_conflicts(table: DataFrame, changes: DataFrame, keys: list[str], datetimes: list[str] | tuple = ()) -> DataFrame:
    """(keys, op, status) of the changes that don't fit."""
    return apply_plan(table, changes, keys, datetimes).where("status <> 'applied'").select(*keys, "op", "status")


def applied(table: DataFrame, changes: DataFrame, keys: list[str], datetimes: list[str] | tuple = ()) -> DataFrame:
    """The table after the changes that fit; those that don't are left out."""
    return _after(apply_plan(table, changes, keys, datetimes), table.columns, keys)


def _after(plan: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    done = F.coalesce(F.col("status") == "applied", F.lit(False))
    kept = plan.where(F.when(F.col("__in_t").isNull(), done).otherwise(~(done & (F.col("op") == "delete"))))
    new = F.col("__in_t").isNull()
    value = lambda c: F.when(new | (done & (F.col("op") == "update") & F.col(f"changed_{c}")), F.col(f"new_{c}")).otherwise(F.col(f"__v_{c}"))
    return kept.select(*[F.when(new, F.col(c)).otherwise(F.col(f"__t_{c}")).alias(c) if c in keys else value(c).alias(c) for c in columns])


def apply(table: DataFrame, changes: DataFrame, keys: list[str], datetimes: list[str] | tuple = (), on_conflict=None) -> DataFrame:
    """The table after all changes; ConflictError if any of them doesn't fit.

    Table and changes are joined once; the checks and the result read what that join wrote. ``on_conflict`` gets the
    frame (keys, op, status, old and new cells) of changes that don't fit.
    """
    repeated = changes.groupBy(*keys).count().where("count > 1")
    if not repeated.isEmpty():
        raise RowsyncError("the changes have several entries for a key: concatenate them first")
    plan = stored(apply_plan(table, changes, keys, datetimes), "plan")
    bad = plan.where("status <> 'applied'")
    if n := bad.count():
        if on_conflict:
            on_conflict(bad.select(*changes.columns, "status"))
        raise ConflictError(f"{n} changes don't fit the table, such as {bad.select(*keys, 'op', 'status').first().asDict()}")
    return _after(plan, table.columns, keys)


def unique_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n) of values that several rows share; nulls never clash."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])).groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def foreign_key_violations(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Rows of ``child`` that refer to no row of ``parent``; rows with a null in ``columns`` refer to nothing."""
    wanted = parent.select(*[F.col(p).alias(f"__p_{p}") for p in parent_columns]).distinct()
    full = child.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    return full.join(wanted, [F.col(c) == F.col(f"__p_{p}") for c, p in zip(columns, parent_columns, strict=True)], "left_anti")


def null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns], F.lit(False)))
