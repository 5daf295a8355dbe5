"""Changeset files as a data source, and change frames to and from their cells.

A cell is struct<t tinyint, i bigint, d double, s string, b binary> with the file format's tag in ``t``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import codec
from ..model import Table, UnsupportedError
from ..operators.changes import op_rank, others
from ..schema import SPARK_TYPES

CELL = "struct<t:tinyint,i:bigint,d:double,s:string,b:binary>"
LOG = f"`table` string, seq bigint, op string, pk_flags array<boolean>, old array<{CELL}>, new array<{CELL}>"


def _as_cell(v) -> tuple:
    if v is codec.UNCHANGED:
        return (codec.UNDEFINED, None, None, None, None)
    if v is None:
        return (codec.NULL, None, None, None, None)
    if isinstance(v, int):
        return (codec.INTEGER, v, None, None, None)
    if isinstance(v, float):
        return (codec.DOUBLE, None, v, None, None)
    return (codec.TEXT, None, None, v, None) if isinstance(v, str) else (codec.BLOB, None, None, None, bytes(v))


def _as_value(c):
    return codec.UNCHANGED if c["t"] == codec.UNDEFINED else None if c["t"] == codec.NULL else [c["i"], c["d"], c["s"], c["b"]][c["t"] - 1]


def read_changesets(spark: SparkSession, path: str) -> DataFrame:
    """The entries of changeset files as a log (LOG); a file is one task, for table headers carry on. ``seq`` orders a file's entries."""

    def rows(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for data in pdf["content"]:
                got = [(e.table, k, e.op, list(e.keys), [*map(_as_cell, e.old)], [*map(_as_cell, e.new)]) for k, e in enumerate(codec.decode(bytes(data)))]
                named = lambda cells: [dict(zip("tidsb", c, strict=True)) for c in cells]
                yield pd.DataFrame([(a, b, c, d, named(e), named(f)) for a, b, c, d, e, f in got], columns=["table", "seq", "op", "pk_flags", "old", "new"])

    from ..plans import ship

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, LOG)


def write_changeset(log: DataFrame, path: str) -> int:
    """Write a log, in order of table and seq, to one local file; rows pass through one by one. Returns their number."""
    n = 0

    def entries() -> Iterator[codec.Entry]:
        nonlocal n
        for r in log.orderBy("table", "seq").toLocalIterator():
            n += 1
            yield codec.Entry(r["table"], tuple(r["pk_flags"]), r["op"], [_as_value(c) for c in r["old"] or []], [_as_value(c) for c in r["new"] or []])

    with open(path, "wb") as f:
        for part in codec.encode(entries()):
            f.write(part)
    return n


def _cell(value: Column, kind: T.DataType, defined: Column) -> Column:
    def made(tag: int, slot: str | None, v: Column | None) -> Column:
        return F.struct(F.lit(tag).cast("tinyint").alias("t"), *[(v if s == slot else F.lit(None)).cast(k).alias(s) for s, k in (("i", "bigint"), ("d", "double"), ("s", "string"), ("b", "binary"))])

    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        raise UnsupportedError(f"the format has no values of type {kind.simpleString()}")
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        full = made(codec.INTEGER, "i", value)
    elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        full = made(codec.DOUBLE, "d", value)
    elif isinstance(kind, T.BinaryType):
        full = made(codec.BLOB, "b", value)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        from ..functions import iso_micros

        full = made(codec.TEXT, "s", iso_micros(value))
    else:
        full = made(codec.TEXT, "s", value)
    return F.when(~defined, made(codec.UNDEFINED, None, None)).when(value.isNull(), made(codec.NULL, None, None)).otherwise(full)


def to_log(changes: DataFrame, table: str, columns: list[str], keys: list[str]) -> DataFrame:
    """A change frame as a log; entries in order of operation and key."""
    from ..plans.numbering import numbered

    ordered = changes if "seq" in changes.columns else numbered(changes.withColumn("__rank", op_rank()), ["__rank", *keys], "seq").drop("__rank")
    kinds = {f.name: f.dataType for f in changes.schema}

    def side(s: str) -> Column:
        return F.array(*[_cell(F.col(c), kinds[c], F.lit(s == "old") | (F.col("op") == "insert")) if c in keys else _cell(F.col(f"{s}_{c}"), kinds[f"{s}_{c}"], F.col(f"changed_{c}")) for c in columns])

    none = F.array().cast(f"array<{CELL}>")
    return ordered.select(F.lit(table).alias("table"), "seq", "op", F.array(*[F.lit(c in keys) for c in columns]).alias("pk_flags"), F.when(F.col("op") == "insert", none).otherwise(side("old")).alias("old"), F.when(F.col("op") == "delete", none).otherwise(side("new")).alias("new"))


def from_log(log: DataFrame, table: Table) -> DataFrame:
    """The change frame, with ``seq``, of one table's entries in a log."""
    slots = {"integer": "i", "double": "d", "boolean": "i", "blob": "b", "geometry": "b"}
    cols = [c for c in table.columns]

    def value(side: str, k: int) -> Column:
        c = cols[k]
        return F.get(side, k)[slots.get(c.type, "s")].cast(SPARK_TYPES[c.type])

    out = []
    for k, c in enumerate(cols):
        if c.primary_key:
            out.append(F.when(F.col("op") == "insert", value("new", k)).otherwise(value("old", k)).alias(c.name))
    out += ["op"]
    for k, c in enumerate(cols):
        if not c.primary_key:
            there = F.coalesce(F.get("new", k)["t"] != codec.UNDEFINED, F.lit(False)) | F.coalesce((F.col("op") == "delete") & (F.get("old", k)["t"] != codec.UNDEFINED), F.lit(False))
            out += [F.when(there, value("old", k)).alias(f"old_{c.name}"), F.when(there, value("new", k)).alias(f"new_{c.name}"), there.alias(f"changed_{c.name}")]
    return log.where(F.col("table") == table.name).select(*out, "seq")


__all__ = ["CELL", "LOG", "from_log", "others", "read_changesets", "to_log", "write_changeset"]
