"""Algebra of change frames: invert, count, list, merge in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import OP_CODES, OP_RANK, UnsupportedError
from .diff import any_of


def others(changes: DataFrame) -> list[str]:
    """The columns besides the key that a change frame covers."""
    return [c[len("changed_") :] for c in changes.columns if c.startswith("changed_")]


def invert(changes: DataFrame) -> DataFrame:
    """The changes that undo these: inserts and deletes trade places, old and new values too."""
    op = F.when(F.col("op") == "insert", "delete").when(F.col("op") == "delete", "insert").otherwise(F.col("op"))
    swap = {"op": op} | {f"old_{c}": F.col(f"new_{c}") for c in others(changes)} | {f"new_{c}": F.col(f"old_{c}") for c in others(changes)}
    return changes.select(*[swap[c].alias(c) if c in swap else F.col(c) for c in changes.columns])


def has_changes(changes: DataFrame) -> bool:
    return not changes.isEmpty()


def op_rank() -> Column:
    return F.coalesce(*[F.when(F.col("op") == k, F.lit(v)) for k, v in OP_RANK.items()])


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, inserts, updates, deletes) of the tables that have changes."""
    each = [df.select(F.lit(name).alias("table"), "op") for name, df in sorted(tables.items())]
    count = lambda op: F.count_if(F.col("op") == op)
    return reduce(DataFrame.unionByName, each).groupBy("table").agg(count("insert").alias("inserts"), count("update").alias("updates"), count("delete").alias("deletes"))


def list_changes(changes: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each changed cell, values as text: the keys, op, column, old_value, new_value."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"changed_{c}").alias("is"), F.col(f"old_{c}").cast("string").alias("old_value"), F.col(f"new_{c}").cast("string").alias("new_value")) for c in others(changes)])
    return changes.select(*keys, "op", F.explode(F.filter(cells, lambda x: x["is"])).alias("x")).select(*keys, "op", "x.column", "x.old_value", "x.new_value")


def _cell(c: str, kind: str) -> Column:
    x = F.col(c)
    return F.base64(x) if kind == "binary" else x.cast("string")


def to_json(changes: DataFrame, table: str, columns: list[str], keys: list[str]) -> DataFrame:
    """(op, json): each entry as the interchange document has it, columns by position; unchanged cells left out."""
    kinds = dict(changes.dtypes)
    number = lambda t: t in ("tinyint", "smallint", "int", "bigint", "double", "float")

    def value(c: str) -> Column:
        kind = kinds[c]
        text = F.col(c).cast("string") if number(kind) else F.when(F.col(c), "1").otherwise("0") if kind == "boolean" else F.concat(F.lit('"'), F.regexp_replace(_cell(c, kind), r'(["\\])', r"\\$1"), F.lit('"'))
        if not number(kind) and kind not in ("boolean", "binary"):
            text = F.regexp_extract(F.to_json(F.struct(_cell(c, kind).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
        return F.when(F.col(c).isNull(), "null").otherwise(text)

    parts = []
    for k, c in enumerate(columns):
        key = c in keys
        old = value(c) if key else value(f"old_{c}")
        new = value(c) if key else value(f"new_{c}")
        shown = F.lit(True) if key else F.col(f"changed_{c}")
        has_old = F.col("op") != "insert"
        has_new = (F.col("op") == "insert") if key else (F.col("op") != "delete")
        body = F.concat(F.lit(f'{{"column":{k}'), F.when(has_old, F.concat(F.lit(',"old":'), old)).otherwise(""), F.when(has_new, F.concat(F.lit(',"new":'), new)).otherwise(""), F.lit("}"))
        parts.append(F.when(shown, body))
    changed = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), ",")
    return changes.select(*keys, "op", F.concat(F.lit(f'{{"table":"{table}","type":"'), F.col("op"), F.lit('","changes":['), changed, F.lit("]}")).alias("json"))


def _entry(x: Column, cols: list[str]) -> dict[str, Column]:
    return {f: x[f] for c in cols for f in (f"old_{c}", f"new_{c}", f"changed_{c}")} | {"op": x["op"]}


def _pack(op: Column, cells: dict[str, Column], cols: list[str]) -> Column:
    return F.struct(op.alias("op"), *[cells[f].alias(f) for c in cols for f in (f"old_{c}", f"new_{c}", f"changed_{c}")])


def _merged(a: Column, x: Column, cols: list[str]) -> Column:
    """Entry ``a``, then ``x``, on the same key, as one entry; null if nothing is left or the pair makes no sense."""
    p, q = _entry(a, cols), _entry(x, cols)
    pair = lambda m, n: (a["op"] == m) & (x["op"] == n)
    ii, dd, uu, di = {}, {}, {}, {}
    for c in cols:
        o, n, h = f"old_{c}", f"new_{c}", f"changed_{c}"
        none = F.when(F.lit(False), p[o])
        ii |= {o: none, n: F.when(q[h], q[n]).otherwise(p[n]), h: F.lit(True)}
        dd |= {o: F.when(p[h], p[o]).otherwise(q[o]), n: none, h: F.lit(True)}
        first, last = F.when(p[h], p[o]).otherwise(q[o]), F.when(q[h], q[n]).otherwise(p[n])
        still = (p[h] | q[h]) & ~first.eqNullSafe(last)
        uu |= {o: F.when(still, first), n: F.when(still, last), h: still}
        back = ~p[o].eqNullSafe(q[n])
        di |= {o: F.when(back, p[o]), n: F.when(back, q[n]), h: back}
    left = lambda cells: any_of([cells[f"changed_{c}"] for c in cols])
    return (
        F.when(pair("insert", "update"), _pack(F.lit("insert"), ii, cols))
        .when(pair("update", "update") & left(uu), _pack(F.lit("update"), uu, cols))
        .when(pair("update", "delete"), _pack(F.lit("delete"), dd, cols))
        .when(pair("delete", "insert") & left(di), _pack(F.lit("update"), di, cols))
    )


def concat(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """One change frame for several, in order.

    Entries of a key are folded strictly from first to last (the merge isn't associative). Pairs that make no sense,
    such as two inserts, drop both entries, and a later entry of the key starts afresh. A part may have a ``seq`` column
    that orders its own entries.
    """
    if len(parts) < 2:
        raise UnsupportedError("at least two change frames are needed")
    cols = others(parts[0])
    fields = [f for c in cols for f in (f"old_{c}", f"new_{c}", f"changed_{c}")]
    rows = [df.select(*keys, F.lit(k).alias("part"), (F.col("seq").cast("long") if "seq" in df.columns else F.lit(0).cast("long")).alias("seq"), "op", *fields) for k, df in enumerate(parts)]
    union = reduce(DataFrame.unionByName, rows)
    entry = F.struct("op", *fields)
    listed = union.groupBy(*keys).agg(F.collect_list(F.struct("part", "seq", entry.alias("entry"))).alias("xs"))
    kind = union.select(entry.alias("e")).schema["e"].dataType.simpleString()
    ordered = F.transform(F.array_sort("xs", lambda a, b: F.when(a["part"] != b["part"], a["part"] - b["part"]).otherwise(F.signum(a["seq"] - b["seq"]).cast("int"))), lambda x: x["entry"])
    # a null state is "no entry"
    folded = F.aggregate(ordered, F.lit(None).cast(kind), lambda acc, x: F.when(acc.isNull(), x).otherwise(_merged(acc, x, cols)).cast(kind))
    return listed.select(*keys, folded.alias("e")).where(F.col("e").isNotNull()).select(*keys, "e.*")


def op_code() -> Column:
    return F.coalesce(*[F.when(F.col("op") == k, F.lit(v)) for k, v in OP_CODES.items()])
