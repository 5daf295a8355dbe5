"""Two edited versions of ``orders``, and changed copies of other tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY, COLS = "o_orderkey", ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
SHIFT = 10_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(KEY, *COLS)


def _edited(base: DataFrame, dropped, cells: dict, added, status: str) -> DataFrame:
    kept = base.where(~dropped).withColumns(cells)
    new = base.where(added).withColumn(KEY, F.col(KEY) + SHIFT).withColumn("o_orderstatus", F.lit(status))
    return kept.select(KEY, *COLS).unionByName(new.select(KEY, *COLS))


def theirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(KEY)
    cells = {"o_totalprice": F.when(k % 13 == 5, F.col("o_totalprice") + 1.0).otherwise(F.col("o_totalprice")), "o_orderpriority": F.when(k % 19 != 7, F.col("o_orderpriority"))}
    return _edited(orders(spark, sf_dir), k % 17 == 3, cells, k % 5 == 0, "T")


def ours(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(KEY)
    cells = {
        "o_totalprice": F.when(k % 13 == 5, F.col("o_totalprice") + 2.0).otherwise(F.col("o_totalprice")),
        "o_orderpriority": F.when(k % 19 != 7, F.col("o_orderpriority")),
        "o_orderstatus": F.when(k % 11 == 2, F.lit("X")).otherwise(F.col("o_orderstatus")),
    }
    return _edited(orders(spark, sf_dir), ((k % 17 == 3) & (k % 2 == 0)) | (k % 23 == 4), cells, k % 3 == 0, "O2")


def shifted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some times moved by less than what counts as a change, some by seconds."""
    k = F.col("event_id")
    # to the next lower whole millisecond and back up by less than half of one: the same after rounding
    low = F.date_trunc("MILLISECOND", F.col("ts") + F.expr("INTERVAL 500 MICROSECOND"))
    ts = F.when(k % 7 == 1, low + F.expr("INTERVAL 100 MICROSECOND")).when(k % 7 == 2, F.col("ts") + F.expr("INTERVAL 3 SECOND")).otherwise(F.col("ts"))
    return read(spark, sf_dir, "events").select("event_id", ts.alias("ts"), "user_id", "event_type", "value", "props")


_SAME = "o_orderkey, o_custkey"
THEIRS_SQL = f"""theirs AS (
  SELECT {_SAME}, o_orderstatus, CASE WHEN o_orderkey % 13 = 5 THEN o_totalprice + 1.0 ELSE o_totalprice END AS o_totalprice, o_orderdate,
         CASE WHEN o_orderkey % 19 <> 7 THEN o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 17 <> 3
  UNION ALL SELECT o_orderkey + {SHIFT}, o_custkey, 'T', o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 5 = 0)"""
OURS_SQL = f"""ours AS (
  SELECT {_SAME}, CASE WHEN o_orderkey % 11 = 2 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 13 = 5 THEN o_totalprice + 2.0 ELSE o_totalprice END AS o_totalprice, o_orderdate,
         CASE WHEN o_orderkey % 19 <> 7 THEN o_orderpriority END AS o_orderpriority
  FROM orders WHERE NOT ((o_orderkey % 17 = 3 AND o_orderkey % 2 = 0) OR o_orderkey % 23 = 4)
  UNION ALL SELECT o_orderkey + {SHIFT}, o_custkey, 'O2', o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0)"""


def diff_sql(base: str, modified: str, keys: list[str], cols: list[str], equal: dict[str, str] | None = None) -> str:
    """A change frame in SQL. ``equal``: for a column, an expression over {x} to compare by."""
    by = equal or {}
    differs = {c: f"({by.get(c, '{x}').format(x='b.' + c)} IS DISTINCT FROM {by.get(c, '{x}').format(x='m.' + c)})" for c in cols}
    op = f"CASE WHEN b.{keys[0]} IS NULL THEN 'insert' WHEN m.{keys[0]} IS NULL THEN 'delete' WHEN {' OR '.join(differs.values())} THEN 'update' END"
    alone = f"(b.{keys[0]} IS NULL OR m.{keys[0]} IS NULL)"
    cells = ", ".join(f"CASE WHEN {alone} OR {d} THEN b.{c} END AS old_{c}, CASE WHEN {alone} OR {d} THEN m.{c} END AS new_{c}, ({alone} OR {d}) AS changed_{c}" for c, d in differs.items())
    on = " AND ".join(f"b.{k} = m.{k}" for k in keys)
    return f"SELECT * FROM (SELECT {', '.join(f'coalesce(b.{k}, m.{k}) AS {k}' for k in keys)}, {op} AS op, {cells} FROM {base} b FULL OUTER JOIN {modified} m ON {on}) WHERE op IS NOT NULL"


def invert_sql(changes: str, keys: list[str], cols: list[str]) -> str:
    cells = ", ".join(f"new_{c} AS old_{c}, old_{c} AS new_{c}, changed_{c}" for c in cols)
    return f"SELECT {', '.join(keys)}, CASE op WHEN 'insert' THEN 'delete' WHEN 'delete' THEN 'insert' ELSE op END AS op, {cells} FROM {changes}"


def concat_sql(first: str, second: str, keys: list[str], cols: list[str]) -> str:
    """Two change frames merged key by key."""
    out = []
    for c in cols:
        first_old = f"CASE WHEN a.changed_{c} THEN a.old_{c} ELSE x.old_{c} END"
        last_new = f"CASE WHEN x.changed_{c} THEN x.new_{c} ELSE a.new_{c} END"
        uu = f"((a.changed_{c} OR x.changed_{c}) AND ({first_old}) IS DISTINCT FROM ({last_new}))"
        di = f"(a.old_{c} IS DISTINCT FROM x.new_{c})"
        out.append((c, first_old, last_new, uu, di))
    any_uu, any_di = " OR ".join(x[3] for x in out), " OR ".join(x[4] for x in out)
    case = lambda alone, iu, uu, ud, di: f"CASE WHEN x.op IS NULL THEN {alone.format('a')} WHEN a.op IS NULL THEN {alone.format('x')} WHEN a.op = 'insert' THEN {iu} WHEN a.op = 'update' AND x.op = 'update' THEN {uu} WHEN a.op = 'update' THEN {ud} ELSE {di} END"
    cells = ", ".join(
        f"{case('{}.old_' + c, 'NULL', f'CASE WHEN {u} THEN {o} END', o, f'CASE WHEN {d} THEN a.old_{c} END')} AS old_{c}, "
        f"{case('{}.new_' + c, n, f'CASE WHEN {u} THEN {n} END', 'NULL', f'CASE WHEN {d} THEN x.new_{c} END')} AS new_{c}, "
        f"{case('{}.changed_' + c, 'true', u, 'true', d)} AS changed_{c}"
        for c, o, n, u, d in out
    )
    op = (
        "CASE WHEN x.op IS NULL THEN a.op WHEN a.op IS NULL THEN x.op WHEN a.op = 'insert' AND x.op = 'update' THEN 'insert' "
        f"WHEN a.op = 'update' AND x.op = 'update' AND ({any_uu}) THEN 'update' WHEN a.op = 'update' AND x.op = 'delete' THEN 'delete' "
        f"WHEN a.op = 'delete' AND x.op = 'insert' AND ({any_di}) THEN 'update' END"
    )
    on = " AND ".join(f"a.{k} = x.{k}" for k in keys)
    return f"SELECT * FROM (SELECT {', '.join(f'coalesce(a.{k}, x.{k}) AS {k}' for k in keys)}, {op} AS op, {cells} FROM {first} a FULL OUTER JOIN {second} x ON {on}) WHERE op IS NOT NULL"
