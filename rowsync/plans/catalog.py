"""Queries over the test tables, by name, and the SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gpkg
from ..model import TableFilter
from ..operators import apply as ap
from ..operators import changes as ch
from ..operators import diff as d
from ..operators import rebase as rb
from ..schema import table_of
from . import ship
from . import workload as w
from .storage import stored

K, COLS = [w.KEY], w.COLS
FLAT = ", ".join(f"{p}_{c}" for c in COLS for p in ("old", "new", "changed"))
WITH = f"WITH {w.THEIRS_SQL}, {w.OURS_SQL}, bt AS ({w.diff_sql('orders', 'theirs', K, COLS)}), bo AS ({w.diff_sql('orders', 'ours', K, COLS)})"


def _bt(s: SparkSession, p: str) -> DataFrame:
    return d.diff(w.orders(s, p), w.theirs(s, p), K)


def _bo(s: SparkSession, p: str) -> DataFrame:
    return d.diff(w.orders(s, p), w.ours(s, p), K)


def _rebased(s: SparkSession, p: str) -> rb.Rebased:
    return rb.rebase(stored(_bo(s, p), "ours"), stored(_bt(s, p), "theirs"), K)


# --- M: our changes rewritten after theirs, in SQL
MAPPING_SQL = f"""{WITH}, t AS (SELECT o_orderkey AS k FROM bt WHERE op = 'insert'), top AS (SELECT max(k) AS m FROM t),
mine AS (SELECT o_orderkey AS k FROM bo WHERE op = 'insert'),
hits AS (SELECT k, row_number() OVER (ORDER BY k) AS i FROM mine WHERE k IN (SELECT k FROM t)), n AS (SELECT count(*) AS n FROM hits),
rest AS (SELECT k, row_number() OVER (ORDER BY k) AS j FROM mine, top WHERE k NOT IN (SELECT k FROM t) AND k > m),
mapping AS (SELECT k AS old_key, m + i AS new_key FROM hits, top
            UNION ALL SELECT k, m + n + j FROM rest, top, n WHERE k - j <= m + n - 1)"""
_J = "bo JOIN (SELECT o_orderkey AS tk, op AS t_op, " + ", ".join(f"new_{c} AS t_new_{c}, changed_{c} AS t_ch_{c}" for c in COLS) + " FROM bt WHERE op <> 'insert') t ON bo.o_orderkey = t.tk"
_LEFT = _J.replace("bo JOIN", "bo LEFT JOIN")
_STILL = {c: f"(changed_{c} AND NOT (coalesce(t_op = 'update' AND t_ch_{c}, false) AND new_{c} IS NOT DISTINCT FROM t_new_{c}))" for c in COLS}
_U_CELLS = ", ".join(f"CASE WHEN {s} THEN CASE WHEN coalesce(t_op = 'update' AND t_ch_{c}, false) THEN t_new_{c} ELSE old_{c} END END AS old_{c}, CASE WHEN {s} THEN new_{c} END AS new_{c}, {s} AS changed_{c}" for c, s in _STILL.items())
_D_CELLS = ", ".join(f"CASE WHEN coalesce(t_op = 'update' AND t_ch_{c}, false) THEN t_new_{c} ELSE old_{c} END AS old_{c}, new_{c}, changed_{c}" for c in COLS)
REBASED_SQL = f"""{MAPPING_SQL},
ri AS (SELECT coalesce(new_key, o_orderkey) AS o_orderkey, op, {FLAT} FROM bo LEFT JOIN mapping ON o_orderkey = old_key WHERE op = 'insert'),
ru AS (SELECT o_orderkey, op, {_U_CELLS} FROM {_LEFT} WHERE op = 'update' AND coalesce(t_op, '') <> 'delete' AND ({' OR '.join(_STILL.values())})),
rd AS (SELECT o_orderkey, op, {_D_CELLS} FROM {_LEFT} WHERE op = 'delete' AND coalesce(t_op, '') <> 'delete')"""
CONFLICTS_SQL = f"{WITH} " + " UNION ALL ".join(
    f"SELECT o_orderkey, '{c}' AS \"column\", old_{c}::VARCHAR AS base, CASE WHEN t_op = 'update' THEN t_new_{c}::VARCHAR END AS theirs, new_{c}::VARCHAR AS ours FROM {_J} "
    f"WHERE op = 'update' AND changed_{c} AND (t_op = 'delete' OR (t_ch_{c} AND new_{c} IS DISTINCT FROM t_new_{c}))"
    for c in COLS
)


def rebase_mapping_wide(s: SparkSession, p: str) -> DataFrame:
    """Most rows of ``orders`` inserted again on both sides, so that most of our keys collide."""
    made = lambda keep: stored(d.dump(w.orders(s, p).where(keep).withColumn(w.KEY, F.col(w.KEY) + w.SHIFT), K), "inserts")
    k = F.col(w.KEY)
    return rb.key_mapping(made(k % 8 != 0), made(k % 10 != 3), w.KEY)


WIDE_SQL = f"""WITH t AS (SELECT o_orderkey + {w.SHIFT} AS k FROM orders WHERE o_orderkey % 10 <> 3), mine AS (SELECT o_orderkey + {w.SHIFT} AS k FROM orders WHERE o_orderkey % 8 <> 0),
top AS (SELECT max(k) AS m FROM t), hits AS (SELECT k, row_number() OVER (ORDER BY k) AS i FROM mine WHERE k IN (SELECT k FROM t)), n AS (SELECT count(*) AS n FROM hits),
rest AS (SELECT k, row_number() OVER (ORDER BY k) AS j FROM mine, top WHERE k NOT IN (SELECT k FROM t) AND k > m)
SELECT k AS old_key, m + i AS new_key FROM hits, top UNION ALL SELECT k, m + n + j FROM rest, top, n WHERE k - j <= m + n - 1"""


def _merged(s: SparkSession, p: str) -> DataFrame:
    changes, _ = rb.three_way(w.orders(s, p), w.ours(s, p), w.theirs(s, p), K)
    return ap.applied(w.ours(s, p), changes, K)


_NEW = ", ".join(f"new_{c} AS {c}" for c in COLS)
MERGED_SQL = f"""{REBASED_SQL}, settled AS (
  SELECT x.o_orderkey, {', '.join(f'CASE WHEN ru.changed_{c} THEN ru.new_{c} ELSE x.{c} END AS {c}' for c in COLS)}
  FROM theirs x LEFT JOIN ru ON x.o_orderkey = ru.o_orderkey WHERE x.o_orderkey NOT IN (SELECT o_orderkey FROM rd))
SELECT * FROM settled UNION ALL SELECT o_orderkey, {_NEW} FROM ri"""


def summary_multi(s: SparkSession, p: str) -> DataFrame:
    c = w.read(s, p, "customer")
    edited = c.where("c_custkey % 10 <> 1").withColumn("c_acctbal", F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).otherwise(F.col("c_acctbal")))
    return ch.summary({"orders": _bt(s, p), "customer": d.diff(c, edited, ["c_custkey"])})


_CUST = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
SUMMARY_SQL = f"""{WITH}, ce AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 <> 1),
bc AS ({w.diff_sql('customer', 'ce', ['c_custkey'], _CUST)}), u AS (SELECT 'orders' AS t, op FROM bt UNION ALL SELECT 'customer', op FROM bc)
SELECT t AS "table", count(*) FILTER (op = 'insert') AS inserts, count(*) FILTER (op = 'update') AS updates, count(*) FILTER (op = 'delete') AS deletes FROM u GROUP BY t"""

_EVENT = ["ts", "user_id", "event_type", "value", "props"]
_MS = "date_trunc('millisecond', {x} + INTERVAL 500 MICROSECOND)"
_EVENTS = f"""ev AS (SELECT event_id, CASE WHEN event_id % 7 = 1 THEN {_MS.format(x='ts')} + INTERVAL 100 MICROSECOND WHEN event_id % 7 = 2 THEN ts + INTERVAL 3 SECOND ELSE ts END AS ts,
user_id, event_type, value, props FROM events)"""


def _filtered(s: SparkSession, p: str, tables: TableFilter) -> DataFrame:
    """Which of the tables take part, and how many rows they have."""
    out = None
    for name in ("customer", "nation", "orders", "region"):
        if tables.takes(name):
            one = w.read(s, p, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
            out = one if out is None else out.unionByName(one)
    return out


def list_changes_long(s: SparkSession, p: str) -> DataFrame:
    return ch.list_changes(_bt(s, p), K)


LIST_SQL = f"{WITH} " + " UNION ALL ".join(f"SELECT o_orderkey, op, '{c}' AS \"column\", old_{c}::VARCHAR AS old_value, new_{c}::VARCHAR AS new_value FROM bt WHERE changed_{c}" for c in COLS)


def schema_rows(s: SparkSession, p: str) -> DataFrame:
    rows = [(t.name, k, c.name, c.type, c.primary_key) for n, keys in (("region", ["r_regionkey"]), ("nation", ["n_nationkey"])) for t in [table_of(n, w.read(s, p, n).schema, keys)] for k, c in enumerate(t.columns)]
    return s.createDataFrame(rows, "`table` string, position int, name string, type string, primary_key boolean")


SCHEMA_SQL = """SELECT table_name AS "table", (ordinal_position - 1)::INTEGER AS position, column_name AS name, CASE WHEN data_type = 'INTEGER' THEN 'integer' ELSE 'text' END AS type,
column_name IN ('r_regionkey', 'n_nationkey') AS primary_key FROM information_schema.columns WHERE table_name IN ('region', 'nation')"""


def concat_three(s: SparkSession, p: str) -> DataFrame:
    """base to theirs, undone, then base to ours."""
    bt = _bt(s, p)
    return ch.concat([bt, ch.invert(bt), _bo(s, p)], K)


def apply_conflicts(s: SparkSession, p: str) -> DataFrame:
    """What of our changes doesn't fit their version."""
    return ap.apply_conflicts(w.theirs(s, p), _bo(s, p), K)


_FIT_U = " AND ".join(f"(NOT bo.changed_{c} OR x.{c} IS NOT DISTINCT FROM bo.old_{c})" for c in COLS)
_FIT_D = " AND ".join(f"(x.{c} IS NOT DISTINCT FROM bo.old_{c})" for c in COLS)
APPLY_CONFLICTS_SQL = f"""{WITH} SELECT * FROM (SELECT bo.o_orderkey, bo.op, CASE WHEN bo.op = 'insert' AND x.o_orderkey IS NOT NULL THEN 'constraint'
WHEN bo.op = 'update' AND (x.o_orderkey IS NULL OR NOT ({_FIT_U})) THEN 'no_change' WHEN bo.op = 'delete' AND (x.o_orderkey IS NULL OR NOT ({_FIT_D})) THEN 'no_change' END AS status
FROM bo LEFT JOIN theirs x ON bo.o_orderkey = x.o_orderkey) WHERE status IS NOT NULL"""


def gpkg_strip_header(s: SparkSession, p: str) -> DataFrame:
    """Blobs with and without envelopes made of customers' keys, stripped."""
    k = F.col("c_custkey")
    wkb = F.concat(F.lit(b"\x01\x01\x00\x00\x00"), F.unhex(F.lpad(F.hex(k), 32, "0")))
    head = F.when(k % 2 == 0, F.lit(b"GP\x00\x01\xe6\x10\x00\x00")).otherwise(F.lit(b"GP\x00\x03\xe6\x10\x00\x00" + bytes(32)))
    return w.read(s, p, "customer").select("c_custkey", F.hex(gpkg.to_wkb(F.concat(head, wkb))).alias("wkb"))


def changes_json(s: SparkSession, p: str) -> DataFrame:
    return ch.to_json(_bt(s, p), "orders", [w.KEY, *COLS], K).select(w.KEY, "op", "json")


def _json_sql() -> str:
    text = {c: f"coalesce('\"' || {{x}}::VARCHAR || '\"', 'null')" for c in COLS} | {c: "coalesce({x}::VARCHAR, 'null')" for c in ("o_custkey", "o_totalprice")}
    cell = lambda k, c: f"""CASE WHEN changed_{c} THEN ',{{"column":{k}' || CASE WHEN op <> 'insert' THEN ',"old":' || {text[c].format(x='old_' + c)} ELSE '' END || CASE WHEN op <> 'delete' THEN ',"new":' || {text[c].format(x='new_' + c)} ELSE '' END || '}}' ELSE '' END"""
    key = """'{"column":0' || CASE WHEN op <> 'insert' THEN ',"old":' || o_orderkey ELSE '' END || CASE WHEN op = 'insert' THEN ',"new":' || o_orderkey ELSE '' END || '}'"""
    return f"""{WITH} SELECT o_orderkey, op, '{{"table":"orders","type":"' || op || '","changes":[' || {key} || {' || '.join(cell(k, c) for k, c in enumerate(COLS, 1))} || ']}}' AS json FROM bt"""


JSON_SQL = _json_sql()


def change_log(s: SparkSession, p: str) -> DataFrame:
    """Changes as cells of the file format and back."""
    from ..sources.changeset import from_log, to_log

    ship(s)
    return from_log(to_log(_bt(s, p), "orders", [w.KEY, *COLS], K), table_of("orders", w.orders(s, p).schema, K)).drop("seq")


def conversations_diff(s: SparkSession, p: str) -> DataFrame:
    """A composite key."""
    c = w.read(s, p, "conversations").select("conv_id", "turn", "role", "text")
    return d.diff(c, c.where("(conv_id + turn) % 9 <> 0").withColumn("role", F.when(F.col("turn") % 5 == 1, F.lit(None)).otherwise(F.col("role"))), ["conv_id", "turn"])


_CONV_SQL = f"""WITH ce AS (SELECT conv_id, turn, CASE WHEN turn % 5 <> 1 THEN role END AS role, text FROM conversations WHERE (conv_id + turn) % 9 <> 0)
{w.diff_sql('conversations', 'ce', ['conv_id', 'turn'], ['role', 'text'])}"""

QUERIES = {
    "diff_orders": _bt,
    "diff_composite_key": conversations_diff,
    "find_inserted": lambda s, p: d.find_inserted(w.orders(s, p), w.theirs(s, p), K),
    "find_deleted": lambda s, p: d.find_deleted(w.orders(s, p), w.theirs(s, p), K),
    "find_modified": lambda s, p: d.find_modified(w.orders(s, p), w.theirs(s, p), K),
    "diff_events_ms": lambda s, p: d.diff(w.read(s, p, "events").select("event_id", *_EVENT), w.shifted_events(s, p), ["event_id"], ["ts"]),
    "changes_count": lambda s, p: _bt(s, p).agg(F.count("*").alias("n")),
    "summary_multi": summary_multi,
    "dump_region": lambda s, p: d.dump(w.read(s, p, "region"), ["r_regionkey"]),
    "filter_skip": lambda s, p: _filtered(s, p, TableFilter(skip=frozenset({"orders"}))),
    "filter_include": lambda s, p: _filtered(s, p, TableFilter(include=frozenset({"nation", "region"}))),
    "invert_orders": lambda s, p: ch.invert(_bt(s, p)),
    "list_changes_long": list_changes_long,
    "schema_rows": schema_rows,
    "concat_two": lambda s, p: ch.concat([_bt(s, p), _bo(s, p)], K),
    "concat_three": concat_three,
    "rebase_mapping": lambda s, p: _rebased(s, p).mapping,
    "rebased_inserts": lambda s, p: _rebased(s, p).inserts,
    "rebased_updates": lambda s, p: _rebased(s, p).others.where("op = 'update'"),
    "rebased_deletes": lambda s, p: _rebased(s, p).others.where("op = 'delete'"),
    "rebase_conflicts": lambda s, p: _rebased(s, p).conflicts,
    "apply_orders": lambda s, p: ap.applied(w.orders(s, p), _bt(s, p), K),
    "apply_conflicts": apply_conflicts,
    "roundtrip_empty_diff": lambda s, p: d.diff(ap.applied(w.orders(s, p), _bt(s, p), K), w.theirs(s, p), K).select(w.KEY, "op"),
    "rebase_db_final": _merged,
    "fk_violations": lambda s, p: ap.foreign_key_violations(w.orders(s, p), ["o_custkey"], w.read(s, p, "customer").where("c_custkey % 10 <> 0"), ["c_custkey"]),
    "unique_violations": lambda s, p: ap.unique_violations(w.orders(s, p), ["o_custkey"]).select("o_custkey", "n"),
    "gpkg_strip_header": gpkg_strip_header,
    "changes_json": changes_json,
    "rebase_mapping_wide": rebase_mapping_wide,
    "change_log": change_log,
}
ORACLE_SQL = {
    "diff_orders": f"{WITH} SELECT * FROM bt",
    "diff_composite_key": _CONV_SQL,
    "find_inserted": f"{WITH} SELECT * FROM theirs t WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = t.o_orderkey)",
    "find_deleted": f"{WITH} SELECT * FROM orders o WHERE NOT EXISTS (SELECT 1 FROM theirs t WHERE o.o_orderkey = t.o_orderkey)",
    "find_modified": f"{WITH} SELECT * FROM bt WHERE op = 'update'",
    "diff_events_ms": f"WITH {_EVENTS} {w.diff_sql('events', 'ev', ['event_id'], _EVENT, {'ts': _MS})}",
    "changes_count": f"{WITH} SELECT count(*) AS n FROM bt",
    "summary_multi": SUMMARY_SQL,
    "dump_region": "SELECT r_regionkey, 'insert' AS op, NULL::VARCHAR AS old_r_name, r_name AS new_r_name, true AS changed_r_name FROM region",
    "filter_skip": "SELECT 'customer' AS \"table\", count(*) AS n FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'region', count(*) FROM region",
    "filter_include": "SELECT 'nation' AS \"table\", count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region",
    "invert_orders": f"{WITH} {w.invert_sql('bt', K, COLS)}",
    "list_changes_long": LIST_SQL,
    "schema_rows": SCHEMA_SQL,
    "concat_two": f"{WITH} {w.concat_sql('bt', 'bo', K, COLS)}",
    "concat_three": f"{WITH}, inv AS ({w.invert_sql('bt', K, COLS)}), c2 AS ({w.concat_sql('bt', 'inv', K, COLS)}) {w.concat_sql('c2', 'bo', K, COLS)}",
    "rebase_mapping": f"{MAPPING_SQL} SELECT * FROM mapping",
    "rebased_inserts": f"{REBASED_SQL} SELECT * FROM ri",
    "rebased_updates": f"{REBASED_SQL} SELECT * FROM ru",
    "rebased_deletes": f"{REBASED_SQL} SELECT * FROM rd",
    "rebase_conflicts": CONFLICTS_SQL,
    "apply_orders": f"{WITH} SELECT * FROM theirs",
    "apply_conflicts": APPLY_CONFLICTS_SQL,
    "roundtrip_empty_diff": "SELECT o_orderkey, '' AS op FROM orders WHERE false",
    "rebase_db_final": MERGED_SQL,
    "fk_violations": "SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)",
    "unique_violations": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1",
    "gpkg_strip_header": "SELECT c_custkey, '0101000000' || lpad(hex(c_custkey), 32, '0') AS wkb FROM customer",
    "change_log": f"{WITH} SELECT o_orderkey, op, {FLAT} FROM bt",
    "changes_json": JSON_SQL,
    "rebase_mapping_wide": WIDE_SQL,
}
