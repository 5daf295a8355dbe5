"""Writing into database files: triggers, constraints, what passes through; SQL of the server source."""

import json
import sqlite3
import struct

import pytest

from rowsync import cli
from rowsync.api import Engine
from rowsync.functions import gpkg
from rowsync.model import Column, ConflictError, Crs, Geometry, RowsyncError, Table
from rowsync.sources import rowwise
from rowsync.sources.jdbc import JdbcDataset, placed
from rowsync.sources.sqlite import SqliteDataset

POINT = gpkg.with_header(struct.pack("<BIdd", 1, 1, 3.0, 4.0), 4326)
LINE = gpkg.with_header(struct.pack("<BII4d", 1, 2, 2, 0.0, 1.0, 2.0, -3.0), 4326)
EMPTY = b"GP\x00\x11\xe6\x10\x00\x00" + struct.pack("<BIdd", 1, 1, float("nan"), float("nan"))


def database(path, script, copies=()):
    with sqlite3.connect(path) as db:
        db.executescript(script)
    for c in copies:
        with sqlite3.connect(path) as db, sqlite3.connect(c) as to:
            db.backup(to)
    return str(path)


def edit(path, *statements):
    with sqlite3.connect(path) as db:
        for s in statements:
            db.execute(s)


def read(path, sql):
    with sqlite3.connect(path) as db:
        return db.execute(sql).fetchall()


AUDITED = """
CREATE TABLE simple (fid INTEGER PRIMARY KEY, name TEXT, seen DATETIME);
CREATE TABLE audit (note TEXT);
CREATE TABLE pairs (a INTEGER, b INTEGER, v TEXT, PRIMARY KEY (a, b));
INSERT INTO simple VALUES (1, 'a', '2021-04-01T15:00:00Z'), (2, 'b', NULL), (3, 'c', NULL);
INSERT INTO pairs VALUES (1, 1, 'x');
CREATE TRIGGER on_insert AFTER INSERT ON simple BEGIN INSERT INTO audit VALUES ('insert ' || NEW.fid); END;
CREATE TRIGGER on_update AFTER UPDATE ON simple BEGIN INSERT INTO audit VALUES ('update ' || NEW.fid); END;
"""


def test_apply_fires_no_trigger_and_keeps_them(spark, tmp_path):
    base = database(tmp_path / "base.db", AUDITED, [tmp_path / "mod.db"])
    edit(tmp_path / "mod.db", "UPDATE simple SET name = 'z' WHERE fid = 2", "INSERT INTO simple VALUES (9, 'n', NULL)", "DELETE FROM simple WHERE fid = 3", "DELETE FROM audit")
    e = Engine(spark)
    b, m = e.open("sqlite", base), e.open("sqlite", str(tmp_path / "mod.db"))
    e.apply(b, e.diff(b, m))
    assert read(base, "SELECT fid, name FROM simple") == [(1, "a"), (2, "z"), (9, "n")] and read(base, "SELECT * FROM audit") == []
    assert [n for n, _ in b.triggers()] == ["on_insert", "on_update"]
    edit(base, "INSERT INTO simple VALUES (10, 'q', NULL)")
    assert read(base, "SELECT * FROM audit") == [("insert 10",)]


def test_spatial_triggers_run(spark, tmp_path):
    script = """
    CREATE TABLE places (fid INTEGER PRIMARY KEY, geom POINT);
    CREATE TABLE box (id INTEGER, x0, x1, y0, y1);
    CREATE TRIGGER rtree_places_geom_insert AFTER INSERT ON places WHEN NEW.geom NOT NULL AND NOT ST_IsEmpty(NEW.geom)
    BEGIN INSERT INTO box VALUES (NEW.fid, ST_MinX(NEW.geom), ST_MaxX(NEW.geom), ST_MinY(NEW.geom), ST_MaxY(NEW.geom)); END;
    """
    base = database(tmp_path / "base.gpkg", script, [tmp_path / "mod.gpkg"])
    with SqliteDataset(None, str(tmp_path / "mod.gpkg")).connect() as db:
        db.executemany("INSERT INTO places VALUES (?, ?)", [(1, POINT), (2, LINE), (3, EMPTY), (4, None)])
    e = Engine(spark, include=["places"])
    b, m = e.open("sqlite", base), e.open("sqlite", str(tmp_path / "mod.gpkg"))
    e.apply(b, e.diff(b, m))
    assert read(base, "SELECT * FROM box ORDER BY id") == [(1, 3.0, 3.0, 4.0, 4.0), (2, 0.0, 2.0, -3.0, 1.0)]


TREES = """
CREATE TABLE species (fid INTEGER PRIMARY KEY, species_id TEXT UNIQUE, name TEXT);
CREATE TABLE trees (fid INTEGER PRIMARY KEY, species_id TEXT NOT NULL REFERENCES species (species_id), age INTEGER);
INSERT INTO species VALUES (1, 'MPL', 'Maple'), (2, 'OAK', 'Oak'), (3, 'PIN', 'Pine');
INSERT INTO trees VALUES (1, 'MPL', 25), (2, 'OAK', 30), (3, 'PIN', 18);
"""


@pytest.mark.parametrize("swap", [False, True])
@pytest.mark.parametrize(
    ("a", "b", "says"),
    [
        (["INSERT INTO species VALUES (4, 'BCH', 'Birch')"], ["INSERT INTO species VALUES (4, 'BCH', 'Beech')"], "UNIQUE"),
        (["DELETE FROM trees WHERE species_id = 'PIN'", "DELETE FROM species WHERE species_id = 'PIN'"], ["INSERT INTO trees VALUES (4, 'PIN', 101)"], "FOREIGN KEY"),
    ],
)
def test_rebase_that_breaks_constraints_is_a_conflict(spark, tmp_path, a, b, says, swap):
    files = [str(tmp_path / n) for n in ("base.db", "a.db", "b.db")]
    database(files[0], TREES, files[1:])
    edit(files[1], *a)
    edit(files[2], *b)
    ours, theirs = (files[2], files[1]) if swap else (files[1], files[2])
    before = read(ours, "SELECT * FROM species"), read(ours, "SELECT * FROM trees")
    e = Engine(spark)
    with pytest.raises(ConflictError, match=says):
        e.rebase(*(e.open("sqlite", f) for f in (files[0], ours, theirs)))
    assert (read(ours, "SELECT * FROM species"), read(ours, "SELECT * FROM trees")) == before
    assert cli.main(["rebase-db", files[0], ours, theirs]) == 1


def test_rows_that_wait_for_others(spark, tmp_path):
    """Two rows trade unique values, parents come after children."""
    base = database(tmp_path / "base.db", TREES, [tmp_path / "mod.db"])
    edit(tmp_path / "mod.db", "UPDATE species SET species_id = NULL WHERE fid = 2", "INSERT INTO species VALUES (7, 'OAK', 'New oak')", "INSERT INTO species VALUES (8, 'ZZZ', 'z')", "INSERT INTO trees VALUES (9, 'ZZZ', 1)")
    e = Engine(spark)
    b, m = e.open("sqlite", base), e.open("sqlite", str(tmp_path / "mod.db"))
    e.apply(b, e.diff(b, m))
    assert read(base, "SELECT * FROM species") == read(m.where, "SELECT * FROM species") and read(base, "SELECT count(*) FROM trees") == [(4,)]


def test_what_doesnt_fit_is_logged_and_nothing_written(spark, tmp_path):
    base = database(tmp_path / "base.db", AUDITED, [tmp_path / "mod.db"])
    edit(tmp_path / "mod.db", "UPDATE simple SET name = 'z' WHERE fid = 2", "DELETE FROM simple WHERE fid = 3")
    said = []
    e = Engine(spark, logger=lambda level, text: said.append((level, text)))
    b, m = e.open("sqlite", base), e.open("sqlite", str(tmp_path / "mod.db"))
    changes = e.diff(b, m)
    changes = {n: c.cache() for n, c in changes.items()}
    assert sum(c.count() for c in changes.values()) == 2
    edit(base, "UPDATE simple SET name = 'other' WHERE fid = 2")
    with pytest.raises(ConflictError):
        e.apply(b, changes)
    assert read(base, "SELECT count(*) FROM simple") == [(3,)]
    found = [json.loads(t.split(": ", 2)[2]) for level, t in said if level == "warning"]
    assert found == [{"table": "simple", "type": "update", "changes": [{"column": 0, "old": 2}, {"column": 1, "old": "b", "new": "z"}]}]
    assert any(level == "info" and "audit" in t for level, t in said)


def test_rebase_leaves_untouched_tables_alone_and_compares_instants(spark, tmp_path):
    files = [str(tmp_path / n) for n in ("base.db", "ours.db", "theirs.db")]
    database(files[0], AUDITED, files[1:])
    edit(files[1], "UPDATE simple SET seen = '2021-04-01 15:00:00', name = 'mine' WHERE fid = 1", "INSERT INTO pairs VALUES (2, 2, 'kept')")
    edit(files[2], "UPDATE simple SET seen = '2021-04-01 15:00:00.000', name = 'b2' WHERE fid = 2 OR fid = 1")
    e = Engine(spark)
    conflicts = e.rebase(*(e.open("sqlite", f) for f in files))
    assert [tuple(r) for r in conflicts["simple"].collect()] == [(1, "name", "a", "b2", "mine")] and set(conflicts) == {"simple"}
    assert read(files[1], "SELECT fid, name FROM simple") == [(1, "mine"), (2, "b2"), (3, "c")] and read(files[1], "SELECT * FROM pairs") == [(1, 1, "x"), (2, 2, "kept")]


def test_a_changeset_with_another_key_is_refused(spark, tmp_path):
    base = database(tmp_path / "base.db", "CREATE TABLE t (a INTEGER PRIMARY KEY, b INTEGER); INSERT INTO t VALUES (1, 2)", [tmp_path / "mod.db"])
    edit(tmp_path / "mod.db", "UPDATE t SET b = 3")
    other = database(tmp_path / "other.db", "CREATE TABLE t (a INTEGER, b INTEGER PRIMARY KEY); INSERT INTO t VALUES (1, 2)")
    e = Engine(spark)
    b, m, o = (e.open("sqlite", f) for f in (base, str(tmp_path / "mod.db"), other))
    path = str(tmp_path / "c.diff")
    e.save(e.diff(b, m), {"t": b.table("t")}, path)
    with pytest.raises(RowsyncError, match="primary key"):
        e.load(path, {"t": o.table("t")})
    with pytest.raises(RowsyncError, match="primary key"):
        e.apply(o, e.diff(b, m))


def test_new_geopackage(spark, tmp_path):
    t = Table("places", (Column("fid", "integer", "INTEGER", True, True, True), Column("geom", "geometry", "POINT", geometry=Geometry("POINT", 3857, True))), Crs(3857, "EPSG", 3857, "wkt"))
    ds = SqliteDataset(spark, str(tmp_path / "new.gpkg"), create=True)
    ds.create_tables([t])
    assert ds.table("places").compatible(t) and read(ds.where, "SELECT table_name, data_type, srs_id FROM gpkg_contents") == [("places", "features", 3857)]
    assert read(ds.where, "SELECT srs_id FROM gpkg_spatial_ref_sys ORDER BY srs_id") == [(-1,), (0,), (3857,)]
    with pytest.raises(RowsyncError):
        SqliteDataset(spark, ds.where, create=True)
    assert SqliteDataset(spark, ds.where, create=True, overwrite=True).list_tables() == []


def test_json_lines(spark, tmp_path):
    base = database(tmp_path / "base.db", AUDITED)
    e = Engine(spark)
    b = e.open("sqlite", base)
    tables = {n: b.table(n) for n in b.list_tables()}
    e.write_json(e.dump(b), tables, str(tmp_path / "json"))
    assert sorted(json.loads(r[0])["table"] for r in spark.read.text(str(tmp_path / "json")).collect()) == ["pairs", "simple", "simple", "simple"]


PG = Table(
    "simple",
    (
        Column("fid", "integer", "integer", True, True, True), Column("geom", "geometry", "geometry(Point,4326)", geometry=Geometry("POINT", 4326)), Column("na'\"me", "text", "text"),
        Column("num", "double", "double precision"), Column("at", "datetime", "timestamp without time zone"), Column("ok", "boolean", "boolean"), Column("raw", "blob", "bytea"),
    ),
    Crs(4326, "EPSG", 4326),
)


def test_server_statements(spark):
    ds = JdbcDataset(spark, "jdbc:postgresql://nowhere/x", "my")
    assert ds.create_sql(PG) == (
        'CREATE TABLE "my"."simple" ("fid" serial NOT NULL, "geom" geometry(POINT, 4326), "na\'""me" text, "num" double precision, "at" timestamp, "ok" boolean, "raw" bytea, PRIMARY KEY ("fid"))'
    )
    assert ds.select_sql(PG).startswith('SELECT "fid", ST_AsBinary("geom") AS "geom", "na\'""me", "num", to_char("at", \'YYYY-MM-DD"T"HH24:MI:SS.US"Z"\') AS "at"')
    (seq,) = ds.sequence_sql(PG)
    assert 'max("fid")' in seq and "pg_get_serial_sequence('\"my\".\"simple\"', 'fid')" in seq and "setval" in seq
    assert ds.schema_sql(True) == ['DROP SCHEMA IF EXISTS "my" CASCADE', 'CREATE SCHEMA IF NOT EXISTS "my"']
    with pytest.raises(RowsyncError):
        ds.create_sql(Table("x", (Column("a", "text"),)))
    row = {"op": "update", "fid": 2} | {f"{p}_{c}": None for c in PG.others for p in ("old", "new")} | {f"changed_{c}": c in ("geom", "num") for c in PG.others} | {"old_num": 0.1, "new_geom": POINT}
    sql, values = rowwise.statement(PG, ds.target("simple"), row, lambda c: ds.marker(PG, c), "IS NOT DISTINCT FROM")
    assert sql == (
        'UPDATE "my"."simple" SET "geom" = ST_GeomFromWKB(decode(?, \'hex\'), 4326), "num" = CAST(? AS double precision) WHERE "fid" IS NOT DISTINCT FROM CAST(? AS integer) '
        'AND "geom" IS NOT DISTINCT FROM ST_GeomFromWKB(decode(?, \'hex\'), 4326) AND "num" IS NOT DISTINCT FROM CAST(? AS double precision)'
    )
    assert [ds.value(c, v) for c, v in zip(placed(PG, row), values, strict=True)] == [POINT[8:].hex(), None, "2", None, "0.1"]
    assert [ds.value(PG.columns[k], v) for k, v in ((5, True), (6, b"\x01\xff"), (2, "a'b"))] == ["true", "01ff", "a'b"]


def test_server_rows_become_blobs_and_text(spark):
    wkb = POINT[8:]
    df = spark.sql("SELECT 1 AS fid, X'" + wkb.hex() + "' AS geom, 'a' AS `na'\"me`, CAST(1.5 AS DECIMAL(10, 3)) AS num, '2021-04-01T15:00:00.000000Z' AS at, true AS ok, X'01' AS raw")
    got = JdbcDataset(spark, "jdbc:postgresql://nowhere/x").decoded(df, PG).first()
    assert (got["fid"], bytes(got["geom"]), got["num"], got["at"], got["ok"]) == (1, POINT, 1.5, "2021-04-01T15:00:00.000000Z", True)
