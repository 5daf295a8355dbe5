import base64
import json
import sqlite3
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowsync import cli, codec
from rowsync.api import Engine
from rowsync.functions import gpkg
from rowsync.model import ConflictError, RowsyncError, TableFilter
from rowsync.schema import base_type, geometry_details
from rowsync.sources import open_dataset
from rowsync.sources.parquet import ParquetDataset
from rowsync.sources.sqlite import SqliteDataset

BLOB = base64.b64decode("R1AAAeYQAAABAQAAAPBDGq/kSde/+HS2Feb94T8=")


@given(st.integers(0, (1 << 64) - 1))
def test_varint(n):
    raw = codec.put_varint(n)
    assert len(raw) <= 9 and codec.get_varint(raw, 0) == (n, len(raw))


cells = st.one_of(st.none(), st.just(codec.UNCHANGED), st.integers(-(1 << 63), (1 << 63) - 1), st.floats(allow_nan=False), st.text(st.characters(codec="utf-8")), st.binary())


@settings(max_examples=60)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.sampled_from(["insert", "update", "delete"]), st.lists(cells, min_size=2, max_size=2), st.lists(cells, min_size=2, max_size=2))))
def test_codec_round_trip(rows):
    entries = [codec.Entry(t, (True, False), op, [] if op == "insert" else a, [] if op == "delete" else b) for t, op, a, b in rows]
    assert list(codec.decode(b"".join(codec.encode(iter(entries))))) == entries


def test_codec_bytes_and_errors():
    e = codec.Entry("t", (True, False), "update", [1, "a"], [codec.UNCHANGED, None])
    raw = b"".join(codec.encode(iter([e])))
    assert raw == b"T\x02\x01\x00t\x00" + b"\x17\x00" + b"\x01" + struct.pack(">q", 1) + b"\x03\x01a" + b"\x00\x05"
    for cut in (8, 12, len(raw) - 1):
        with pytest.raises(RowsyncError):
            list(codec.decode(raw[:cut]))


def test_gpkg(spark):
    df = spark.createDataFrame([(bytearray(BLOB),), (None,), (bytearray(b"no"),)], "g binary")
    got = [r[0] for r in df.select(gpkg.to_wkb(df.g)).collect()]
    assert bytes(got[0]) == BLOB[8:] and got[1:] == [None, None]
    assert gpkg.with_header(BLOB[8:], 4326) == BLOB
    line = struct.pack("<BII4d", 1, 2, 2, 0.0, 1.0, 2.0, -3.0)
    full = gpkg.with_header(line, 4326)
    assert full[3] == 3 and struct.unpack_from("<4d", full, 8) == (0.0, 2.0, -3.0, 1.0) and full[40:] == line
    assert bytes(spark.createDataFrame([(bytearray(full),)], "g binary").select(gpkg.to_wkb(gpkg.F.col("g"))).first()[0]) == line


def test_types_and_filters():
    assert [base_type(t, "sqlite") for t in ("MEDIUMINT", "varchar(50)", "Double", "POINT", "strange")] == ["integer", "text", "double", "geometry", "text"]
    assert [base_type(t, "postgres") for t in ("numeric(10,3)", "bytea", "citext", "geometry(Point,4326)")] == ["double", "blob", "text", "geometry"]
    assert geometry_details("PointZ", 3) == ("POINT", True, False)
    with pytest.raises(RowsyncError):
        TableFilter(frozenset("a"), frozenset("b"))
    f = TableFilter(skip=frozenset({"lines"}))
    assert [n for n in ("lines", "points", "gpkg_contents", "rtree_x", "sqlite_sequence") if f.takes(n)] == ["points"]


def make(path, rows):
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE simple (fid INTEGER PRIMARY KEY NOT NULL, geometry POINT, name TEXT, rating MEDIUMINT)')
        db.execute("CREATE TABLE audit (note TEXT)")
        db.executemany("INSERT INTO simple VALUES (?, ?, ?, ?)", rows)
    return str(path)


BASE = [(1, BLOB, "feature1", 1), (2, BLOB, "feature2", 2), (3, None, "feature3", 3)]


def content(path):
    with sqlite3.connect(path) as db:
        return db.execute("SELECT * FROM simple ORDER BY fid").fetchall()


def test_sqlite_engine(spark, tmp_path):
    base = make(tmp_path / "base.gpkg", BASE)
    theirs = make(tmp_path / "theirs.gpkg", [*BASE, (4, None, "B", 2)])
    ours = make(tmp_path / "ours.gpkg", [BASE[0], (2, BLOB, "x", 9), BASE[2], (4, None, "A", 1)])
    e = Engine(spark)
    b, o, t = (e.open("sqlite", p) for p in (base, ours, theirs))
    tables = {"simple": b.table("simple")}
    assert b.list_tables() == ["audit", "simple"] and tables["simple"].keys == ["fid"]
    c = e.diff(b, o)
    assert e.summary(c) == [{"table": "simple", "inserts": 1, "updates": 1, "deletes": 0}]
    path = str(tmp_path / "c.diff")
    assert e.save(c, tables, path) == 2 == e.count(e.load(path, tables))
    entries = list(codec.decode(open(path, "rb").read()))
    assert [(x.op, x.old, x.new) for x in entries] == [("insert", [], [4, None, "A", 1]), ("update", [2, codec.UNCHANGED, "feature2", 2], [codec.UNCHANGED, codec.UNCHANGED, "x", 9])]
    doc = json.loads(e.to_json(c, tables))["rowsync"]
    assert {"table": "simple", "type": "update", "changes": [{"column": 0, "old": 2}, {"column": 2, "old": "feature2", "new": "x"}, {"column": 3, "old": 2, "new": 9}]} in doc
    b.copy_to(str(tmp_path / "copy.gpkg"))
    copy = e.open("sqlite", str(tmp_path / "copy.gpkg"))
    e.apply(copy, {n: x.drop("seq") for n, x in e.load(path, tables).items()})
    assert content(copy.where) == content(ours)
    assert not e.has_changes(e.diff(copy, o))
    with pytest.raises(ConflictError):
        e.apply(copy, {n: x.drop("seq") for n, x in e.load(path, tables).items()})
    assert e.rebase(b, o, t) == {}
    assert content(ours) == [BASE[0], (2, BLOB, "x", 9), BASE[2], (4, None, "B", 2), (5, None, "A", 1)]
    assert json.loads(e.schema(b))["rowsync_schema"][1]["columns"][0] == {"name": "fid", "type": "integer", "type_db": "INTEGER", "primary_key": True, "not_null": True, "auto_increment": True}


def test_copy_between_sources(spark, tmp_path):
    base = make(tmp_path / "base.gpkg", BASE)
    e = Engine(spark, skip=["audit"])
    target = ParquetDataset(spark, str(tmp_path / "lake"), tables=e.filter)
    e.copy(e.open("sqlite", base), target)
    assert target.list_tables() == ["simple"] and target.scan("simple").count() == 3 and target.table("simple").keys == ["fid"]
    other = ParquetDataset(spark, str(tmp_path / "lake"))
    target.write({"simple": target.scan("simple").where("fid < 3")})
    with pytest.raises(ConflictError):
        other.write({"simple": other.scan("simple")})
    assert ParquetDataset(spark, str(tmp_path / "lake")).scan("simple").count() == 2
    back = SqliteDataset(spark, str(tmp_path / "new.gpkg"), create=True)
    e.copy(e.open("sqlite", base), back)
    assert content(back.where) == content(base)


def test_foreign_keys_and_triggers(tmp_path, spark):
    path = str(tmp_path / "fk.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE species (fid INTEGER PRIMARY KEY, species_id TEXT UNIQUE)")
        db.execute("CREATE TABLE trees (fid INTEGER PRIMARY KEY, species_id TEXT NOT NULL REFERENCES species (species_id))")
        db.execute("CREATE TRIGGER mine AFTER INSERT ON trees BEGIN SELECT 1; END")
    ds = SqliteDataset(spark, path)
    assert [(f.table, f.column, f.parent, f.parent_column) for f in ds.foreign_keys()] == [("trees", "species_id", "species", "species_id")]
    assert [n for n, _ in ds.triggers()] == ["mine"]


def test_command_line(spark, tmp_path, capsys):
    base, ours = make(tmp_path / "a.db", BASE), make(tmp_path / "b.db", BASE[:2])
    out = str(tmp_path / "x.diff")
    assert cli.main(["diff", base, ours, out]) == 0
    assert cli.main(["as-summary", base, out]) == 0 and "'deletes': 1" in capsys.readouterr().out
    assert cli.main(["invert", base, out, str(tmp_path / "y.diff")]) == 0
    assert cli.main(["apply", ours, str(tmp_path / "y.diff")]) == 0
    assert content(ours) == content(base)
    assert cli.main(["apply", ours, str(tmp_path / "y.diff")]) == 1
    assert cli.main(["drivers"]) == 0 and cli.main(["version"]) == 0
    with pytest.raises(RowsyncError):
        open_dataset(spark, "nothing", "x")


def test_stream(spark, tmp_path):
    from rowsync.operators.diff import diff
    from rowsync.streaming import apply_stream

    s = "k long, v string"
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], s), spark.createDataFrame([(1, "z"), (3, "c")], s)
    ds = ParquetDataset(spark, str(tmp_path / "lake"))
    ds.write({"t": a}, {"t": ["k"]})
    changes = diff(a, b, ["k"])
    changes.write.parquet(str(tmp_path / "in"))
    q = apply_stream(spark, str(tmp_path / "in"), changes.schema, ds, "t", ["k"], str(tmp_path / "check"))
    q.awaitTermination()
    assert sorted(map(tuple, ds.scan("t").collect())) == [(1, "z"), (3, "c")]
