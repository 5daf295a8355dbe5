import pytest

from rowsync.model import ConflictError, RowsyncError, UnsupportedError
from rowsync.operators import apply as ap
from rowsync.operators import changes as ch
from rowsync.operators import diff as d
from rowsync.operators import rebase as rb

SCHEMA = "fid long, name string, rating long"
BASE = [(1, "feature1", 1), (2, "feature2", 2), (3, "feature3", 3)]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def change(spark, *rows):
    """(fid, op, old name, old rating, new name, new rating); "." is unchanged."""
    out = [(f, op, None if a == "." else a, None if c == "." else c, not (a == "." and c == "."), None if b == "." else b, None if e == "." else e, not (b == "." and e == ".")) for f, op, a, b, c, e in rows]
    return spark.createDataFrame(out, "fid long, op string, old_name string, new_name string, changed_name boolean, old_rating long, new_rating long, changed_rating boolean")


def I(name, rating):  # noqa: E743
    return (123, "insert", None, None, name, rating)


def D(name, rating):
    return (123, "delete", name, rating, None, None)


def U(a, b, c, e):
    return (123, "update", a, b, c, e)


@pytest.mark.parametrize(
    ("parts", "left"),
    [
        ([I("hello", 5), U("hello", 5, "world", 4)], I("world", 4)),
        ([I("hello", 5), D("hello", 5)], None),
        ([U("hello", 5, "world", 4), U(".", 4, ".", 1)], U("hello", 5, "world", 1)),
        ([U("hello", 5, "world", 4), U("world", 4, "hello", 5)], None),
        ([U("hello", 5, "world", 4), D("world", 4)], D("hello", 5)),
        ([D("world", 4), I("hello", 5)], U("world", 4, "hello", 5)),
        ([D("hello", 5), I("hello", 5)], None),
        ([I("a", 1), I("b", 2), D("c", 3)], D("c", 3)),
        ([D("a", 1), U("a", 1, "b", 2), I("c", 3)], I("c", 3)),
        ([I("a", None), U(".", None, ".", 2)], I("a", 2)),
        ([U("a", 1, None, 1), U(None, ".", "a", ".")], None),
    ],
)
def test_concat_folds_in_order(spark, parts, left):
    out = ch.concat([change(spark, p) for p in parts], ["fid"])
    want = [] if left is None else got(change(spark, left).select(*out.columns))
    assert got(out) == want


def test_concat_keeps_other_keys(spark):
    out = ch.concat([change(spark, I("hello", 5)), change(spark, (456, "update", "a", ".", "b", "."))], ["fid"])
    assert [(r["fid"], r["op"]) for r in out.orderBy("fid").collect()] == [(123, "insert"), (456, "update")]


def test_concat_needs_two(spark):
    with pytest.raises(UnsupportedError):
        ch.concat([change(spark, I("a", 1))], ["fid"])


def test_diff_apply_invert_round_trip(spark):
    base = table(spark, [*BASE, (7, None, None)])
    mod = table(spark, [(1, "feature1", 1), (2, None, 9999), (4, "new", None), (7, None, 0)])
    c = d.diff(base, mod, ["fid"])
    assert got(c.groupBy("op").count()) == [("delete", 1), ("insert", 1), ("update", 2)]
    assert got(ap.apply(base, c, ["fid"])) == got(mod)
    assert got(ap.apply(mod, ch.invert(c), ["fid"])) == got(base)
    assert got(ch.invert(ch.invert(c))) == got(c)
    assert d.diff(base, base, ["fid"]).isEmpty()
    assert got(d.find_modified(base, mod, ["fid"])) == got(c.where("op = 'update'"))


def test_null_keys_are_deleted_and_inserted(spark):
    t = table(spark, [(None, "a", 1)])
    assert got(d.diff(t, t, ["fid"]).select("op")) == [("delete",), ("insert",)]


def test_empty_tables(spark):
    none = table(spark, [])
    assert d.diff(none, none, ["fid"]).isEmpty()
    assert got(d.diff(none, table(spark, BASE), ["fid"])) == got(d.dump(table(spark, BASE), ["fid"]))


def test_key_needed(spark):
    with pytest.raises(UnsupportedError):
        d.diff(table(spark, BASE), table(spark, BASE), [])


def test_datetimes_by_instant(spark):
    s = "k long, t string"
    a = spark.createDataFrame([(1, "2021-04-01T15:00:00Z"), (2, "no time"), (3, "2021-04-01T15:00:00.1230Z"), (4, "x")], s)
    b = spark.createDataFrame([(1, "2021-04-01 15:00:00"), (2, "no time"), (3, "2021-04-01 15:00:00.124"), (4, "y")], s)
    assert got(d.diff(a, b, ["k"], ["t"]).select("k")) == [(3,), (4,)]


def test_apply_conflicts_change_nothing(spark):
    base = table(spark, BASE)
    c = change(spark, (1, "insert", None, None, "x", 1), (2, "update", "other", ".", "y", "."), (3, "delete", "feature3", 4, None, None), (9, "delete", "a", 1, None, None))
    assert got(ap.apply_conflicts(base, c, ["fid"])) == [(1, "insert", "constraint"), (2, "update", "no_change"), (3, "delete", "no_change"), (9, "delete", "no_change")]
    with pytest.raises(ConflictError):
        ap.apply(base, c, ["fid"])
    with pytest.raises(RowsyncError):
        ap.apply(base, c.unionByName(c), ["fid"])


def test_constraints(spark):
    trees = spark.createDataFrame([(1, "MPL"), (2, "OAK"), (3, None), (4, "ELM")], "fid long, species string")
    species = spark.createDataFrame([("MPL",), ("OAK",)], "species_id string")
    assert got(ap.foreign_key_violations(trees, ["species"], species, ["species_id"])) == [(4, "ELM")]
    assert got(ap.unique_violations(table(spark, [(1, "a", 1), (2, "a", 1), (3, None, 1), (4, None, 1)]), ["name"])) == [("a", 2)]
    assert got(ap.null_violations(trees, ["species"])) == [(3, None)]


def three(spark, ours, theirs, base=BASE):
    changes, conflicts = rb.three_way(table(spark, base), table(spark, ours), table(spark, theirs), ["fid"])
    merged = got(ap.apply(table(spark, ours), changes, ["fid"]))
    b_o, b_t = rb.with_seq(d.diff(table(spark, base), table(spark, ours), ["fid"]), ["fid"]), d.diff(table(spark, base), table(spark, theirs), ["fid"])
    r = rb.rebase(b_o, b_t, ["fid"])
    assert merged == got(ap.apply(table(spark, theirs), r.changes.drop("seq"), ["fid"]))  # both ways agree
    return merged, got(conflicts)


def edited(name="feature2", rating=2):
    return [BASE[0], (2, name, rating), BASE[2]]


@pytest.mark.parametrize(
    ("ours", "theirs", "merged", "conflicts"),
    [
        (edited(name="feature222"), edited(rating=222), edited("feature222", 222), []),
        (edited("feature222", 222), edited("feature222", 222), edited("feature222", 222), []),
        (edited("feature2A", 20), edited("feature2B", 21), edited("feature2A", 20), [(2, "name", "feature2", "feature2B", "feature2A"), (2, "rating", "2", "21", "20")]),
        (edited("feature2A", 222), edited("feature2B", 222), edited("feature2A", 222), [(2, "name", "feature2", "feature2B", "feature2A")]),
        ([*BASE, (4, "A", 1)], [*BASE, (4, "B", 2)], [*BASE, (4, "B", 2), (5, "A", 1)], []),
        ([*BASE, (4, "A", 1), (5, "A", 2)], [*BASE, (4, "B", 1), (5, "B", 2), (6, "B", 3)], [*BASE, (4, "B", 1), (5, "B", 2), (6, "B", 3), (7, "A", 1), (8, "A", 2)], []),
        (BASE[:2], BASE[1:], [BASE[1]], []),
        (edited("x"), [BASE[0], BASE[2]], [BASE[0], BASE[2]], [(2, "name", "feature2", None, "x")]),
        ([BASE[0], BASE[2]], edited("x"), [BASE[0], BASE[2]], []),
        (BASE, edited("x"), edited("x"), []),
        (edited("x"), BASE, edited("x"), []),
    ],
)
def test_three_way(spark, ours, theirs, merged, conflicts):
    assert three(spark, ours, theirs) == (sorted(merged), conflicts)


def test_mapping_equals_one_by_one(spark):
    import random

    rng = random.Random(3)
    for _ in range(6):
        theirs, ours = rng.sample(range(1, 15), rng.randint(1, 6)), rng.sample(range(1, 18), rng.randint(1, 9))
        made = lambda keys: d.dump(table(spark, [(k, "a", 1) for k in keys]), ["fid"])
        free, want = max(theirs) + 1, {}
        for k in sorted(ours):
            if k in theirs:
                want[k], free = free, free + 1
        for k in sorted(ours):
            if k not in theirs and k in want.values():
                want[k], free = free, free + 1
        got_map = {r["old_key"]: r["new_key"] for r in rb.key_mapping(rb.with_seq(made(ours), ["fid"]), made(theirs), "fid").collect()}
        assert got_map == want, (theirs, ours)


def test_rebase_rejects_composite_and_text_keys(spark):
    t = spark.createDataFrame([("a", 1)], "k string, v long")
    c = d.dump(t, ["k"])
    with pytest.raises(UnsupportedError):
        rb.rebase(c, c, ["k"])
