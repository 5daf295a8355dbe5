"""What small tables hide: numbering over many rows, storage on a cluster."""

import pytest
from pyspark.sql import functions as F

from rowsync.model import RowsyncError, UnsupportedError
from rowsync.operators import diff as d
from rowsync.operators import rebase as rb
from rowsync.plans import storage
from rowsync.plans.numbering import numbered


def test_numbers_of_many_shuffled_rows_are_unique_and_gapless(spark):
    n = 2_000_000
    df = spark.range(0, n, 1, 16).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("k"), "id")
    got = numbered(df, ["k", "id"], "i", 7)
    a = got.agg(F.count("i"), F.countDistinct("i"), F.min("i"), F.max("i")).first()
    assert tuple(a) == (n, n, 1, n)
    pairs = got.select(F.col("i"), "k", "id").alias("a").join(got.select((F.col("i") - 1).alias("j"), F.col("k").alias("k2"), F.col("id").alias("id2")), F.col("i") == F.col("j"))
    assert pairs.where("k > k2 OR (k = k2 AND id > id2)").isEmpty()


def test_a_million_colliding_inserts_get_a_million_keys(spark):
    n = 1_000_000
    ours = storage.stored(d.dump(spark.range(0, n, 1, 12).select((F.col("id") * 7 % n).alias("fid"), F.lit("a").alias("v")), ["fid"]))
    got = rb.key_mapping(ours, ours, "fid")
    assert tuple(got.agg(F.count("*"), F.countDistinct("new_key"), F.min("new_key"), F.max("new_key")).first()) == (n, n, n, 2 * n - 1)
    assert got.where(F.col("new_key") != F.col("old_key") + n).isEmpty()


def test_numbering_nothing(spark):
    assert numbered(spark.range(0), ["id"], "i").count() == 0


class Conf(dict):
    set = dict.__setitem__


class FakeSession:
    def __init__(self, master, **conf):
        self.conf, self.sparkContext = Conf(conf), type("C", (), {"master": master})


def test_a_folder_of_one_machine_is_refused_on_a_cluster():
    with pytest.raises(RowsyncError):
        storage.shared_dir(FakeSession("spark://x:7077", **{"spark.sql.warehouse.dir": "file:/tmp/warehouse"}))
    assert storage.shared_dir(FakeSession("spark://x:7077", **{"spark.sql.warehouse.dir": "hdfs://x/w"})) == "hdfs://x/w"
    assert storage.shared_dir(FakeSession("spark://x:7077", **{"spark.checkpoint.dir": "/mnt/shared/"})) == "/mnt/shared"


def test_stored_tables_are_in_the_applications_folder(spark):
    path = storage.stored(spark.range(3)).inputFiles()[0]
    assert spark.sparkContext.applicationId in path


def test_names_of_the_change_frame_are_no_keys(spark):
    t = spark.range(3).withColumnRenamed("id", "op")
    with pytest.raises(UnsupportedError):
        d.diff(t, t, ["op"])
    with pytest.raises(UnsupportedError):
        d.dump(t, ["op"])
