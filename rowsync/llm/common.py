"""Helpers that the corpus operators share: names of rows, bindings, keyed lookups under skew."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import ship
from ..plans.storage import new_path as new_path
from ..plans.storage import stored as stored

WHITESPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key is heavy when it holds at least one in so many rows, so there are at most this many heavy keys.
HEAVY_SHARE = 1000


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, also where ``body`` uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only. Text without other letters takes the short way."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


#: Bytes of rows that go to Python at once, where the session doesn't say. Spark's own default is by rows alone, however long.
BATCH_BYTES = 6 << 20


def prepare(spark: SparkSession) -> None:
    """Make a session ready for Python stages: this package on the executors, batches of bounded size."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def row_keys(*cols: Column) -> tuple[Column, Column]:
    """128 bits that name a row by its values, nulls told apart by their places; rows with equal values share them."""
    nulls = reduce(lambda a, b: a + b, [F.when(c.isNull(), 1 << k).otherwise(0) for k, c in enumerate(cols)])
    return F.xxhash64(nulls, *cols), F.xxhash64(F.lit(7), nulls, *cols)


def skew_lookup(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int, values: list[str], spread: Column) -> DataFrame:
    """``left`` LEFT JOIN ``right`` on long columns ``on``, unique in ``right``, where a key may hold most of ``left``.

    ``right[count]`` is the number of rows of ``left`` (or about as many) with the key. Keys with one in HEAVY_SHARE of
    ``total`` rows, at most HEAVY_SHARE of them, are looked up by broadcast; the others by shuffle, and rows already
    answered are dealt out by ``spread`` there.
    """
    heavy = right.where(F.col(count) * HEAVY_SHARE >= F.lit(total)).select(*[F.col(k).alias(f"__h_{k}") for k in on], *[F.col(v).alias(f"__h_{v}") for v in values], F.lit(True).alias("__heavy"))
    light = right.where(F.col(count) * HEAVY_SHARE < F.lit(total)).select(*[F.col(k).alias(f"__l_{k}") for k in on], *[F.col(v).alias(f"__l_{v}") for v in values], F.lit(True).alias("__light"))
    cond = [F.col(k) == F.col(f"__h_{k}") for k in on]
    j = left.join(F.broadcast(heavy), cond, "left").withColumn("__k", F.when(F.col("__heavy"), F.xxhash64(F.lit(11), spread)).otherwise(F.col(on[0])))
    cond = [F.col("__k") == F.col(f"__l_{on[0]}")] + [F.col(k) == F.col(f"__l_{k}") for k in on[1:]]
    j = j.join(light, cond, "left")
    out = [F.when(F.col("__heavy"), F.col(f"__h_{v}")).otherwise(F.col(f"__l_{v}")).alias(v) for v in values]
    return j.select(*left.columns, *out, F.coalesce("__heavy", "__light", F.lit(False)).alias("__found"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of two longs that may be sent to all executors: 16 MB or so.
SENDABLE = 500_000


def without(df: DataFrame, keys: tuple[Column, Column], gone: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``keys`` (row_keys) are not in ``gone(k1, k2)``. Few keys are broadcast, more are joined by shuffle."""
    gone = stored(gone.select(F.col("k1").alias("__g1"), F.col("k2").alias("__g2")).distinct(), "gone")
    side = F.broadcast(gone) if gone.count() <= SENDABLE else gone
    return df.join(side, (keys[0] == F.col("__g1")) & (keys[1] == F.col("__g2")), "left_anti")

