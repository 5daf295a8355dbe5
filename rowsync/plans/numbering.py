"""Row numbers over a whole table without a single task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def numbered(df: DataFrame, order: list, name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with 1, 2, 3, ... in ``order`` (total, so that results repeat): sorted ranges, offset by their sizes.

    The ranges are written once, each row with its range and its place there, and both counted and numbered from the
    files: two jobs would choose different range bounds, for these are sampled. The driver gets one number for each
    partition.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", at)
    ranged = stored(ranged.withColumn("__part", F.shiftright("__at", 33).cast("int")).withColumn("__place", F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at"), "ranges")
    sizes = sorted(tuple(r) for r in ranged.groupBy("__part").count().collect())  # a row for each partition
    before = accumulate([0, *(c for _, c in sizes)])
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "__p int, __before long")
    return ranged.join(F.broadcast(offsets), F.col("__part") == F.col("__p")).withColumn(name, F.col("__before") + F.col("__place") + 1).drop("__part", "__place", "__p", "__before")
