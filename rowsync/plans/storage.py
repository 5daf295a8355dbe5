"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..model import RowsyncError


def _is_shared(path: str) -> bool:
    return "://" in path and not path.startswith("file:")


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset: on one machine a temporary folder; on a cluster the warehouse, if it lies in a shared store.
    Anything else would be a folder of one machine, which the others don't see, and is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("rowsync.shared.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir", "")
        if spark.sparkContext.master.startswith("local"):
            found = f"file://{tempfile.mkdtemp(prefix='rowsync-')}"
        elif not _is_shared(found):
            raise RowsyncError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("rowsync.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A new path in this application's folder, which goes when the application ends."""
    sc = spark.sparkContext
    root = f"{shared_dir(spark)}/rowsync/{sc.applicationId}"
    known = getattr(sc, "_rowsync_roots", set())
    if root not in known:
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        sc._rowsync_roots = known | {root}
    return f"{root}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later work starts from the files, whoever is lost."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
