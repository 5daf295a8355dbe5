"""Datasets of Parquet tables in numbered versions: a manifest names each version's folders.

A commit writes the changed tables to a new folder, then creates the next manifest; creating it fails if another commit
was first, so a version is all there or not at all. Everything goes through Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..model import ConflictError, RowsyncError, Table, TableFilter
from ..schema import table_of


class ParquetDataset:
    """``keys``: the key columns of each table; a table without any takes part in nothing but reading.

    Where the folder has no manifest, its ``<table>.parquet`` files or folders are version 0.
    """

    def __init__(self, spark: SparkSession, where: str, keys: dict[str, list[str]] | None = None, tables: TableFilter = TableFilter()):
        self.spark, self.where, self.filter = spark, where.rstrip("/"), tables
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.version, self.paths, stored = self._latest()
        self.keys = stored | (keys or {})

    def _latest(self) -> tuple[int, dict[str, str], dict]:
        root = self._path(self.where)
        if not self.fs.exists(root):
            return 0, {}, {}
        names = [s.getPath().getName() for s in self.fs.listStatus(root)]
        versions = [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]
        if not versions:
            return 0, {n.removesuffix(".parquet"): f"{self.where}/{n}" for n in names if n.endswith(".parquet")}, {}
        got = json.loads(self.spark.read.text(f"{self.where}/manifest-{max(versions)}.json", wholetext=True).first()[0])
        return max(versions), {t: f"{self.where}/{p}" if "/" not in p[:1] and "://" not in p else p for t, p in got["tables"].items()}, got["keys"]

    def list_tables(self) -> list[str]:
        return sorted(t for t in self.paths if self.filter.takes(t))

    def scan(self, name: str) -> DataFrame:
        if name not in self.paths:
            raise RowsyncError(f"there is no table {name} in {self.where}")
        return self.spark.read.parquet(self.paths[name])

    def table(self, name: str) -> Table:
        return table_of(name, self.scan(name).schema, self.keys.get(name, []))

    def write(self, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None) -> int:
        """Commit new contents of some tables as the next version; ConflictError if another commit came first."""
        folder = f"data-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.where}/{folder}/{name}.parquet")
        mine = {t: p.removeprefix(f"{self.where}/") for t, p in self.paths.items()} | {t: f"{folder}/{t}.parquet" for t in tables}
        text = json.dumps({"tables": mine, "keys": self.keys | (keys or {})})
        try:
            out = self.fs.create(self._path(f"{self.where}/manifest-{self.version + 1}.json"), False)
        except Exception as e:
            raise ConflictError(f"version {self.version + 1} of {self.where} was committed by another writer") from e
        out.write(bytearray(text.encode()))
        out.close()
        self.version, self.paths, self.keys = self._latest()
        return self.version
