"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (a, b, n): 128 hash bits of a line's key, bucketed by them and sorted, and the number of documents
that hold it. The documents' lines are counted by batches; each batch is anti-joined with the keys that the runs already
know to be frequent, and the rest is written as a run of level 0; when a level has ``fanout`` runs they are merged into
one of the next level. All runs have the same buckets, so joining and merging them moves no run through the network.
Documents then lose every line whose key is frequent in the merged runs.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HEAVY_SHARE, WHITESPACE, lower_ascii, new_path, row_keys, skew_lookup, stored, table, text_or_empty

#: Text that a batch holds, and least and most batches; with more text than that, batches grow.
BATCH_TEXT, LEAST_BATCHES, MOST_BATCHES = 256 << 30, 4, 16
#: Text whose lines a bucket of a run holds, and least buckets.
BUCKET_TEXT, LEAST_BUCKETS = 1 << 30, 8


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(WHITESPACE)))


def _hashed(line: Column) -> Column:
    key = line_key(line)
    return F.when(key != "", F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b")))


def count_lines(texts: DataFrame, *by: str) -> DataFrame:
    """(by, a, b, n): in how many rows of ``texts(by, text)`` each key is; empty keys are left out."""
    found = F.filter(F.transform(lines(text_or_empty("text")), _hashed), lambda x: x.isNotNull())
    return texts.select(*by, F.explode(F.array_distinct(found)).alias("k")).groupBy(*by, F.col("k.a").alias("a"), F.col("k.b").alias("b")).agg(F.count("*").alias("n"))


class LineRuns:
    """Runs of line hashes in the shared folder, by level: a partition each of one table that is bucketed by the hashes.

    One table, so that Spark reads all runs' parts of a bucket in one task. ``close`` drops its name in the session's
    catalog, after which nothing can be read from it.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 4, buckets: int = LEAST_BUCKETS):
        if fanout < 2:
            raise ValueError("a level is merged from two runs at least")
        self.spark, self.min_docs, self.fanout, self.buckets, self.total = spark, min_docs, fanout, buckets, 0
        self.levels: list[list[int]] = [[]]
        self.name, self.path, self.n_runs = f"rowsync_lines_{uuid.uuid4().hex}", new_path(spark, "line-runs"), 0

    def _write(self, df: DataFrame, level: int) -> None:
        out = df.select("a", "b", "n", F.lit(self.n_runs).alias("run")).write.partitionBy("run").bucketBy(self.buckets, "a", "b").sortBy("a", "b")
        out.option("path", self.path).mode("append").saveAsTable(self.name, format="parquet")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self.n_runs)
        self.n_runs += 1

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def merged(self, runs: list[int] | None = None) -> DataFrame | None:
        """(a, b, n) over some runs, or all."""
        runs = [r for level in self.levels for r in level] if runs is None else runs
        if not runs:
            return None
        return self.spark.table(self.name).where(F.col("run").isin(runs)).groupBy("a", "b").agg(F.sum("n").alias("n"))

    def add(self, counts: DataFrame) -> None:
        """Drop from a batch's ``counts(a, b, n)`` what the runs have settled, add the rest as a run, compact.

        A key that the runs already hold ``min_docs`` times needs no further entry, except where this batch alone shows
        it to be very frequent: such entries stay so that later lookups know the heavy keys.
        """
        counts = counts.select("a", "b", "n").repartition(self.buckets, "a", "b")
        known = self.merged()
        if known is not None:
            settled = known.where(F.col("n") >= self.min_docs).select(F.col("a").alias("sa"), F.col("b").alias("sb"))
            counts = counts.join(settled, (F.col("a") == F.col("sa")) & (F.col("b") == F.col("sb")), "left").where(F.col("sa").isNull() | (F.col("n") * HEAVY_SHARE >= F.lit(self.total))).select("a", "b", "n")
        self._write(counts, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._write(self.merged(runs), level + 1)
            level += 1
        self.total = self.merged().agg(F.sum("n")).first()[0] or 0

    def frequent(self) -> DataFrame:
        """(a, b, n) of the keys that at least ``min_docs`` documents hold."""
        found = self.merged()
        return found.where(F.col("n") >= self.min_docs) if found is not None else self.spark.createDataFrame([], "a long, b long, n long")


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, n_batches: int | None = None) -> DataFrame:
    """Drop, in every document, the lines whose key at least ``min_docs`` documents hold.

    Returns ``row`` (the input row, any columns), ``n_lines``, ``n_dropped``, ``kept_text``. A null text is one empty
    line. Lines with an empty key always stay. Repeated rows count as documents of their own. An empty table gives an
    empty one. Rows are dealt into batches by their hash, whatever files they come from; the counts of all batches are
    one job, so texts are read twice, not once a batch.
    """
    spark = df.sparkSession
    k1, k2 = row_keys(F.col(id_col), F.col(text_col))
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_batches = n_batches or min(MOST_BATCHES, max(LEAST_BATCHES, math.ceil(size / BATCH_TEXT)))
    path = new_path(spark, "line-counts")
    count_lines(df.select(F.pmod(k2, F.lit(n_batches)).cast("int").alias("batch"), F.col(text_col).alias("text")), "batch").write.partitionBy("batch").parquet(path)
    counts = spark.read.schema("a long, b long, n long, batch int").parquet(path)
    runs = LineRuns(spark, min_docs, buckets=max(LEAST_BUCKETS, math.ceil(size / BUCKET_TEXT)))
    for k in range(n_batches):
        runs.add(counts.where(F.col("batch") == k))
    frequent = stored(runs.frequent(), "frequent")
    runs.close()
    docs = df.select(F.struct("*").alias("row"), text_or_empty(text_col).alias("text"), k1.alias("k1"), k2.alias("k2"))
    each = docs.select("k1", "k2", F.posexplode(F.transform(lines(F.col("text")), _hashed)).alias("pos", "k")).where(F.col("k").isNotNull()).select("k1", "k2", "pos", "k.a", "k.b")
    hit = skew_lookup(each, frequent, ["a", "b"], "n", max(runs.total, 1), ["n"], F.struct("k1", "pos")).where("__found")
    dropped = hit.groupBy(F.col("k1").alias("d1"), F.col("k2").alias("d2")).agg(F.collect_set("pos").alias("gone"))
    j = docs.join(dropped, (F.col("k1") == F.col("d1")) & (F.col("k2") == F.col("d2")), "left")
    all_lines = lines(F.col("text"))
    n = F.size(all_lines)
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone")), lambda i: F.get(F.col("__lines"), i)), "\n"))
    return j.withColumn("__lines", all_lines).select("row", F.size("__lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text")).withColumn("n_dropped", F.greatest("n_dropped", F.lit(0).cast("long")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT d.doc_id, u.i AS pos, u.line,
         lower_key AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(d.ls) AS line, generate_subscripts(d.ls, 1) AS i) u,
       LATERAL (SELECT translate(regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key) k
), hot AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, (count(hot.key))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN hot.key IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '')) AS kept_sha256
FROM l LEFT JOIN hot ON l.key = hot.key GROUP BY l.doc_id
"""
