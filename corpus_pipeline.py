"""From raw documents to packed training sequences: each stage rewrites ``documents`` for the next one.

Every function takes (spark, docs, sf_dir). ``run`` writes what a stage returns as Parquet to the folder that the
cluster shares and reads it again for the next stage. An empty table goes through all stages and gives no pieces; columns
that the stages don't know go through all but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsync.llm import language_id, line_dedup, packing, pii, simhash
from rowsync.llm.common import stored, table


def _retexted(out: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The input columns of ``out(row, text)`` with the new text and its length."""
    new = {"text": F.col(text).alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return out.select(*[new.get(c, F.col("row").getField(c).alias(c)) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; each row by itself. Null and empty texts go unless ``lang`` or ``source`` tells."""
    return language_id.keep_identified(docs)


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that at least ten of them hold. Null texts become empty; repeated rows stay."""
    return _retexted(line_dedup.line_dedup(docs), docs.columns, "kept_text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): the least id, a null one last.

    Empty texts are one group. Of rows with equal ids and texts one stays.
    """
    return simhash.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind. Null texts become empty; repeated rows stay."""
    return _retexted(pii.redact(docs), docs.columns, "clean_text")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token sequences; an empty text is its end mark alone, a null id stays null."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_frequent_lines),
    ("near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Packing and fingerprints aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
