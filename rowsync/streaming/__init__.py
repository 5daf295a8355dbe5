"""Changes that arrive as a stream of Parquet files with ``seq``: each micro-batch is merged and applied as one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.apply import apply
from ..operators.changes import concat


def apply_stream(spark: SparkSession, changes_dir: str, schema: T.StructType, dataset, table: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Apply every change frame that comes to ``changes_dir``; entries of a key are folded in order of ``seq`` first.

    The batch's number is kept in the commit, so a batch that is run again after a failure isn't applied twice.
    """

    def run(batch: DataFrame, number: int) -> None:
        done = int(dataset.keys.get("__batch", ["-1"])[0])
        if number <= done or batch.isEmpty():
            return
        nothing = batch.where(F.lit(False))
        folded = concat([nothing, batch], keys)
        dataset.write({table: apply(dataset.scan(table), folded, keys)}, {"__batch": [str(number)]})

    stream = spark.readStream.schema(schema).parquet(changes_dir)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
