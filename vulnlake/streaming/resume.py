"""Resumable increments: files that came since the last run, keys that are not done yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vulnlake.sources import sinks


def run_increment(spark: SparkSession, source: str, schema: str, ledger: str, checkpoint: str, key: str, work: Callable[[DataFrame], None], file_format: str = "json") -> None:
    """Hand each new row whose key is not in the ledger to work(), once, then enter its key.

    The stream's checkpoint keeps which files were read; the ledger keeps which keys were done, so a key that arrives
    again in another file is skipped.  A batch that fails is given again, work() has to bear that.
    """

    def batch(df: DataFrame, number: int) -> None:
        try:
            done = spark.read.parquet(ledger)
        except Exception as e:  # no ledger yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = spark.createDataFrame([], df.select(key).schema)
        new = sinks.pending(df.dropDuplicates([key]), done, key).persist()
        try:
            work(new)
            sinks.add_to_ledger(new, ledger, key)
        finally:
            new.unpersist()

    stream = spark.readStream.schema(schema).format(file_format).load(source)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(batch).start().awaitTermination()
