"""Coordinate inserts as a stream: each micro-batch is summed into an accumulated matrix.

``summed_stream`` keeps the sums in Spark's state store, by (i, j): a batch
costs what it changes, not the size of the matrix.  The entries that a batch
changed go to a folder of its own; the matrix is the last value of each entry
(``current``).  ``accumulate`` writes the whole matrix after each batch, for
readers that want it in one folder, and keeps the last two.

In both, the batch's number names its folder, so a batch that is run again after
a failure writes the same folder and counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkmat.matrix import SCHEMA, SparseMatrix
from sparkmat.shared import delete_path, with_settings

#: State in RocksDB, of which each batch stores its changes; one bound of memory for all of an executor's stores.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def updates_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """A stream of coordinate rows from the Parquet files of a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def accumulate(stream: DataFrame, state: str, checkpoint: str, start: SparseMatrix, on_batch: Callable[[SparseMatrix, int], None] | None = None) -> StreamingQuery:
    """Starts a query that adds every micro-batch to the matrix under ``state``; ``on_batch`` sees each new state."""

    def merge(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        base = start.df if batch == 0 else spark.read.schema(SCHEMA).parquet(f"{state}/batch={batch - 1}")
        summed = base.unionByName(rows.select("i", "j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
        summed.write.mode("overwrite").parquet(f"{state}/batch={batch}")
        if batch > 1:  # a failed batch is run again from the one before
            delete_path(spark, f"{state}/batch={batch - 2}")
        if on_batch:
            on_batch(SparseMatrix(spark.read.schema(SCHEMA).parquet(f"{state}/batch={batch}"), start.nrows, start.ncols), batch)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summed_stream(stream: DataFrame, changes: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that sums the stream's entries (i, j, v) in the state store and writes each batch's changed entries under ``changes``.

    The store is RocksDB, which keeps sums on the machine's disk: its memory
    doesn't grow with the matrix, as that of Spark's default store does.
    State and progress lie in ``checkpoint``, in the shared folder or any other
    that all machines see: a query that starts again with both goes on where it
    stopped.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.select("i", "j", "v").write.mode("overwrite").parquet(f"{changes}/batch={batch}")

    summed = with_settings(stream, ON_DISK).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return summed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, changes: str, nrows: int, ncols: int) -> SparseMatrix:
    """The matrix after the last batch: each entry's last value."""
    rows = spark.read.schema(f"{SCHEMA}, batch BIGINT").parquet(changes)
    return SparseMatrix(rows.groupBy("i", "j").agg(F.max_by("v", "batch").alias("v")), nrows, ncols)


def compact(spark: SparkSession, changes: str) -> int:
    """Rewrites all changes but the last batch's as one folder of their last values; returns its batch.  For a query that isn't running."""
    from sparkmat.shared import write_table

    rows = spark.read.schema(f"{SCHEMA}, batch BIGINT").parquet(changes)
    last = rows.agg(F.max("batch")).first()[0] or 0
    if last < 2:
        return last
    merged = write_table(rows.where(F.col("batch") < last).groupBy("i", "j").agg(F.max_by("v", "batch").alias("v")), "changes")
    merged.write.mode("overwrite").parquet(f"{changes}/batch={last - 1}")
    for batch in range(last - 1):
        delete_path(spark, f"{changes}/batch={batch}")
    return last - 1
