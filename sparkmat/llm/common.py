"""What the operators of this subpackage share: tables in the shared folder, text access, running aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmat.shared import drop_tables, scratch, shared_dir, write_bucketed, write_table

__all__ = ["drop_tables", "packed", "running", "scratch", "shared_dir", "small_batches", "table", "unpacked", "write_bucketed", "write_table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that pass between the JVM and Python at once, where texts pass; Spark's own default is 10,000.
BATCH_ROWS, DEFAULT_ROWS = "1000", "10000"


def small_batches(spark: SparkSession) -> None:
    """Lets rows with texts pass to Python by BATCH_ROWS, unless the session has a number of its own.

    Buffers of a batch lie outside of the heap and are kept by the JVM and by
    Python once they have been needed, so large batches stay in an executor's
    memory for as long as it lives.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, DEFAULT_ROWS) == DEFAULT_ROWS:
        spark.conf.set(key, BATCH_ROWS)


#: The struct of columns that an operator carries along without knowing them.
OTHERS = "other_columns"


def packed(rows: DataFrame, own: list, without: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` as the columns ``own`` and a struct OTHERS of all columns but those ``without``, so that none can clash with an operator's own names."""
    others = [F.col(f"`{c}`") for c in rows.columns if c not in without] or [F.lit(0).alias("none")]
    return rows.select(*own, F.struct(*others).alias(OTHERS))


def unpacked(columns: list[str], **new: Column) -> list[Column]:
    """What selects ``columns`` from rows that ``packed`` has made, but for those that are ``new``."""
    return [new[c].alias(c) if c in new else F.col(f"{OTHERS}.`{c}`").alias(c) for c in columns]


def running(rows: DataFrame, group: str, order: list[str], scans: dict[str, Callable[[str], Column]]) -> DataFrame:
    """``rows`` with each column of ``scans`` replaced by its running F.sum or F.bit_xor within ``group`` (no nulls) in the order given.

    Rows are dealt by ranges of (group, order), so a very large group lies in
    many ranges.  Each range is scanned on its own; the totals of a group's
    ranges (a row each) are scanned and added.
    """
    dealt = write_table(rows.repartitionByRange(group, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(group, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(group, "_p").agg(*(f(c).alias(f"_{c}") for c, f in scans.items()))
    totals = totals.select(group, "_p", *(F.coalesce(f(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c, f in scans.items()))
    local = dealt.withColumns({c: f(c).over(own) for c, f in scans.items()})
    both = {c: F.col(c) + F.col(f"_{c}") if f is F.sum else F.col(c).bitwiseXOR(F.col(f"_{c}")) for c, f in scans.items()}
    return local.join(totals, [group, "_p"]).withColumns(both).select(rows.columns)
