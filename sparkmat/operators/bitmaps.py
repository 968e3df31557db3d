"""Sets of indices as bitmaps in buckets of fixed size, made, merged and tested by built-in functions.

A bucket holds 32,768 indices in 4 KB.  Bitmaps of partitions merge before the
shuffle, so a set is exchanged as at most 4 KB for each of its buckets, however
often its indices occur; a semi-join needs the buckets and not the rows of the
other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmat.matrix import SparseMatrix

#: Buckets of 4 KB that are sent to every executor at most (32 MB); beyond that buckets meet rows by a join on their number.
BROADCAST_BUCKETS = 8_192


def bitmaps(keys: DataFrame, column: str = "k") -> DataFrame:
    """(bucket, bits) of the values of a column of whole numbers from 0; nulls are left out."""
    some = keys.where(F.col(column).isNotNull())
    return some.groupBy(F.bitmap_bucket_number(column).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("bits"))


def union(*sets: DataFrame) -> DataFrame:
    """The bitmaps of all indices of any of the sets."""
    rows = sets[0]
    for other in sets[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """The bitmaps of the indices that both sets hold; buckets without any are left out."""
    both = a.unionByName(b).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("_n"))
    return both.where((F.col("_n") == 2) & (F.bitmap_count("bits") > 0)).drop("_n")


def sizes(sets: DataFrame) -> DataFrame:
    """(bucket, n): how many indices each bucket holds."""
    return sets.select("bucket", F.bitmap_count("bits").alias("n"))


def holds(bits: Column | str, key: Column | str) -> Column:
    """Whether a bucket's bits hold an index of this bucket."""
    position = F.bitmap_bit_position(key)
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def selected(a: SparseMatrix, sets: DataFrame, axis: str = "j") -> SparseMatrix:
    """The entries whose index of the axis is in the set."""
    few = sets.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS
    rows = a.df.withColumn("bucket", F.bitmap_bucket_number(axis)).join(F.broadcast(sets) if few else sets, "bucket")
    return a.with_df(rows.where(holds("bits", axis)))


def reduced_operands(a: SparseMatrix, b: SparseMatrix) -> tuple[SparseMatrix, SparseMatrix]:
    """A and B without the entries that meet nothing in A B; what is exchanged is bitmaps of their contraction indices."""
    both = intersection(bitmaps(a.df, "j"), bitmaps(b.df, "i"))
    return selected(a, both, "j"), selected(b, both, "i")
