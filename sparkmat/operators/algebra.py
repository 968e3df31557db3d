"""Sparse addition, scaling, pruning, normalisation, inflation, self loops, permutation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmat.matrix import SparseMatrix

#: Sums at most this large normalise to 0.
TINY = 1e-20


def add(a: SparseMatrix, b: SparseMatrix, alpha: float = 1.0, beta: float = 1.0) -> SparseMatrix:
    """alpha A + beta B; entries stay where values cancel."""
    left = a.df.withColumn("v", F.lit(float(alpha)) * F.col("v"))
    right = b.df.withColumn("v", F.lit(float(beta)) * F.col("v"))
    return SparseMatrix(left.unionByName(right).groupBy("i", "j").agg(F.sum("v").alias("v")), max(a.nrows, b.nrows), max(a.ncols, b.ncols))


def add_all(parts: list[SparseMatrix]) -> SparseMatrix:
    """The sum of several matrices in one aggregation."""
    df = parts[0].df
    for p in parts[1:]:
        df = df.unionByName(p.df)
    return SparseMatrix(df.groupBy("i", "j").agg(F.sum("v").alias("v")), max(p.nrows for p in parts), max(p.ncols for p in parts))


def prune(a: SparseMatrix, tolerance: float) -> SparseMatrix:
    """Entries with abs(v) > tolerance."""
    return a.with_df(a.df.where(F.abs("v") > F.lit(float(tolerance))))


def axis_sums(a: SparseMatrix, axis: str = "i") -> DataFrame:
    """(axis, s): sums of the rows (``i``) or columns (``j``) that have entries."""
    return a.df.groupBy(axis).agg(F.sum("v").alias("s"))


def scale(a: SparseMatrix, factors: DataFrame, axis: str = "j", factor: str = "s") -> SparseMatrix:
    """Each entry times its row's or column's factor; entries without one are dropped."""
    return a.with_df(a.df.join(factors.select(axis, F.col(factor).alias("_f")), axis).withColumn("v", F.col("v") * F.col("_f")))


def normalize(a: SparseMatrix, axis: str = "i") -> SparseMatrix:
    """Entries over their row's (``i``) or column's (``j``) sum, 0 where the sum is at most TINY.

    The sums are joined back instead of a window, so a heavy row need not fit one task.
    """
    share = F.when(F.col("s") > F.lit(TINY), F.col("v") / F.col("s")).otherwise(F.lit(0.0))
    return a.with_df(a.df.join(axis_sums(a, axis), axis).withColumn("v", share))


def inflate(a: SparseMatrix, power: float = 2.0, axis: str = "i") -> SparseMatrix:
    """Entries to a power, then normalised."""
    return normalize(a.with_df(a.df.withColumn("v", F.pow("v", F.lit(float(power))))), axis)


def set_self_loops(a: SparseMatrix, value: float = 1.0) -> SparseMatrix:
    """The diagonal replaced or filled in."""
    spark = a.df.sparkSession
    n = min(a.nrows, a.ncols)
    loops = spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(float(value)).alias("v"))
    return a.with_df(a.df.where("i <> j").unionByName(loops))


def arithmetic_permutation(n: int, multiplier: int, shift: int, spark) -> DataFrame:
    """(old, new) with new = (old * multiplier + shift) mod n; the multiplier must have no divisor in common with n."""
    from math import gcd

    if n > 0 and gcd(multiplier, n) != 1:
        raise ValueError("multiplier and size have a common divisor")
    return spark.range(n).select(F.col("id").alias("old"), ((F.col("id") * multiplier + shift) % n).alias("new"))


def random_permutation(n: int, seed: int, spark) -> DataFrame:
    """(old, new) in the order of a seeded hash, without a single-task sort: ranks come from range partitions."""
    from sparkmat.operators.layout import ranked

    return ranked(spark.range(n).select(F.col("id").alias("old"), F.xxhash64("id", F.lit(seed)).alias("_h")), ["_h", "old"], "new").select("old", (F.col("new") - 1).alias("new"))


def permute(a: SparseMatrix, rows: DataFrame | None, columns: DataFrame | None) -> SparseMatrix:
    """Rows and columns renamed by (old, new) tables; None leaves them."""
    df = a.df
    for axis, perm in (("i", rows), ("j", columns)):
        if perm is not None:
            df = df.join(perm.select(F.col("old").alias(axis), F.col("new").alias("_new")), axis).withColumn(axis, F.col("_new")).drop("_new")
    return a.with_df(df)


def inverse(perm: DataFrame) -> DataFrame:
    return perm.select(F.col("new").alias("old"), F.col("old").alias("new"))
