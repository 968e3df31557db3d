"""Products over semirings, and closures: shortest, widest and any paths.

A semiring has a sum (an aggregate, associative and commutative, so partial sums
are made before the shuffle), a product of two values, and the value of an empty
path.  A missing entry is the sum's neutral element.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkmat.matrix import SparseMatrix
from sparkmat.shared import drop_tables, write_table


@dataclass(frozen=True)
class Semiring:
    plus: Callable[[Column], Column]
    times: Callable[[Column, Column], Column]
    one: float


SEMIRINGS = {
    "plus_times": Semiring(F.sum, lambda a, b: a * b, 1.0),
    "min_plus": Semiring(F.min, lambda a, b: a + b, 0.0),
    "max_min": Semiring(F.max, F.least, math.inf),
    "or_and": Semiring(F.max, lambda a, b: ((a != 0) & (b != 0)).cast("double"), 1.0),
}


def multiply(a: SparseMatrix, b: SparseMatrix, semiring: str = "plus_times") -> SparseMatrix:
    """C(i, j) = the semiring's sum over k of A(i, k) times B(k, j)."""
    if a.ncols != b.nrows:
        raise ValueError(f"shapes {a.nrows}x{a.ncols} and {b.nrows}x{b.ncols} don't fit")
    ring = SEMIRINGS[semiring]
    left = a.df.select("i", F.col("j").alias("k"), F.col("v").alias("a"))
    right = b.df.select(F.col("i").alias("k"), "j", F.col("v").alias("b"))
    joined = left.join(right, "k")
    return SparseMatrix(joined.groupBy("i", "j").agg(ring.plus(ring.times(F.col("a"), F.col("b"))).alias("v")), a.nrows, b.ncols)


def add(a: SparseMatrix, b: SparseMatrix, semiring: str) -> SparseMatrix:
    """The semiring's sum of two matrices, entry by entry."""
    return a.with_df(a.df.unionByName(b.df).groupBy("i", "j").agg(SEMIRINGS[semiring].plus(F.col("v")).alias("v")))


def closure(a: SparseMatrix, semiring: str) -> SparseMatrix:
    """The best value over all paths of any length from i to j, empty ones too: I + A + A^2 + ..

    Repeated squaring of I + A, each square a table, until one adds nothing: so
    as many products as the logarithm of the longest best path.  ValueError if
    paths keep improving (a cycle of negative cost), or for ``plus_times``.
    """
    if semiring == "plus_times":
        raise ValueError("closures need a sum that gains nothing from repeated paths")
    if a.nrows != a.ncols:
        raise ValueError("closures need a square matrix")
    empty = SparseMatrix.identity(a.df.sparkSession, a.nrows)
    empty = empty.with_df(empty.df.withColumn("v", F.lit(SEMIRINGS[semiring].one)))
    if semiring == "or_and":
        a = a.with_df(a.df.withColumn("v", (F.col("v") != 0).cast("double")).where("v <> 0"))
    known = a.with_df(write_table(add(a, empty, semiring).df, "paths"))
    for _ in range(2 + math.ceil(math.log2(max(2, a.nrows)))):
        squared = a.with_df(write_table(multiply(known, known, semiring).df, "paths"))
        settled = squared.df.join(known.df, ["i", "j", "v"], "left_anti").isEmpty()
        drop_tables(known.df)
        if settled:
            return squared
        known = squared
    raise ValueError("paths keep improving: a cycle of negative cost")
