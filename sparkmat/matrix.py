"""The data model: a sparse matrix is a DataFrame of coordinates.

``SparseMatrix`` holds a lazy DataFrame ``(i BIGINT, j BIGINT, v DOUBLE)`` and
its dimensions.  Indices are 0-based; a missing key is 0; an entry exists if it
is stored, even where its value is 0; there are no nulls.  Keys are unique
unless said otherwise (``coalesced`` sums repeated keys).
"""

from __future__ import annotations

import weakref
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "i BIGINT, j BIGINT, v DOUBLE"
_TRANSPOSED: weakref.WeakKeyDictionary[DataFrame, weakref.ref[DataFrame]] = weakref.WeakKeyDictionary()


@dataclass(frozen=True)
class SparseMatrix:
    df: DataFrame
    nrows: int
    ncols: int

    @classmethod
    def of(cls, df: DataFrame, nrows: int | None = None, ncols: int | None = None, row="i", col="j", value="v", coalesce: bool = False) -> SparseMatrix:
        """From any DataFrame with coordinate columns; missing dimensions are the largest index and one."""
        own = df.select(F.col(row).cast("long").alias("i"), F.col(col).cast("long").alias("j"), F.col(value).cast("double").alias("v"))
        if coalesce:
            own = own.groupBy("i", "j").agg(F.sum("v").alias("v"))
        if nrows is None or ncols is None:
            most = own.agg(F.max("i"), F.max("j")).first()
            nrows = nrows if nrows is not None else (most[0] if most[0] is not None else -1) + 1
            ncols = ncols if ncols is not None else (most[1] if most[1] is not None else -1) + 1
        return cls(own, nrows, ncols)

    @classmethod
    def from_entries(cls, spark: SparkSession, entries: list[tuple[int, int, float]], nrows: int, ncols: int) -> SparseMatrix:
        return cls(spark.createDataFrame(entries, SCHEMA), nrows, ncols)

    @classmethod
    def identity(cls, spark: SparkSession, n: int) -> SparseMatrix:
        return cls(spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")), n, n)

    def with_df(self, df: DataFrame) -> SparseMatrix:
        return replace(self, df=df if df.columns == ["i", "j", "v"] else df.select("i", "j", "v"))

    def coalesced(self) -> SparseMatrix:
        return self.with_df(self.df.groupBy("i", "j").agg(F.sum("v").alias("v")))

    def pattern(self) -> SparseMatrix:
        """The same entries, all of value 1."""
        return self.with_df(self.df.withColumn("v", F.lit(1.0)))

    @property
    def T(self) -> SparseMatrix:  # noqa: N802  the usual name of a transpose
        """The transpose; that of the same frame is the same frame while it is in use, so a product of both stores one."""
        known = _TRANSPOSED.get(self.df, lambda: None)()
        if known is None:
            known = self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
            _TRANSPOSED[self.df], _TRANSPOSED[known] = weakref.ref(known), weakref.ref(self.df)
        return SparseMatrix(known, self.ncols, self.nrows)

    def __matmul__(self, other: SparseMatrix) -> SparseMatrix:
        from sparkmat.operators.multiply import spgemm

        return spgemm(self, other)

    def __add__(self, other: SparseMatrix) -> SparseMatrix:
        from sparkmat.operators.algebra import add

        return add(self, other)

    def nnz(self) -> int:
        return self.df.count()

    def entries(self) -> dict[tuple[int, int], float]:
        """All entries, for small matrices."""
        return {(r.i, r.j): r.v for r in self.df.collect()}
