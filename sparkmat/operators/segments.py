"""Compressed rows in segments of bounded length.

A row of very many entries is several segments, so none is a large record:
(i, segment, start, first, last, idx, val), with the place of its first entry in
the whole matrix, its least and greatest column, and its columns and values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmat.matrix import SparseMatrix
from sparkmat.operators.layout import exclusive_pointers, ranked

LENGTH = 1024


def segmented(a: SparseMatrix, length: int = LENGTH) -> DataFrame:
    """The segments of all rows that have entries, in order of columns; none is longer than ``length``."""
    placed = ranked(a.df, ["i", "j"], "_rank").join(exclusive_pointers(a, "i"), "i")
    place = F.col("_rank") - 1 - F.col("ptr")
    dealt = placed.withColumn("segment", F.floor(place / F.lit(length)).cast("long")).withColumn("_at", F.col("_rank") - 1)
    rows = dealt.groupBy("i", "segment").agg(F.min("_at").alias("start"), F.array_sort(F.collect_list(F.struct("j", "v"))).alias("_e"))
    return rows.select("i", "segment", "start", F.col("_e")[0]["j"].alias("first"), F.element_at("_e", -1)["j"].alias("last"), F.col("_e.j").alias("idx"), F.col("_e.v").alias("val"))


def entries(rows: DataFrame) -> DataFrame:
    """(i, pos, j, v): the entries again, with their place in their row."""
    heads = rows.where("segment = 0").select("i", F.col("start").alias("_row"))
    flat = rows.join(heads, "i").select("i", (F.col("start") - F.col("_row")).alias("_p"), F.posexplode(F.arrays_zip("idx", "val")).alias("_k", "_e"))
    return flat.select("i", (F.col("_p") + F.col("_k")).cast("long").alias("pos"), F.col("_e.idx").alias("j"), F.col("_e.val").alias("v"))


def product_with_vector(rows: DataFrame, x: DataFrame) -> DataFrame:
    """(i, v) of A x for x (j, x); missing values of x are 0, rows that meet nothing are left out."""
    flat = rows.select("i", F.explode(F.arrays_zip("idx", "val")).alias("_e")).select("i", F.col("_e.idx").alias("j"), F.col("_e.val").alias("v"))
    return flat.join(x.select("j", "x"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def lookup(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(i, j, v) of the asked (i, j) that are entries; a segment is opened only for columns within its bounds."""
    met = asked.select("i", "j").join(rows, "i").where("j BETWEEN first AND last")
    at = F.array_position("idx", F.col("j"))
    return met.withColumn("_p", at).where("_p > 0").select("i", "j", F.element_at("val", F.col("_p").cast("int")).alias("v"))
