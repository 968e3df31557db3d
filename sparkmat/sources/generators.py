"""Stencil matrices, prolongation and restriction operators of multigrid solvers, test bands.

All are made from ``spark.range`` and exploded offsets; each row costs the
same, whatever the size, and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product
from math import prod

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sparkmat.matrix import SparseMatrix

STENCILS = {"3pt": 1, "5pt": 2, "9pt": 2, "7pt": 3, "27pt": 3}


def _weight(kind: str, offset: tuple[int, ...]) -> float | None:
    """The value at an offset; None where the stencil has no entry."""
    moved = sum(o != 0 for o in offset)
    if kind in ("3pt", "5pt", "7pt"):
        return 2.0 * len(offset) if moved == 0 else -1.0 if moved == 1 else None
    if kind == "9pt":
        return {0: 8.0, 1: -2.0, 2: -1.0}[moved]
    return {0: 26.0, 1: -4.0}.get(moved, -1.0)


def _coordinates(index: Column, sizes: tuple[int, ...]) -> list[Column]:
    """The grid coordinates of an index, the first one fastest."""
    out, rest = [], index
    for n in sizes:
        out.append(rest % n)
        rest = F.floor(rest / F.lit(n))
    return out


def _neighbours(spark: SparkSession, out_sizes: tuple[int, ...], in_sizes: tuple[int, ...], offsets: list[tuple[tuple[int, ...], float]], centre: Callable[[Column], Column]) -> SparseMatrix:
    """Rows over one grid, columns at offsets from ``centre`` of the row's coordinates in another, where those lie in it."""
    d = len(out_sizes)
    table = F.array(*[F.struct(*[F.lit(o).cast("long").alias(f"o{k}") for k, o in enumerate(off)], F.lit(float(v)).alias("v")) for off, v in offsets])
    df = spark.range(prod(out_sizes)).withColumn("e", F.explode(table))
    at = [centre(c) + F.col(f"e.o{k}") for k, c in enumerate(_coordinates(F.col("id"), out_sizes))]
    df = df.select(F.col("id").alias("i"), *[c.alias(f"c{k}") for k, c in enumerate(at)], F.col("e.v").alias("v"))
    for k in range(d):
        df = df.where((F.col(f"c{k}") >= 0) & (F.col(f"c{k}") < in_sizes[k]))
    j = F.lit(0).cast("long")
    for k in reversed(range(d)):
        j = j * in_sizes[k] + F.col(f"c{k}")
    return SparseMatrix(df.select("i", j.alias("j"), "v"), prod(out_sizes), prod(in_sizes))


def stencil(spark: SparkSession, kind: str, *sizes: int) -> SparseMatrix:
    """The ``3pt``, ``5pt``, ``9pt``, ``7pt`` or ``27pt`` stencil on a grid of these sizes."""
    if STENCILS.get(kind) != len(sizes):
        raise ValueError(f"stencil {kind!r} doesn't take {len(sizes)} sizes")
    offsets = [(off, w) for off in product((-1, 0, 1), repeat=len(sizes)) if (w := _weight(kind, off)) is not None]
    return _neighbours(spark, sizes, sizes, offsets, lambda c: c)


def restriction(spark: SparkSession, *sizes: int) -> SparseMatrix:
    """From the grid of 2n - 1 points in each direction to that of n; rows at the border aren't rescaled."""
    fine = tuple(2 * n - 1 for n in sizes)
    offsets = [(off, 0.5 ** (sum(o != 0 for o in off) + len(sizes))) for off in product((-1, 0, 1), repeat=len(sizes))]
    return _neighbours(spark, sizes, fine, offsets, lambda c: c * 2)


def prolongation(spark: SparkSession, *sizes: int) -> SparseMatrix:
    """From the grid of n points in each direction to that of 2n - 1, by linear interpolation."""
    fine = tuple(2 * n - 1 for n in sizes)
    df = spark.range(prod(fine))
    coords = _coordinates(F.col("id"), fine)
    weight, j, names = F.lit(1.0), F.lit(0).cast("long"), []
    for k, c in enumerate(coords):
        low, odd = F.floor(c / F.lit(2)), c % 2
        df = df.withColumn(f"c{k}", F.explode(F.sequence(low, low + odd)))
        weight = weight * F.when(odd == 1, F.lit(0.5)).otherwise(F.lit(1.0))
        names.append(f"c{k}")
    for k in reversed(range(len(sizes))):
        j = j * sizes[k] + F.col(names[k])
    return SparseMatrix(df.select(F.col("id").alias("i"), j.alias("j"), weight.alias("v")), prod(fine), prod(sizes))


def banded(spark: SparkSession, n: int, modulus: int, remainder: int, axis: str = "i", right: bool = True) -> SparseMatrix:
    """A band whose rows (``i``) or columns (``j``) have entries only where index % modulus = remainder.

    Line x has x + 1 entries if x < n / 2, else n - x, beginning at its own
    place and going right, or ending at the last place and going left.
    """
    length = F.when(F.col("id") < n / 2, F.col("id") + 1).otherwise(F.lit(n) - F.col("id"))
    first = F.col("id") if right else F.lit(n) - length
    df = spark.range(n).where(F.col("id") % modulus == remainder).select(
        F.col("id").alias("x"), F.explode(F.sequence(first, F.least(first + length - 1, F.lit(n - 1).cast("long")))).alias("y"), F.lit(1.0).alias("v")
    )
    x, y = ("i", "j") if axis == "i" else ("j", "i")
    return SparseMatrix(df.select(F.col("x").alias(x), F.col("y").alias(y), "v").select("i", "j", "v"), n, n)


def file_name(kind: str, sizes: tuple[int, ...], nrows: int, ncols: int, nnz: int, transposed: bool = False) -> str:
    """A descriptive name of a generated matrix's file."""
    shape = "x".join(map(str, sizes))
    return f"{kind}_{len(sizes)}D_{shape}_{nrows}x{ncols}_nnz{nnz}{'_T' if transposed else ''}.mtx"
