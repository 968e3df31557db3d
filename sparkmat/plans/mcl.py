"""Markov clustering: expansion, inflation, pruning, for a set number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmat.matrix import SparseMatrix
from sparkmat.operators import rows
from sparkmat.operators.algebra import TINY, inflate, normalize, prune, set_self_loops
from sparkmat.operators.multiply import spgemm
from sparkmat.shared import drop_tables, scratch, stored, write_table


def mcl(a: SparseMatrix, iterations: int = 10, tolerance: float = 0.01, power: float = 2.0, axis: str = "i", normalize_right: bool = False, self_loops: bool = False, strategy: str = "auto") -> tuple[SparseMatrix, list[tuple[int, int]]]:
    """The matrix after all rounds, and (entries after inflation, entries after pruning) of each.

    Rows (``i``) are normalised before the first round; the right operand of
    the first product is normalised only with ``normalize_right``.  There is no
    test for convergence, and pruned rows aren't normalised again.  Each round
    writes its product, which is read for its sums and for its entries, and what
    pruning leaves of it into the shared folder: the plan stays short, both
    operands of the next product read the same table, and a lost executor
    repeats no round; a round's tables are dropped once the next one is written.
    Rows of a large product (``rows.is_large``) are inflated and pruned where
    they are summed, and only what is left of them is written.
    """
    if self_loops:
        a = set_self_loops(a)
    a = a.with_df(stored(a.df, "operand"))  # normalised and multiplied
    left = normalize(a, axis)
    right = left if normalize_right else a
    sizes: list[tuple[int, int]] = []
    before = None
    for _ in range(iterations):
        with scratch() as keep:
            x, y = rows.operands(left, right)
            if axis == "i" and rows.is_large(x, y):
                table = keep(write_table(rows.product_rows(x, y, *rows.pruned(power, tolerance, TINY)), "mcl"))
                sizes.append(tuple(table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("js")), F.lit(0))).first()))
                out = rows.entries(table)
            else:
                product = a.with_df(write_table(spgemm(x, y, strategy).df, "product"))
                out = table = keep(write_table(prune(inflate(product, power, axis), tolerance).df, "mcl"))
                sizes.append((product.nnz(), table.count()))
        drop_tables(before)
        before = table
        left = right = a.with_df(out)
    return left, sizes


def trace(a: SparseMatrix, sizes: list[tuple[int, int]]) -> DataFrame:
    """(iter, nnz, nnz_pruned) of a run."""
    return a.df.sparkSession.createDataFrame([(k, n, p) for k, (n, p) in enumerate(sizes)], "iter long, nnz long, nnz_pruned long")
