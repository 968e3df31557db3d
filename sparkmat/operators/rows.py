"""Large products row by row: what is asked of a row of C is made where the row is summed.

Operands of more than LARGE_NNZ entries are stored once in buckets of their
contraction index; counts, packing and the join of what meets read them without
a further shuffle.  The entries of A of an index and of a block of rows travel
to the block with the row of B that they meet, packed, once; so a block is sent
each row of B once however many of its entries need it.  There numpy gathers
and sums the products of one row of C after another and gives each to a
``finish``: the row itself, a digest of it, what pruning leaves of it.  C is
neither exploded nor written for that.
"""

from __future__ import annotations

import math
import weakref
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmat.matrix import SparseMatrix
from sparkmat.operators import multiply
from sparkmat.shared import drop_tables, is_there, stored, with_settings, write_bucketed

#: Entries of both operands beyond which a product is made in this way.
LARGE_NNZ = 4_000_000
#: Multiplications of one block of rows: each block is sent the rows of B that it needs, so few large ones shuffle less.
BLOCK_WORK = 64_000_000
#: Entries of B that a block holds at once; beyond that its sums so far are made first.
HELD_NNZ = 2**25

#: The table of each stored frame in buckets of its columns' indices.
_INDEXED: weakref.WeakKeyDictionary[DataFrame, DataFrame] = weakref.WeakKeyDictionary()

#: Makes of whole rows (i, j, v), sorted, the columns that are asked for.
Finish = Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, pa.Array]]


def starts_of_rows(i: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(i, prepend=i[0] - 1))


def lists(starts: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), pa.array(values, kind))


def whole_rows(ncols: int, pieces: bool = True) -> tuple[Finish, str]:
    """Rows as they are, in pieces of at most PIECE entries or a record each."""
    index = multiply._index_type(ncols)
    kind, piece = pa.int32() if index == "int" else pa.int64(), multiply.PIECE

    def finish(i, j, v):
        starts = np.flatnonzero((np.diff(i, prepend=i[0] - 1) != 0) | (np.arange(len(i)) % piece == 0)) if pieces else starts_of_rows(i)
        return {"i": pa.array(i[starts], pa.int64()), "js": lists(starts, len(i), j, kind), "vs": lists(starts, len(i), v, pa.float64())}

    return finish, f"i long, js array<{index}>, vs array<double>"


def digests() -> tuple[Finish, str]:
    """(i, n, s, sj): a row's entries, their sum and their sum by columns."""

    def finish(i, j, v):
        starts = starts_of_rows(i)
        sums = np.add.reduceat(v, starts), np.add.reduceat(v * (j + 1), starts)
        return {"i": pa.array(i[starts], pa.int64()), "n": pa.array(np.diff(np.append(starts, len(i))), pa.int64()), "s": pa.array(sums[0]), "sj": pa.array(sums[1])}

    return finish, "i long, n long, s double, sj double"


def counts() -> tuple[Finish, str]:
    """(n): the entries of some rows, those of a batch in one number."""
    return (lambda i, j, v: {"n": pa.array([len(i)], pa.int64())}), "n long"


def pruned(power: float, tolerance: float, tiny: float) -> tuple[Finish, str]:
    """(i, n, js, vs): of a row of n entries, taken to a power and divided by their sum (0 where that is at most ``tiny``), those of abs(v) > tolerance."""

    def finish(i, j, v):
        starts = starts_of_rows(i)
        v = np.power(v, power)
        n, sums = np.diff(np.append(starts, len(i))), np.add.reduceat(v, starts)
        sums = np.repeat(np.where(sums > tiny, sums, np.inf), n)
        v = v / sums
        kept = np.abs(v) > tolerance
        left = np.append(0, np.cumsum(kept))[starts]
        js, vs = (lists(left, int(kept.sum()), x[kept], kind) for x, kind in ((j, pa.int64()), (v, pa.float64())))
        return {"i": pa.array(i[starts], pa.int64()), "n": pa.array(n, pa.int64()), "js": js, "vs": vs}

    return finish, "i long, n long, js array<long>, vs array<double>"


def entries(rows: DataFrame) -> DataFrame:
    """(i, j, v) of packed rows (i, js, vs)."""
    return rows.select("i", "vs", F.posexplode("js").alias("q", "j")).select("i", F.col("j").cast("long").alias("j"), F.col("vs")[F.col("q")].alias("v"))


def operands(a: SparseMatrix, b: SparseMatrix) -> tuple[SparseMatrix, SparseMatrix]:
    """Both in the shared folder, once where B is A or its transpose."""
    same, mirrored = b.df is a.df, b.df is a.T.df
    a = a.with_df(stored(a.df, "operand"))
    return a, a.with_df(a.df) if same else a.T if mirrored else b.with_df(stored(b.df, "operand"))


def is_large(a: SparseMatrix, b: SparseMatrix) -> bool:
    """Whether ``product_rows`` is to make A B, whose operands are stored."""
    na, nb = a.nnz(), b.nnz()
    return na + nb > LARGE_NNZ and min(na, nb) > multiply.SMALL_SIDE


def product_digests(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    """(i, n, s, sj) of A B, see ``digests``."""
    a, b = operands(a, b)
    return product_rows(a, b, *digests()) if is_large(a, b) else row_digests(multiply.spgemm(a, b))


def product_nnz(a: SparseMatrix, b: SparseMatrix) -> int:
    """The entries of A B, whose operands are stored."""
    return product_rows(a, b, *counts(), values=False).agg(F.sum("n")).first()[0] or 0


def row_digests(m: SparseMatrix) -> DataFrame:
    return m.df.groupBy("i").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * (F.col("j") + 1)).alias("sj"))


def product_rows(a: SparseMatrix, b: SparseMatrix, finish: Finish | None = None, schema: str = "", values: bool = True) -> DataFrame:
    """What ``finish`` makes of the rows of A B (by default ``whole_rows``), whose operands are stored; all entries are 1 without ``values``."""
    if a.ncols != b.nrows:
        raise ValueError(f"shapes {a.nrows}x{a.ncols} and {b.nrows}x{b.ncols} don't fit")
    left, right = _by_index(a, b)
    return sum_rows([(left, right) if values else _ones(left, right)], a.nrows, b.ncols, finish, schema)


def _ones(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    return left.withColumn("a", F.lit(1.0)), right.withColumn("b", F.lit(1.0))


class Grown:
    """A product of operands that grow by disjoint batches (i, j, v, batch): both are stored by the contraction index once for all batches."""

    def __init__(self, a: SparseMatrix, b: SparseMatrix, of_a: DataFrame, of_b: DataFrame):
        n = multiply._meeting_places(a.df, a.nnz() + b.nnz())
        indexed = lambda df, k, x: write_bucketed(df.select(F.col(k).alias("k"), F.col(x).alias("x"), "batch"), "by_index", ["k"], n)
        self.left, self.right, self.nrows, self.ncols = indexed(of_a, "j", "i"), indexed(of_b, "i", "j"), a.nrows, b.ncols

    def nnz(self, batch: int) -> int:
        """The entries of the product of all up to this batch."""
        left, right = (m.where(F.col("batch") <= batch) for m in (self.left, self.right))
        pair = _ones(left.select("k", F.col("x").alias("i")), right.select("k", F.col("x").alias("j")))
        return sum_rows([pair], self.nrows, self.ncols, *counts()).agg(F.sum("n")).first()[0] or 0

    def close(self) -> None:
        drop_tables(self.left, self.right)


def sum_rows(pairs: list[tuple[DataFrame, DataFrame]], nrows: int, ncols: int, finish: Finish | None = None, schema: str = "", height: int | None = None) -> DataFrame:
    """What ``finish`` makes of the rows of the sum of products of pairs (k, i, a) and (k, j, b) in buckets of k; in blocks of ``height`` rows if given."""
    if finish is None:
        finish, schema = whole_rows(ncols)
    sizes = [_sizes(left, right) for left, right in pairs]
    height = height or max(1, math.ceil(nrows / multiply._blocks(pairs[0][0], sum(work for work, _ in sizes), BLOCK_WORK)))
    index = multiply._index_type(ncols)
    met = []  # dealt by block below, so their union needs no partitions of its own
    for (left, right), (_, long) in zip(pairs, sizes):
        if long is not None:  # a row for each PACKED entries at most
            hot_left, hot_right = (m.join(F.broadcast(long), "k", "left_semi") for m in (left, right))
            left, right = (m.join(F.broadcast(long), "k", "left_anti") for m in (left, right))
            met.insert(0, multiply._packed_meetings(hot_left, hot_right, height, multiply._partitions(left), index))
        met.append(_meetings(left, right, height, index))
    each = with_settings(reduce(DataFrame.unionByName, met), multiply.SMALL_BATCHES).repartitionById(max(1, math.ceil(nrows / height)), F.col("t"))
    return each.select("is", "as", "js", "bs").mapInArrow(_rows_of_a_block(ncols, finish), schema)


def row_sketches(a: SparseMatrix, b: SparseMatrix, lg: int) -> DataFrame:
    """(i, _s): a sketch of 2^lg hashes of the columns of each row of A B, whose operands are stored; a block is sent the sketch of a row of B once."""
    left, right = _by_index(a, b)
    blocks = multiply._blocks(left, _sizes(left, right)[0])
    block = F.floor(F.col("i") / F.lit(max(1, math.ceil(a.nrows / blocks)))).cast("int").alias("t")
    cols = left.groupBy("k", block).agg(F.collect_list("i").alias("is"))
    met = cols.hint("merge").join(right.groupBy("k").agg(F.theta_sketch_agg("j", lg).alias("_s")), "k")
    each = met.select("t", "is", "_s").repartitionById(blocks, F.col("t")).select("t", F.explode("is").alias("i"), "_s")
    return each.groupBy("t", "i").agg(F.theta_union_agg("_s", lg).alias("_s")).select("i", "_s")


def row_work(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    """(i, work): the multiplications of each row of A B that takes any, whose operands are stored."""
    left, right = _by_index(a, b)
    return left.join(right.groupBy("k").agg(F.count("*").alias("n")), "k").groupBy("i").agg(F.sum("n").alias("work"))


def _sizes(left: DataFrame, right: DataFrame) -> tuple[int, DataFrame | None]:
    """The multiplications of a pair, and its long indices k, if any."""
    na, nb = left.groupBy("k").agg(F.count("*").alias("na")), right.groupBy("k").agg(F.count("*").alias("nb"))
    met = na.join(nb, "k")
    work, long = met.agg(F.sum(F.col("na") * F.col("nb")), F.count_if(_is_long())).first()
    return work or 0, met.where(_is_long()).select("k") if long else None


def _is_long():
    return F.greatest("na", "nb") > F.lit(multiply.PACKED)


def _by_index(a: SparseMatrix, b: SparseMatrix) -> tuple[DataFrame, DataFrame]:
    """(k, i, a) and (k, j, b) in buckets of k, in one table where B is the transpose of A."""
    n = multiply._meeting_places(a.df, a.nnz() + b.nnz())

    def indexed(m: SparseMatrix) -> DataFrame:
        table = _INDEXED.get(m.df)
        if table is None or not is_there(table) or table.columns[0] != f"k{n}":
            table = _INDEXED[m.df] = write_bucketed(m.df.select(F.col("j").alias(f"k{n}"), F.col("i").alias("x"), "v"), "by_index", [f"k{n}"], n)
        return table.withColumnRenamed(f"k{n}", "k")  # tables of other numbers of buckets don't meet in place

    left, right = indexed(a), indexed(b.T)
    return left.select("k", F.col("x").alias("i"), F.col("v").alias("a")), right.select("k", F.col("x").alias("j"), F.col("v").alias("b"))


def _meetings(left: DataFrame, right: DataFrame, h: int, index: str) -> DataFrame:
    """(t, is, as, js, bs): of each contraction index and block t of ``h`` rows the entries of A, and the row of B; found in place."""
    block = F.floor(F.col("i") / F.lit(h)).cast("int").alias("t")
    cols = left.groupBy("k", block).agg(F.collect_list("i").alias("is"), F.collect_list("a").alias("as"))
    rows = right.groupBy("k").agg(F.collect_list(F.col("j").cast(index)).alias("js"), F.collect_list("b").alias("bs"))
    return cols.hint("merge").join(rows, "k").select("t", "is", "as", "js", "bs")


def spine(spark: SparkSession, nrows: int, height: int) -> DataFrame:
    """(t, i): all rows, in buckets of their range t of ``height`` rows, for ``merged``."""
    return write_bucketed(spark.range(nrows).select(_range_of(F.col("id"), height), F.col("id").alias("i")), "spine", ["t"], max(1, math.ceil(nrows / height)))


def write_ranges(rows: DataFrame, nrows: int, height: int) -> DataFrame:
    """Rows (i, js, vs), each one record and in the task of its range, in the same buckets as ``spine``: (t, i, js, vs)."""
    return write_bucketed(rows.select(_range_of(F.col("i"), height), "i", "js", "vs"), "rows", ["t"], max(1, math.ceil(nrows / height)), dealt=True)


def _range_of(i, height: int):
    return F.floor(i / F.lit(height)).cast("int").alias("t")


def merged(rows: DataFrame, parts: list[DataFrame], ncols: int, finish: Finish, schema: str) -> DataFrame:
    """What ``finish`` makes of the rows of a sum of tables of ``write_ranges``, of which those of a row meet in place."""
    return _met_parts(rows, parts, ["js", "vs"]).mapInArrow(_merged_rows(ncols, finish), schema)


def merged_nnz(rows: DataFrame, parts: list[DataFrame]) -> int:
    """The entries of that sum."""
    return _met_parts(rows, parts, ["js"]).agg(F.sum(F.size(F.array_distinct("js")).cast("long"))).first()[0] or 0


def _met_parts(rows: DataFrame, parts: list[DataFrame], names: list[str]) -> DataFrame:
    # Joined to all rows, not united: Spark 4.1 takes a union of bucketed tables for one in buckets but reads their files one table after another.
    met = with_settings(rows, multiply.IN_PLACE | multiply.SMALL_BATCHES)
    for n, part in enumerate(parts):
        met = met.hint("merge").join(part.select("t", "i", *(F.col(name).alias(f"{name}{n}") for name in names)), ["t", "i"], "left")
    kind = {name: part.schema[name].dataType for part in parts for name in names}
    pieces = lambda name: [F.coalesce(F.col(f"{name}{n}"), F.array().cast(kind[name])) for n in range(len(parts))]
    return met.select("i", *(F.concat(*pieces(name)).alias(name) for name in names))


def _merged_rows(ncols: int, finish: Finish) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, js, vs = (batch.column(c) for c in ("i", "js", "vs"))
            row = np.repeat(np.arange(len(i)), js.value_lengths().to_numpy())
            if len(row):
                row, j, v = multiply._summed_entries(row, js.flatten().to_numpy(), vs.flatten().to_numpy(), ncols)
                columns = finish(i.to_numpy()[row], j, v)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


class _Held:
    """What a block was sent so far: entries of A, each with the place of the row of B that it meets."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, batch: pa.RecordBatch) -> None:
        rows, a, js, bs = (batch.column(c) for c in ("is", "as", "js", "bs"))
        times, lengths = rows.value_lengths().to_numpy(), js.value_lengths().to_numpy().astype(np.int64)
        starts = np.cumsum(lengths) - lengths + self.n
        self.parts.append((rows.flatten().to_numpy(), a.flatten().to_numpy(), np.repeat(starts, times), np.repeat(lengths, times), js.flatten().to_numpy(), bs.flatten().to_numpy()))
        self.n += int(lengths.sum())

    def products(self, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The products (i, j, v) by rows, about ``at_once`` of them at a time."""
        i, a, starts, lengths, js, bs = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.n = [], 0
        order = np.argsort(i, kind="stable")
        i, a, starts, lengths = i[order], a[order], starts[order], lengths[order]
        ends = np.cumsum(lengths)
        at = 0
        while at < len(i):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_once, "right")))
            n = lengths[at:to]
            place = np.repeat(starts[at:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield np.repeat(i[at:to], n), js[place], np.repeat(a[at:to], n) * bs[place]
            at = to


def _rows_of_a_block(ncols: int, finish: Finish) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    at_once, most = multiply.AT_ONCE, HELD_NNZ

    def summed(pieces: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Whole rows with repeated entries summed, from products by rows."""
        held, n, limit = [], 0, at_once
        for piece in pieces:
            held.append(piece)
            n += len(piece[0])
            if n >= limit:
                i, j, v = (np.concatenate(x) for x in zip(*held)) if len(held) > 1 else piece
                last = np.searchsorted(i, i[-1])  # this row may go on
                if last:
                    yield multiply._summed_entries(i[:last], j[:last], v[:last], ncols)
                held = [multiply._summed_entries(i[last:], j[last:], v[last:], ncols)]
                n = len(held[0][0])
                limit = max(at_once, 2 * n)
        if n:
            yield multiply._summed_entries(*(np.concatenate(x) for x in zip(*held)), ncols)

    def parts_by_rows(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        i, j, v = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        order = np.argsort(i, kind="stable")
        for at in range(0, len(i), at_once):
            part = order[at : at + at_once]
            yield i[part], j[part], v[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = _Held(), []
        for batch in batches:
            block.add(batch)
            if block.n > most:
                parts += list(summed(block.products(at_once)))
        if parts and block.n:
            parts += list(summed(block.products(at_once)))
        for rows in summed(parts_by_rows(parts)) if parts else summed(block.products(at_once)) if block.n else ():
            columns = finish(*rows)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run
