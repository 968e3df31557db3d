"""Pointers, tiles, masks, validation, statistics and checksums of coordinate matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmat.matrix import SparseMatrix
from sparkmat.shared import write_table


def running_sum(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Inclusive prefix sums over the whole table in a total order, without gathering it in one task.

    Rows are dealt by ranges of the order; the sums of the ranges (one row
    each) are scanned, and every range adds what lies before it.
    """
    dealt = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    dealt = write_table(dealt, "ranges")  # partition numbers must not change between the two uses
    own = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = dealt.groupBy("_p").agg(F.sum(value).alias("_t"))
    before = totals.withColumn("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return dealt.withColumn(out, F.sum(value).over(own)).join(before.select("_p", "_b"), "_p").withColumn(out, F.col(out) + F.col("_b")).drop("_p", "_b")


def ranked(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """The row's number, from 1, in a total order."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", out).drop("_one")


def axis_counts(a: SparseMatrix, axis: str = "i") -> DataFrame:
    """(axis, n) for every index of the axis, empty ones with 0."""
    size = a.nrows if axis == "i" else a.ncols
    counts = a.df.groupBy(axis).agg(F.count("*").alias("n"))
    every = a.df.sparkSession.range(size).select(F.col("id").alias(axis))
    return every.join(counts, axis, "left").select(axis, F.coalesce("n", F.lit(0)).alias("n"))


def pointers(a: SparseMatrix, axis: str = "i") -> DataFrame:
    """(axis, ptr): where each row (``i``) or column (``j``) ends in the compressed layout."""
    return running_sum(axis_counts(a, axis), [axis], "n", "ptr").select(axis, "ptr")


def counts_of_pointers(ptr: DataFrame, axis: str = "i") -> DataFrame:
    """(axis, n) from end pointers: each less the one before (an equi-join on the index, not a window over all rows)."""
    before = ptr.select((F.col(axis) + 1).alias(axis), F.col("ptr").alias("_b"))
    return ptr.join(before, axis, "left").select(axis, (F.col("ptr") - F.coalesce("_b", F.lit(0))).alias("n"))


def check_pointers(ptr: DataFrame, nnz: int, axis: str = "i") -> DataFrame:
    """One row about end pointers (axis, ptr): how many, those below the one before or below 0, and whether the last is ``nnz``."""
    before = ptr.select((F.col(axis) + 1).alias(axis), F.col("ptr").alias("_b"))
    return ptr.join(before, axis, "left").agg(
        F.count("*").alias("n_ptr"),
        F.count_if(F.col("ptr") < F.coalesce("_b", F.lit(0))).alias("n_decreasing"),
        F.coalesce(F.max_by("ptr", axis) == nnz, F.lit(nnz == 0)).alias("ends_at_nnz"),
    )


def owners(ptr: DataFrame, positions: DataFrame, axis: str = "i", block: int = 4096) -> DataFrame:
    """(pos, axis): the row or column whose segment holds each position, from end pointers; positions outside have no row.

    Segments and positions meet by blocks of positions, an equi-join; a segment
    is in as many blocks as it spans.
    """
    before = ptr.select((F.col(axis) + 1).alias(axis), F.col("ptr").alias("_b"))
    held = ptr.join(before, axis, "left").select(axis, F.coalesce("_b", F.lit(0)).alias("_b"), F.col("ptr").alias("_e")).where("_b < _e")
    spanned = held.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_b") / F.lit(block)), F.floor((F.col("_e") - 1) / F.lit(block)))))
    asked = positions.select("pos", F.floor(F.col("pos") / F.lit(block)).alias("_block"))
    return asked.join(spanned, "_block").where("pos >= _b AND pos < _e").select("pos", axis)


def element_range(a: SparseMatrix, first: int, end: int) -> SparseMatrix:
    """The entries with places first .. end - 1 (from 0) in the order of rows and columns."""
    return a.with_df(ranked(a.df, ["i", "j"], "_n").where((F.col("_n") > first) & (F.col("_n") <= end)))


def row_blocks(a: SparseMatrix, blocks: int) -> DataFrame:
    """(block, n_rows, nnz): rows dealt to blocks by the remainder of their index, as a 1D layout does."""
    return a.df.groupBy((F.col("i") % blocks).alias("block")).agg(F.count_distinct("i").alias("n_rows"), F.count("*").alias("nnz"))


def exclusive_pointers(a: SparseMatrix, axis: str = "i") -> DataFrame:
    """(axis, ptr): where each row or column begins."""
    return running_sum(axis_counts(a, axis), [axis], "n", "ptr").select(axis, (F.col("ptr") - F.col("n")).alias("ptr"))


def compressed_rows(a: SparseMatrix, axis: str = "i") -> DataFrame:
    """(axis, entries): the entries of each row or column that has any, sorted by the other index.

    A row is one record here; ``segments.segmented`` bounds the length of records.
    """
    other = "j" if axis == "i" else "i"
    return a.df.groupBy(axis).agg(F.array_sort(F.collect_list(F.struct(other, "v"))).alias("entries"))


def flattened(rows: DataFrame, axis: str = "i") -> DataFrame:
    """The entries of compressed rows again, with their place in the row."""
    other = "j" if axis == "i" else "i"
    return rows.select(axis, F.posexplode("entries").alias("pos", "e")).select(axis, F.col("pos").cast("long").alias("pos"), F.col(f"e.{other}").alias(other), F.col("e.v").alias("v"))


def tiles(a: SparseMatrix, rows: int, columns: int, slices: int = 1) -> DataFrame:
    """The entries with tile_r, tile_c, slice and the indices within the slice and tile; block sizes are rounded up."""
    h = -(-a.nrows // (rows * slices)) or 1
    w = -(-a.ncols // columns) or 1
    return a.df.withColumns({
        "tile_r": F.floor(F.col("i") / F.lit(h * slices)),
        "slice": F.floor(F.col("i") / F.lit(h)) % slices,
        "tile_c": F.floor(F.col("j") / F.lit(w)),
        "local_i": F.col("i") % h,
        "local_j": F.col("j") % w,
    })


def tile_nnz(a: SparseMatrix, rows: int, columns: int, slices: int = 1) -> DataFrame:
    return tiles(a, rows, columns, slices).groupBy("tile_r", "slice", "tile_c").agg(F.count("*").alias("nnz"))


def tile_balance(a: SparseMatrix, rows: int, columns: int, slices: int = 1) -> DataFrame:
    """One row: tiles with entries, their largest and total number of entries, and largest over mean of all tiles."""
    n = rows * columns * slices
    return tile_nnz(a, rows, columns, slices).agg(
        F.count("*").alias("n_tiles"),
        F.max("nnz").alias("max_nnz"),
        F.sum("nnz").alias("total_nnz"),
        (F.max("nnz") * n / F.sum("nnz")).alias("imbalance"),
    )


def nonempty(a: SparseMatrix, axis: str = "j") -> DataFrame:
    """(k): indices of the axis that have entries."""
    return a.df.select(F.col(axis).alias("k")).distinct()


def packed_mask(keys: DataFrame, bits: int = 8) -> DataFrame:
    """(word, mask): the keys as bits, ``bits`` to a word, lowest first."""
    return keys.groupBy(F.floor(F.col("k") / F.lit(bits)).alias("word")).agg(F.expr(f"CAST(bit_or(shiftleft(1, CAST(k % {bits} AS int))) AS bigint)").alias("mask"))


def masks_intersected(a: DataFrame, b: DataFrame) -> DataFrame:
    """(word, mask) of the bits that both have; words without any are left out."""
    return a.join(b.select("word", F.col("mask").alias("_m")), "word").select("word", F.col("mask").bitwiseAND(F.col("_m")).alias("mask")).where("mask <> 0")


def selected(a: SparseMatrix, keys: DataFrame, axis: str = "j") -> SparseMatrix:
    """The entries whose index of the axis is among ``keys`` (k)."""
    return a.with_df(a.df.join(keys.select(F.col("k").alias(axis)), axis, "left_semi"))


def reduced_operands(a: SparseMatrix, b: SparseMatrix) -> tuple[SparseMatrix, SparseMatrix]:
    """A and B without the entries that meet nothing in A B."""
    return selected(a, nonempty(b, "i"), "j"), selected(b, nonempty(a, "j"), "i")


def validate(a: SparseMatrix) -> DataFrame:
    """One row of counts: entries out of range, repeated keys, NaN and infinite values."""
    repeated = a.df.groupBy("i", "j").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_repeated"))
    bad = a.df.agg(
        F.count("*").alias("nnz"),
        F.count_if((F.col("i") < 0) | (F.col("i") >= a.nrows)).alias("n_bad_row"),
        F.count_if((F.col("j") < 0) | (F.col("j") >= a.ncols)).alias("n_bad_col"),
        F.count_if(F.isnan("v")).alias("n_nan"),
        F.count_if(F.abs("v") == F.lit(float("inf"))).alias("n_inf"),
    )
    return bad.crossJoin(repeated)  # one row each


def info(a: SparseMatrix) -> DataFrame:
    """One row: dimensions, entries, density in percent, mean, most and fewest entries of a row, empty ones counted."""
    return axis_counts(a, "i").agg(
        F.lit(a.nrows).cast("long").alias("nrows"),
        F.lit(a.ncols).cast("long").alias("ncols"),
        F.sum("n").alias("nnz"),
        (F.sum("n") * 100.0 / (float(a.nrows) * a.ncols)).alias("density"),
        F.avg("n").alias("avg_row"),
        F.max("n").alias("max_row"),
        F.min("n").alias("min_row"),
    )


#: Fixed values of the checksum.
CHECKSUM_FACTOR, CHECKSUM_OFFSET = 1099511628211, 1469598103934665603


def checksum(a: SparseMatrix) -> DataFrame:
    """One row ``checksum`` (text): an order-free sum modulo 2**64 over indices and single-precision value bits.

    No built-in function gives the bits of a float, so Java's is called by
    reflection, a call an entry, outside of generated code.
    """
    bits = F.expr("CAST(reflect('java.lang.Float', 'floatToRawIntBits', CAST(v AS float)) AS bigint) & 4294967295")
    keyed = a.df.select(F.shiftleft("i", 40).bitwiseXOR(F.shiftleft("j", 16)).alias("_k"), bits.alias("_b"))
    term = F.expr("pmod(CAST(CAST(_k ^ _b AS decimal(20, 0)) * 1099511628211 AS decimal(38, 0)), 18446744073709551616)")
    total = keyed.withColumn("_t", term.cast("decimal(28,0)")).agg(F.sum("_t").alias("_s"))
    return total.select(F.expr(f"CAST(pmod(coalesce(_s, 0) + {CHECKSUM_OFFSET}, 18446744073709551616) AS decimal(20, 0))").cast("string").alias("checksum"))
