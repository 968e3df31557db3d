"""Matrix Market files, coordinate and array, and coordinate Parquet.

An array file has a value a line, column by column, so what a line means is its
number: values are counted split by split, and each split's offset is the sum of
those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmat.matrix import SparseMatrix


def read_mtx(spark: SparkSession, path: str) -> SparseMatrix:
    """A coordinate or array matrix: real, integer or pattern (values 1), general, symmetric or skew-symmetric.

    Of an array, which holds the lower triangle only unless it is general,
    the values that aren't 0 are entries.

    Lines are read in parallel; only the banner and the line of dimensions, the
    first that isn't a comment, reach the driver.  A folder written by
    ``write_mtx`` is read like one file.
    """
    lines = spark.read.text(path).select(
        F.trim("value").alias("line"),
        F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("n")).alias("at"),
    )
    head = lines.where("line <> ''").agg(
        F.min_by("line", F.when(~F.col("line").startswith("%"), F.col("at"))).alias("dims"),
        F.min_by("line", F.when(F.col("line").startswith("%%MatrixMarket"), F.col("at"))).alias("banner"),
        F.min(F.when(~F.col("line").startswith("%"), F.col("at"))).alias("at"),
    ).first()
    if head is None or head.dims is None:
        raise ValueError(f"no dimensions in {path}")
    nrows, ncols = (int(x) for x in head.dims.split()[:2])
    words = (head.banner or "%%MatrixMarket matrix coordinate real general").lower().split()
    array = words[2:3] == ["array"]
    if words[2:3] not in (["coordinate"], ["array"]) or (array and words[3:4] == ["pattern"]) or len(words) < 5 or words[3] not in ("real", "integer", "pattern") or words[4] not in ("general", "symmetric", "skew-symmetric"):
        raise ValueError(f"not read: {head.banner}")
    first = F.struct(F.lit(head["at"][0]).alias("file_path"), F.lit(head["at"][1]).cast("long").alias("file_block_start"), F.lit(head["at"][2]).cast("long").alias("n"))
    body = lines.where("line <> '' AND NOT startswith(line, '%')").where(F.col("at") != first)
    if array:
        df = _array_entries(numbered(body), nrows, words[4])
    else:
        parts = body.select(F.split("line", r"\s+").alias("p"))
        value = F.lit(1.0) if words[3] == "pattern" else F.col("p")[2].cast("double")
        df = parts.select((F.col("p")[0].cast("long") - 1).alias("i"), (F.col("p")[1].cast("long") - 1).alias("j"), value.alias("v"))
    if words[4] != "general":
        sign = -1.0 if words[4] == "skew-symmetric" else 1.0
        df = df.unionByName(df.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("v") * sign).alias("v")))
    return SparseMatrix(df, nrows, ncols)


def numbered(lines: DataFrame) -> DataFrame:
    """``lines`` (line, at) with their ``number`` from 0 over all files by name: each split counts its own, and offsets of splits (a row each) are added."""
    split = lines.select("line", F.col("at.file_path").alias("_file"), F.col("at.file_block_start").alias("_block"), F.col("at.n").alias("_n"))
    order = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = split.groupBy("_file", "_block").agg(F.count("*").alias("_c")).select("_file", "_block", F.coalesce(F.sum("_c").over(order), F.lit(0)).alias("_before"))
    own = split.withColumn("_own", F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_n")))
    return own.join(offsets, ["_file", "_block"]).select("line", (F.col("_own") - 1 + F.col("_before")).alias("number"))


def _array_entries(lines: DataFrame, nrows: int, symmetry: str) -> DataFrame:
    """(i, j, v) from the numbered values of an array: down the columns, of a triangle from the diagonal (or below it) on."""
    n = F.lit(nrows)
    if symmetry == "general":
        i, j = F.pmod("number", n), F.floor(F.col("number") / n)
        return lines.select(i.cast("long").alias("i"), j.cast("long").alias("j"), F.col("line").cast("double").alias("v")).where("v <> 0")
    below = 1 if symmetry == "skew-symmetric" else 0
    # column j begins at j * m - j * (j - 1) / 2, with m values in the first one
    m = F.lit(nrows - below)
    begins = lambda c: c * m - F.floor(c * (c - 1) / 2)
    guess = F.floor(((2 * m + 1) - F.sqrt((2 * m + 1) * (2 * m + 1) - 8 * F.col("number").cast("double"))) / 2).cast("long")
    at = lines.withColumn("_g", F.greatest(F.lit(0), guess))
    at = at.withColumn("j", F.when(begins(F.col("_g")) > F.col("number"), F.col("_g") - 1).when(begins(F.col("_g") + 1) <= F.col("number"), F.col("_g") + 1).otherwise(F.col("_g")))  # rounding of the root
    row = F.col("number") - begins(F.col("j")) + F.col("j") + below
    return at.select(row.cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("line").cast("double").alias("v")).where("v <> 0")


def write_array(a: SparseMatrix, path: str) -> None:
    """A general array file in parts: every cell of the matrix, down the columns, written in parallel."""
    spark = a.df.sparkSession
    head = spark.createDataFrame([(-2, "%%MatrixMarket matrix array real general"), (-1, f"{a.nrows} {a.ncols}")], "place long, value string")
    places = a.df.select((F.col("j") * a.nrows + F.col("i")).alias("place"), "v")
    cells = spark.range(a.nrows * a.ncols).withColumnRenamed("id", "place").join(places, "place", "left")
    body = cells.select("place", F.format_string("%.16e", F.coalesce("v", F.lit(0.0))).alias("value"))
    head.unionByName(body).orderBy("place").select("value").write.mode("overwrite").text(path)


def write_mtx(a: SparseMatrix, path: str, single_file: bool = False) -> None:
    """Text parts that, joined in the order of their names, are one Matrix Market file sorted by row and column.

    The parts are written in parallel from ranges of the order; ``single_file``
    puts all into one part, for matrices that one task can write.
    """
    spark = a.df.sparkSession
    nnz = a.df.count()
    head = spark.createDataFrame([(-2, 0, "%%MatrixMarket matrix coordinate real general"), (-1, 0, f"{a.nrows} {a.ncols} {nnz}")], "i long, j long, value string")
    body = a.df.select("i", "j", F.format_string("%d %d %.16e", F.col("i") + 1, F.col("j") + 1, "v").alias("value"))
    rows = head.unionByName(body)
    rows = rows.coalesce(1).sortWithinPartitions("i", "j") if single_file else rows.orderBy("i", "j")
    rows.select("value").write.mode("overwrite").text(path)


def read_parquet(spark: SparkSession, path: str, nrows: int | None = None, ncols: int | None = None) -> SparseMatrix:
    return SparseMatrix.of(spark.read.parquet(path), nrows, ncols)


def write_parquet(a: SparseMatrix, path: str) -> None:
    a.df.write.mode("overwrite").parquet(path)
