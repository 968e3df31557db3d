"""Aggregates over tables of benchmark times.

The usual input is long: (matrix, ngpus, impl, phase, rank, round, ms).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivoted(df: DataFrame, keys: list[str], column: str, value: str, names: list, fill: float | None = None) -> DataFrame:
    """One column for each of ``names`` with the mean of ``value``; gaps are filled if asked."""
    out = df.groupBy(*keys).pivot(column, names).agg(F.avg(value))
    return out.fillna(fill, [str(n) for n in names]) if fill is not None else out


def mean_runtime(df: DataFrame, phase: str, keys: list[str]) -> DataFrame:
    """Mean of one phase without the warm-up round."""
    return df.where((F.col("phase") == phase) & (F.col("round") != 0)).groupBy(*keys).agg(F.avg("ms").alias("avg_ms"))


def phase_breakdown(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over processes of the mean over rounds, for each phase."""
    inner = df.groupBy(*keys, "phase", "rank").agg(F.avg("ms").alias("ms"))
    return inner.groupBy(*keys, "phase").agg(F.avg("ms").alias("avg_ms"))


def rank_breakdown(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over rounds for each phase and process."""
    return df.groupBy(*keys, "phase", "rank").agg(F.avg("ms").alias("avg_ms"))


def comm_time(df: DataFrame, keys: list[str], phases: list[str]) -> DataFrame:
    """The slowest process's sum over the phases of its means over rounds."""
    means = df.where(F.col("phase").isin(phases)).groupBy(*keys, "rank", "phase").agg(F.avg("ms").alias("ms"))
    return means.groupBy(*keys, "rank").agg(F.sum("ms").alias("ms")).groupBy(*keys).agg(F.max("ms").alias("comm_ms"))


def strong_scaling(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sum over phases of their mean times."""
    return df.groupBy(*keys, "phase").agg(F.avg("ms").alias("ms")).groupBy(*keys).agg(F.sum("ms").alias("total_ms"))


def geomean_speedup(df: DataFrame, ours: str, ngpus: int, matrices: list[str]) -> DataFrame:
    """(impl, speedup, n_matrices): geometric mean over matrices of the other implementations' mean time over ours."""
    means = df.where((F.col("ngpus") == ngpus) & F.col("matrix").isin(matrices)).groupBy("impl", "matrix").agg(F.avg("ms").alias("ms"))
    own = means.where(F.col("impl") == ours).select("matrix", F.col("ms").alias("own"))
    both = means.where(F.col("impl") != ours).join(own, "matrix")
    return both.groupBy("impl").agg(F.exp(F.avg(F.ln(F.col("ms") / F.col("own")))).alias("speedup"), F.count("*").alias("n_matrices"))


def grid_extremes(df: DataFrame) -> DataFrame:
    """From (ngpus, matrix, grid, bytes by process): mean bytes under the smallest and the largest grid, where there are two or more."""
    size = (F.split("grid", "x")[0].cast("long") * F.split("grid", "x")[1].cast("long")).alias("size")
    per_grid = df.groupBy("ngpus", "matrix", "grid").agg(F.avg("bytes").alias("bytes")).select("*", size)
    return per_grid.groupBy("ngpus", "matrix").agg(
        F.min_by("bytes", F.struct("size", "grid")).alias("small_grid_bytes"),
        F.max_by("bytes", F.struct("size", "grid")).alias("large_grid_bytes"),
        F.count("*").alias("n_grids"),
    ).where("n_grids > 1")


def clustering_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sum over iterations (column round) of the slowest process's time."""
    return df.groupBy(*keys, "round").agg(F.max("ms").alias("ms")).groupBy(*keys).agg(F.sum("ms").alias("total_ms"))


def clustering_series(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's times by iteration, as an array in order."""
    return df.groupBy(*keys, "round").agg(F.max("ms").alias("ms")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("round", "ms"))), lambda x: x["ms"]).alias("series"))


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, sample deviation, min, quartiles (interpolated), max."""
    quartile = lambda p: F.expr(f"percentile({value}, {p})")
    return df.groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
        quartile(0.25).alias("q25"), quartile(0.5).alias("q50"), quartile(0.75).alias("q75"), F.max(value).alias("max"),
    )
