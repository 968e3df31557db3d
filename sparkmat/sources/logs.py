"""Benchmark logs as tables: lines with their file and place, parsed with built-in functions only.

Lines are read in parallel.  What a line means can depend on a marker before it
in its file (the round or iteration): a window over each file carries the last
marker on.  A log file is what one benchmark run prints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmat.functions.text import timer_values, without_colours

#: File names that are sent to every executor at most.
BROADCAST_FILES = 10_000
METRICS = "file STRING, phase STRING, rank INT, round INT, ms DOUBLE, pos STRUCT<block: BIGINT, n: BIGINT>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) of all files under a path or glob; ``pos`` rises within a file.

    Files are read line by line, in splits; a folder ``file=NAME`` of parts
    that Spark wrote is the file NAME, if it was written as one part.
    """
    name = F.coalesce(F.nullif(F.regexp_extract("_path", r"/file=([^/]+)/[^/]+$", 1), F.lit("")), F.regexp_extract("_path", r"([^/]+)$", 1))
    read = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_path"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("pos"), "value"
    )
    return read.select(name.alias("file"), "pos", without_colours(F.regexp_replace("value", r"\r$", "")).alias("line"))


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Rows (file, line and the columns of ``order``) as one text file for each name, under folders ``file=NAME``."""
    lines.repartition("file").sortWithinPartitions("file", *order).select("file", "line").write.partitionBy("file").text(path)


def _number(column: str, pattern: str, group: int = 1):
    found = F.regexp_extract(column, pattern, group)
    return F.when(found != "", found)


def with_context(lines: DataFrame, pattern: str, name: str) -> DataFrame:
    """The lines with the number of the last marker before them in their file (null before the first).

    Each split of a file is scanned on its own; the last marker of each split (a
    row each) is carried on to the next, so a long merged log isn't one task.
    """
    marker = _number("line", pattern).cast("int")
    split = lines.withColumn("_block", F.col("pos.block"))
    own = Window.partitionBy("file", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = split.groupBy("file", "_block").agg(F.max_by(marker, F.when(marker.isNotNull(), F.col("pos"))).alias("_end"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "_block", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    local = split.withColumn(name, F.last(marker, ignorenulls=True).over(own))
    return local.join(ends, ["file", "_block"]).withColumn(name, F.coalesce(name, "_before")).select(*lines.columns, name)


def spgemm_metrics(lines: DataFrame) -> DataFrame:
    """(file, phase, rank, round, stat, ms): one row for each timer line and statistic.

    ``<Timer>[p] x ms`` has no rank; ``<[process r]>[p] x ms`` has one; a
    summary ``n=..,avg=..`` gives a row for each of its statistics.
    """
    rounds = with_context(lines, r"STARTING spgemm round:\s*(\d+)", "round")
    line = r"^<(?:Timer(?: rank (\d+))?|\[process (\d+)\])>\[([^\]]+)\]\s*(.*)$"
    parsed = rounds.where(F.col("line").rlike(line)).select(
        "file", "pos", "round",
        F.coalesce(_number("line", line, 1), _number("line", line, 2)).cast("int").alias("rank"),
        F.regexp_extract("line", line, 3).alias("phase"),
        F.explode(timer_values(F.regexp_extract("line", line, 4))).alias("stat", "ms"),
        F.regexp_extract("line", line, 4).contains("=").alias("summary"),
    )
    return parsed.where("ms IS NOT NULL")


def phase_times(metrics: DataFrame, skip_round: int | None = 0) -> DataFrame:
    """(file, phase, rank, round, ms): single values are summed, of summaries the last ``sum`` counts; a warm-up round is left out."""
    if skip_round is not None:
        metrics = metrics.where(F.coalesce("round", F.lit(-1)) != skip_round)
    keys = ["file", "phase", "rank", "round"]
    single = metrics.where("NOT summary AND stat = 'avg'").groupBy(*keys).agg(F.sum("ms").alias("ms"))
    summary = metrics.where("summary AND stat = 'sum'").groupBy(*keys).agg(F.max_by("ms", "pos").alias("ms"))
    return single.unionByName(summary)


def runtimes(lines: DataFrame) -> DataFrame:
    """(file, kind, n, ms): the mean time of a product as each kind of program reports it, and how many times make it.

    Ours: single times after the marker of a round above 0.  Trilinos: ``avg`` of
    the first summary (n is 1).  CombBLAS: single times but for the first of the
    file, its warm-up; if there is only one, that.  Files without times give no row.
    """
    kinds = file_facts(lines).where(F.col("kind").isin("hns_strong", "trilinos_strong", "combblas_strong")).select("file", "kind")
    single, summary = r"<Timer>\[spgemm\]\s+([0-9.]+)\s+ms", r"<Timer>\[spgemm\].*avg=([0-9.]+)"
    ms = lambda pattern: _number("line", pattern).try_cast("double")
    times = with_context(lines, r"STARTING spgemm round:\s*(\d+)", "round").join(F.broadcast(kinds) if kinds.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES else kinds, "file")
    times = times.withColumn("ms", F.when(F.col("kind") == "trilinos_strong", ms(summary)).when(~F.col("line").contains("avg="), ms(single))).where("ms IS NOT NULL")
    kept = times.where("kind <> 'hns_strong' OR round > 0")
    totals = kept.groupBy("file", "kind").agg(F.count("*").alias("n"), F.sum("ms").alias("_sum"), F.min_by("ms", "pos").alias("_first"))
    return totals.select(
        "file", "kind",
        F.when(F.col("kind") == "trilinos_strong", 1).when((F.col("kind") == "combblas_strong") & (F.col("n") > 1), F.col("n") - 1).otherwise(F.col("n")).cast("long").alias("n"),
        F.when(F.col("kind") == "trilinos_strong", F.col("_first")).when((F.col("kind") == "combblas_strong") & (F.col("n") > 1), (F.col("_sum") - F.col("_first")) / (F.col("n") - 1)).otherwise(F.col("_sum") / F.col("n")).alias("ms"),
    )


def iteration_times(lines: DataFrame) -> DataFrame:
    """(file, iter, ms): the largest time of any rank in each clustering iteration."""
    rounds = with_context(lines, r"=+ ITERATION (\d+) =+", "iter")
    line = r"^<Timer(?: rank (\d+))?>\[(?:mcl_)?spgemm\]\s*([-+0-9.eE]+) ms"
    return (
        rounds.where(F.col("line").rlike(line) & F.col("iter").isNotNull())
        .select("file", "iter", F.regexp_extract("line", line, 2).cast("double").alias("ms"))
        .groupBy("file", "iter")
        .agg(F.max("ms").alias("ms"))
    )


def communication_volume(lines: DataFrame, level: int = 0) -> DataFrame:
    """(file, rank, bytes): bytes of each process on lines of one level of the hierarchy."""
    line = r"<\[p (\d+),.*hier (\d+)\]>\[[^\]]*\].*?(\d+) B"
    return (
        lines.where(F.col("line").rlike(line))
        .select("file", F.regexp_extract("line", line, 1).cast("int").alias("rank"), F.regexp_extract("line", line, 2).cast("int").alias("hier"), F.regexp_extract("line", line, 3).cast("long").alias("bytes"))
        .where(F.col("hier") == level)
        .groupBy("file", "rank")
        .agg(F.sum("bytes").alias("bytes"))
    )


FILE_KINDS = {
    "hns_strong": r"^hns_strong_(?<ngpus>\d+)_(?<grid>\d+x\d+)_(?<matrix>.+)_kokkos_(?<spcomm>[a-z]+)_(?<impl>[a-z0-9]+)_(?<permute>[a-z]+)\.out$",
    "trilinos_strong": r"^trilinos_strong_(?<matrix>.+?)_(?<ngpus>\d+)(?<permute>_permute)?\.out$",
    "combblas_strong": r"^combblas_strong_(?<matrix>.+)_(?<ngpus>\d+)\.out$",
    "hns_mcl": r"^hns_mcl_(?<ngpus>\d+)_(?<matrix>.+)_(?<impl>[a-z0-9]+)_(?<tol>[0-9.e-]+)\.out$",
    "comm_vol": r"^comm_vol_(?<ngpus>\d+)_(?<grid>\d+x\d+)_(?<matrix>.+)\.out$",
}


def file_facts(files: DataFrame) -> DataFrame:
    """(file, kind, matrix, ngpus, impl, grid, tol) from file names; names of no known kind are left out."""
    import re

    def part(kind: str, name: str):
        groups = re.findall(r"\(\?<(\w+)>", FILE_KINDS[kind])
        return F.regexp_extract("file", FILE_KINDS[kind], groups.index(name) + 1) if name in groups else F.lit(None).cast("string")

    def by_kind(make):
        out = None
        for kind in FILE_KINDS:
            test = F.col("file").rlike(FILE_KINDS[kind])
            out = F.when(test, make(kind)) if out is None else out.when(test, make(kind))
        return out

    return files.select("file").distinct().select(
        "file",
        by_kind(lambda k: F.lit(k)).alias("kind"),
        by_kind(lambda k: part(k, "matrix")).alias("matrix"),
        by_kind(lambda k: part(k, "ngpus")).cast("int").alias("ngpus"),
        by_kind(lambda k: part(k, "impl")).alias("impl"),
        by_kind(lambda k: part(k, "grid")).alias("grid"),
        by_kind(lambda k: part(k, "tol")).try_cast("double").alias("tol"),
    ).where("kind IS NOT NULL")


def completeness(lines: DataFrame, start: str, end: str) -> DataFrame:
    """(file, n_start, n_end, complete): whether every start marker (regular expression) has its end."""
    return lines.groupBy("file").agg(
        F.count_if(F.col("line").rlike(start)).alias("n_start"), F.count_if(F.col("line").rlike(end)).alias("n_end")
    ).withColumn("complete", (F.col("n_start") > 0) & (F.col("n_start") == F.col("n_end")))


#: What a finished run of each kind of program has printed exactly once.
FINISHED = {
    "hns": ["spgemm round: 3", "A stored in CSC"],
    "trilinos": ["Done spgemm"],
    "combblas": ["2D Multiplication done"],
    "mcl": ["Done MCL"],
}


def diagnosis(lines: DataFrame) -> DataFrame:
    """(program, file, complete): whether a ``.out`` file holds each text of its program once.

    Files named after several programs are judged for each; clustering logs only
    as such.  Runs of ours that exchange sparsely over a grid that isn't the
    square of all processes were never supported and are left out.
    """
    counts = {f"_{p}{k}": F.sum(F.regexp_count("line", F.lit(text))) for p, texts in FINISHED.items() for k, text in enumerate(texts)}
    whole = lines.groupBy("file").agg(*(c.alias(n) for n, c in counts.items())).where(F.col("file").contains(".out"))
    named = lambda p: F.col("file").contains(p) & (~F.col("file").contains("mcl") if p == "hns" else F.lit(True))
    found = lambda p: F.forall(F.array(*(F.col(f"_{p}{k}") for k in range(len(FINISHED[p])))), lambda n: n == 1)
    judged = whole.select("file", F.explode(F.array(*(F.when(named(p), F.struct(F.lit(p).alias("program"), found(p).alias("complete"))) for p in FINISHED))).alias("_j")).where("_j IS NOT NULL")
    side, n = F.regexp_extract("file", r"(\d+)x\d+", 1).try_cast("long"), F.regexp_extract("file", r"_(\d+)_", 1).try_cast("long")
    unsupported = (F.col("_j.program") == "hns") & (side * side != n) & ~F.col("file").contains("nospcomm")
    return judged.where(~F.coalesce(unsupported, F.lit(False))).select("_j.program", "file", "_j.complete")
