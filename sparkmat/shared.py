"""Tables in the shared folder, where iterative plans end their lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group: what each writing task holds in memory, in place of 128 MB.
ROW_GROUP = 16 * 2**20
#: Folders still there, with their session; and the folder of each table that is in use.
_WRITTEN: dict[str, SparkSession] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: The catalogue's name of each folder that is a bucketed table.
_NAMES: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, named by ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder; on a cluster,
    whose machines would each write to a disk of their own, it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_root(spark.sparkContext.applicationId)


@cache
def _local_root(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='sparkmat-')}"


def write_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends there.

    Filters on the columns of ``partition_by`` read only their folders.

    The table lasts until ``drop_tables``, the end of its ``scratch`` block or the end of Python.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path, partitionBy=partition_by)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame itself if it is a table in the shared folder, else written there."""
    return df if df in _PATHS else write_table(df, name)


def is_there(table: DataFrame) -> bool:
    """Whether the frame is a table in the shared folder that wasn't deleted."""
    return _PATHS.get(table) in _WRITTEN


def temporary_path(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared folder, for files of any kind; deleted like a table of ``write_table``."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int | None = None, dealt: bool = False) -> DataFrame:
    """Like ``write_table``, dealt into buckets by the hash of ``keys``: joins and aggregates on these keys read it without a shuffle.

    There are as many buckets as shuffle partitions unless given, one file each;
    rows that tasks hold by keys already (``dealt``) are written from where they
    are, compressed as far as it goes.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{own}"
    _WRITTEN[path], _NAMES[path] = spark, own
    if dealt:
        rows = df.write.bucketBy(n, *keys).option("parquet.writer.version", "v2").option("compression", "zstd")
    else:
        rows = df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys)
    rows.option("path", path).option("parquet.block.size", ROW_GROUP).format("parquet").saveAsTable(own)
    out = spark.table(own)
    _PATHS[out] = path
    return out


def with_settings(df: DataFrame, settings: dict[str, str]) -> DataFrame:
    """The same rows, lazily, in a session of their own: its settings are those of ``df``'s session but for ``settings``, which hold for all that is made of them."""
    spark = df.sparkSession
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in settings.items():
        own.conf.set(key, value)
    name = f"moved_{uuid.uuid4().hex}"
    df.createGlobalTempView(name)  # the one way in which a plan passes from session to session
    out = own.table(f"{own.conf.get('spark.sql.globalTempDatabase', 'global_temp')}.{name}")
    spark.catalog.dropGlobalTempView(name)
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder in whatever store it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop(path: str) -> None:
    spark = _WRITTEN.pop(path, None)
    if spark is not None:
        if path in _NAMES:
            spark.sql(f"DROP TABLE IF EXISTS {_NAMES.pop(path)}")
        delete_path(spark, path)


def drop_tables(*tables: DataFrame | None) -> None:
    """Delete tables of ``write_table`` that nothing reads any more; other frames are left alone."""
    for table in tables:
        if table is not None and table in _PATHS:
            _drop(_PATHS.pop(table))


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at the end, but for those given to the function it yields (which returns them)."""
    before, kept = set(_WRITTEN), set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(_PATHS[table])
        return table

    try:
        yield keep
    finally:
        for path in set(_WRITTEN) - before - kept:
            _drop(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application, where it isn't installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="sparkmat-"), "sparkmat.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(path)


@atexit.register
def _drop_tables() -> None:
    for path in list(_WRITTEN):
        try:
            _drop(path)
        except Exception:  # the session may be gone; the shared folder is the cluster's to clean then
            return
