"""Intermediate tables in the folder that driver and executors share."""
from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, Row, SparkSession


@cache
def _local_dir(application: str) -> str:
    """The folder of an application with a local master that names none."""
    return "file://" + tempfile.mkdtemp(prefix="vicinity-")


_scopes: ContextVar[tuple] = ContextVar("scopes", default=())


@contextmanager
def scope():
    """Removes what is staged inside at its end, whatever happens: for a call whose result
    has been written or collected by then, as a micro-batch's."""
    own: list = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for files, folder in own:
            files.cancelDeleteOnExit(folder)
            files.delete(folder, True)


def staging_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where the setting is missing, as in tests,
    a temporary folder takes its place.  It is removed, with what was written to it, at
    the end of the scope() around, or when the driver ends."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = _local_dir(spark.sparkContext.applicationId)
    path = f"{top.rstrip('/')}/stage-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(folder)
    files.deleteOnExit(folder)  # also if writing fails
    for own in _scopes.get()[-1:]:
        own.append((files, folder))
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Removes a staging_folder() that no plan reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


SHUFFLE_FILES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession):
    """Queries planned inside remove their shuffle files when they end; else these stay
    until the driver happens to collect its garbage, those of all queries side by side."""
    before = spark.conf.get(SHUFFLE_FILES, "false")
    spark.conf.set(SHUFFLE_FILES, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_FILES, before)


def staged(df: DataFrame, path: str | None = None) -> DataFrame:
    """The table, written to a staging_folder() and read again, so that plans that use it
    several times compute it once and a lost executor costs no more than a read.  What it
    was shuffled by is removed once it is written."""
    path = path or staging_folder(df.sparkSession)
    with shuffles_go(df.sparkSession):
        df.write.parquet(f"{path}/rows")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


def collected(df: DataFrame) -> list[Row]:
    """The table's rows, for tables that are small by nature; its shuffles' files are
    removed, as staged() does."""
    with shuffles_go(df.sparkSession):
        return df.select("*").collect()  # planned anew, so that the setting holds


PART_ROWS = 2_000_000  # of a wide table


def staged_wide(df: DataFrame) -> DataFrame:
    """staged(), with a part for each core at least and for every PART_ROWS rows: for
    tables whose rows the next steps multiply.  Parts that are too few, merged by size or
    large, are dealt out anew, in a number that grows with the table."""
    out, conf = staged(df), df.sparkSession.conf
    parts = max(df.sparkSession.sparkContext.defaultParallelism, int(conf.get("spark.sql.shuffle.partitions")), -(-out.count() // PART_ROWS))
    return out if len(out.inputFiles()) >= parts else staged(out.repartition(parts))


def spread(df: DataFrame) -> DataFrame:
    """A table as read from files, dealt over all cores where fewer tasks would read it.
    Such a table is smaller than a file split for each core; one of many splits, or row
    groups, stays as it is and isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
