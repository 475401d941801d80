"""Shared storage for stages of a job, folds, and connected components."""
from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _local_dir(application: str) -> str:
    """The folder of an application with a local master that names none."""
    return "file://" + tempfile.mkdtemp(prefix="vicinity-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir; it is
    removed when the driver ends, whatever became of the work in it.

    Only where that is unset (local tests) a temporary folder takes its place.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = _local_dir(spark.sparkContext.applicationId)
    path = f"{top.rstrip('/')}/vicinity-{uuid.uuid4().hex}"
    folder, fs = _files(spark, path)
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return path


def _files(spark: SparkSession, path: str):
    """The folder's Hadoop path and file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The table, written to a folder of shared_dir() and read again: lineage ends here,
    and a lost executor costs no more than a read."""
    rows = f"{path or shared_dir(df.sparkSession)}/rows"
    df.write.parquet(rows)
    return df.sparkSession.read.schema(df.schema).parquet(rows)


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder of shared_dir() that no plan reads any more."""
    folder, fs = _files(spark, path)
    fs.cancelDeleteOnExit(folder)
    fs.delete(folder, True)


def give_back() -> None:
    """Returns to the system what this process has freed but still holds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """`run`, a function for mapInArrow, after whose tasks the worker holds no freed
    memory: workers outlive their tasks, and would keep what the largest took."""
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge table: (node, component), the
    component being its smallest node.  Nodes without edges don't appear.

    Alternates large-star and small-star steps until nothing changes; each step
    is a minimum per node (combined before the shuffle) joined back to its edges,
    so a node with very many links is split like any skewed join.  Null ends and
    loops are ignored; repeated edges count once; an empty table gives none.
    """
    spark = edges.sparkSession
    path = shared_dir(spark)
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = written(e.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), path)
    mark = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, path = path, shared_dir(spark)
        e = written(small.select("e.u", "e.v").where("u != v").distinct(), path)
        now = mark(e)
        removed(spark, before)  # only the newest edges are read from here on
        if now == seen:
            break
        seen = now
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
