"""A kept table of geocoded queries: what is known isn't asked again before it expires.

A folder holds versions of the table and a file CURRENT that names one.  A new version
is written whole beside the old one, and then CURRENT is replaced by a rename: readers
see the one or the other, and a job that fails leaves the old one in force.  (Where a
store's rename isn't atomic, one writer at a time.)
"""
from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm, street_and_number
from ..operators.geocode import first_queries
from .stage import staged

FIELDS = "lat double, lon double, method string, matched string, score double, cdlog long, failure string"
SCHEMA = f"query string, {FIELDS}, asked_at timestamp"
NAMES = [f.split(" ")[0] for f in FIELDS.split(", ")]
NOT_FOUND = "não localizado"
KEPT_DAYS = 30

#: A source: its name, whether it is asked for a query (a column over `query`; null: always),
#: and what it answers: a table (query) to a table (query and any of FIELDS).
Source = tuple[str, Column | None, Callable[[DataFrame], DataFrame]]


def of_locality(name: str) -> Column:
    """Whether a query is one for a locality's own street axis: it names the locality, or
    has no more than two parts; and it has a door number."""
    parts = F.size(F.filter(F.split("query", ","), lambda p: F.trim(p) != ""))
    return (F.contains(norm(F.col("query")), norm(F.lit(name))) | (parts <= 2)) & street_and_number(F.col("query"))[1].isNotNull()


def _store(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The table in force; empty where there is none."""
    path, files = _store(spark, folder)
    if not files.exists(path(folder, "CURRENT")):
        return spark.createDataFrame([], SCHEMA)
    version = spark.read.text(f"{folder}/CURRENT").first()[0]
    return spark.read.schema(SCHEMA).parquet(f"{folder}/{version}")


def replace(table: DataFrame, folder: str) -> None:
    """Writes a version of the table and puts it in force; versions before the one that
    it follows are removed, so that readers of that one can end."""
    spark = table.sparkSession
    path, files = _store(spark, folder)
    had = spark.read.text(f"{folder}/CURRENT").first()[0] if files.exists(path(folder, "CURRENT")) else None
    version = f"v-{uuid.uuid4().hex}"
    table.write.parquet(f"{folder}/{version}")
    out = files.create(path(folder, f"{version}.next"))
    out.write(bytearray(version.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(folder).toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    qualified = lambda name: files.makeQualified(path(folder, name))
    context.rename(qualified(f"{version}.next"), qualified("CURRENT"), options)
    for old in files.listStatus(path(folder)):
        name = old.getPath().getName()
        if name.startswith("v-") and name not in (version, had):
            files.delete(old.getPath(), True)


def _answers(asked: DataFrame, sources: list[Source]) -> DataFrame:
    """(query, FIELDS): of each query what the first source says that has a place for it;
    without one, what the first that was asked says about its failure."""
    left, said = asked, []
    for rank, (name, applies, ask) in enumerate(sources):
        own = left if applies is None else left.where(F.coalesce(applies, F.lit(False)))
        found = ask(own)
        kinds = dict(f.split(" ") for f in FIELDS.split(", "))
        have = [(F.col(c) if c in found.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in NAMES if c != "method"]
        found = staged(found.select("query", *have, F.lit(name).alias("method"), F.lit(rank).alias("rank")).dropDuplicates(["query"]))
        said.append(found)
        left = left.join(found.where("lat IS NOT NULL AND lon IS NOT NULL").select("query"), "query", "left_anti")
    every = said[0]
    for more in said[1:]:
        every = every.unionByName(more)
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    best = every.groupBy("query").agg(F.min_by(F.struct(*NAMES), F.struct(~located, "rank")).alias("b"), F.min_by("matched", "rank").alias("m"), F.min_by("score", "rank").alias("s"), F.min_by("cdlog", "rank").alias("c"), F.min_by("failure", "rank").alias("f"))
    some = F.col("b.lat").isNotNull() & F.col("b.lon").isNotNull()
    out = asked.join(best, "query", "left").select(
        "query", F.when(some, F.col("b.lat")).alias("lat"), F.when(some, F.col("b.lon")).alias("lon"), F.when(some, F.col("b.method")).otherwise(NOT_FOUND).alias("method"),
        F.coalesce("m", F.lit("")).alias("matched"), F.coalesce("s", F.lit(0.0)).alias("score"), F.col("c").alias("cdlog"), F.when(some, "").otherwise(F.coalesce(F.nullif("f", F.lit("")), F.lit("Endereço não localizado"))).alias("failure"),
    )
    return out


def locate(df: DataFrame, query: Column, row_id: str, folder: str, sources: list[Source], now: datetime.datetime, most: int = 1000, days: int = KEPT_DAYS) -> tuple[DataFrame, dict[str, int]]:
    """(rows with _geo_query and, for the first `most` distinct queries, _geo_<field>;
    counters).  Only queries that the table doesn't know, or has had for more than `days`
    days, are asked; answers, and failures, are kept as of `now`."""
    spark = df.sparkSession
    rows = df.withColumn("_geo_query", F.trim(F.coalesce(query.cast("string"), F.lit(""))))
    wanted = staged(first_queries(rows, F.col("_geo_query"), row_id, most))
    table = current(spark, folder)
    fresh = table.where(F.col("asked_at") >= F.lit(now - datetime.timedelta(days=days)))
    asked = staged(wanted.join(fresh.select("query"), "query", "left_anti"))
    if not asked.isEmpty():
        new = staged(_answers(asked, sources).withColumn("asked_at", F.lit(now).cast("timestamp")).select(*table.columns))
        replace(table.join(new.select("query"), "query", "left_anti").select(*table.columns).unionByName(new), folder)
    known = current(spark, folder).join(wanted, "query", "left_semi").select(F.col("query").alias("_geo_query"), *(F.col(c).alias(f"_geo_{c}") for c in NAMES))
    out = rows.join(known, "_geo_query", "left")
    placed, method = F.col("_geo_lat").isNotNull() & F.col("_geo_lon").isNotNull(), F.col("_geo_method")
    first, *rest = (name for name, _, _ in sources)
    counts = out.agg(
        F.count("*").alias("rows"), F.count_distinct(F.nullif("_geo_query", F.lit(""))).alias("unique_queries"), F.count_if(placed).alias("geocoded_rows"), F.count_if(method == first).alias("axis_rows"),
        F.count_if(method.isin(rest) if rest else F.lit(False)).alias("second_source_rows"), F.count_if(method == NOT_FOUND).alias("failed_rows"),
    ).first().asDict()
    attempted = wanted.count()
    return out, counts | {"attempted_queries": attempted, "not_attempted_queries": counts["unique_queries"] - attempted}
