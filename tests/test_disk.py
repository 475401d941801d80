"""What is left on disk: shuffles of staged and collected tables, tables between steps."""
import os
import time

from pyspark.sql import functions as F

from vicinity.operators import dedup, knn
from vicinity.sources.stage import collected, staged, staging_folder

from .test_neighbours import frames


def shuffle_files(spark) -> int:
    """Bytes of shuffle files of the session's block manager."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(k) for k in range(files.size())]
    return sum(f.length() for f in names if f.getName().startswith("shuffle_"))


def settles(measure, most: int) -> bool:
    for _ in range(60):  # files are removed in the background
        if measure() <= most:
            return True
        time.sleep(0.25)
    return False


def test_shuffles_of_staged_and_collected_tables_are_removed(spark):
    before = shuffle_files(spark)
    rows = spark.range(200_000).select((F.col("id") % 50_000).alias("k"), F.md5(F.col("id").cast("string")).alias("x"))
    held = rows.groupBy("k").agg(F.max("x").alias("x"))
    out = staged(held)
    assert settles(lambda: shuffle_files(spark), before)
    assert collected(out.groupBy().agg(F.count("*").alias("n"), F.countDistinct("k").alias("k"))) == [(50_000, 50_000)]
    assert settles(lambda: shuffle_files(spark), before)
    assert held.count() == 50_000  # tables can be planned and read again


def test_steps_of_duplicates_staged_between(spark):
    rows = [(k, "a", k % 7, f"r{k % 40}" if k % 3 else "", float(k % 5 + 1), f"l{k % 11}" if k % 4 else None, k % 2 == 0, k % 5 == 0, "p" if k % 6 else "q") for k in range(600)]
    df = spark.createDataFrame(rows, "_row_id long, t string, d long, r string, v double, l string, o boolean, c boolean, p string").withColumn("d", F.timestamp_seconds("d"))
    run = lambda path: dedup.deduplicate_choices(df, {"full": F.lit(True), "part": ~F.col("c")}, "t", F.col("d"), F.col("r"), F.col("v"), ["l"], F.col("o"), ["p"], path=path)
    path = staging_folder(spark)
    got, want = run(path), run(None)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert {r.full_by for r in got.collect()} == {None, 1, 2}
    assert os.listdir(path.removeprefix("file://")) == ["2"]


def test_pairs_meet_few_targets_without_a_shuffle(spark):
    """Tables of targets, which Spark can't tell to be small, are broadcast; nothing
    beyond a target's reach is ranked, and cells leave no shuffle behind."""
    _, targets, market, resolved = frames(spark)
    index, scale = knn.indexed(market, 2026), knn.scales(market, resolved, 2026)
    before = shuffle_files(spark)
    found = knn.search(index, resolved, scale, 2026, most=4)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert settles(lambda: shuffle_files(spark), before)
    rows = staged(found.select("target_id", "dist"))
    inside = {r.target_id: r.n for r in rows.groupBy("target_id").agg(F.count("*").alias("n")).collect()}
    assert len(inside) == len(targets) and min(inside.values()) >= 4
