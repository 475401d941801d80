"""Keep-latest over micro-batches against the batch operator."""
import random

from pyspark.sql import functions as F

from vicinity.operators.dedup import keep_latest
from vicinity.streaming.latest import current, latest_changes

SCHEMA = "id long, reg string, day timestamp, seen timestamp, text string"


def run(spark, tmp_path, batches, **how):
    """Feeds the batches one by one; the written changes."""
    top = f"{tmp_path}/in"
    log = f"{tmp_path}/log"

    def start():
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(top)
        out = latest_changes(stream, F.col("reg"), F.col("day"), "id", **how)
        return out.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/checkpoint").foreachBatch(lambda df, n: df.write.mode("append").parquet(log)).trigger(availableNow=True).start()

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{top}/{k}")
        start().awaitTermination()  # a new start each time: state comes from the checkpoint
    return spark.read.parquet(log)


def day(spark_day):
    import datetime

    return None if spark_day is None else datetime.datetime(2024, 1, spark_day)


def test_late_and_repeated_records(spark, tmp_path):
    """Three batches with late, repeated, undated and keyless rows and a hot key."""
    draw = random.Random(5)
    batches = [[(k * 1000 + i, draw.choice(["hot", "hot", "a", "b", f"u{draw.randint(0, 40)}", "", None]), day(draw.choice([None, *range(1, 20)])), day(1), f"t{i}") for i in range(300)] for k in range(3)]
    batches[2] += batches[0][:50]  # repeated as they are
    rows = [r for b in batches for r in b]
    log = run(spark, tmp_path, batches)
    got = sorted(tuple(r) for r in current(log, "id").select("id", "reg", "day").collect())
    # the batch operator keeps every copy of a keyless row too
    want = keep_latest(spark.createDataFrame(rows, SCHEMA), F.col("reg"), F.col("day"), "id").select("id", "reg", "day").collect()
    keyed = sorted({tuple(r) for r in want if r.reg})
    assert sorted(r for r in got if r[1]) == keyed
    assert sorted(map(str, (r for r in got if not r[1]))) == sorted(str(tuple(r)) for r in want if not r.reg)
    hot = [(r.day, r.id) for r in log.where("reg = 'hot'").collect()]
    assert 1 <= len(set(hot)) <= len(hot) == 3  # a row a batch


def test_expiry(spark, tmp_path):
    """State goes once the watermark is far enough beyond the last change."""
    one = [(1, "a", day(1), day(1), "x")]
    later = [(2, "b", day(20), day(20), "y")]
    again = [(3, "a", day(1), day(21), "z"), (4, "b", day(19), day(21), "older"), (5, "b", day(25), day(20), "not after the watermark")]
    log = run(spark, tmp_path, [one, later, later, again], expires="5 days", event_time="seen")
    assert sorted((r.id, r._key) for r in log.collect()) == [(1, "a"), (2, "b"), (3, "a")]
    assert {r.id for r in current(log, "id").collect()} == {2, 3}


def test_limit_that_is_not_reached(spark, tmp_path):
    """Beside a time limit: late, repeated and keyless rows, changes only."""
    batches = [[(1, "a", day(5), day(5), "x"), (2, "a", day(5), day(5), "higher id"), (3, "", day(1), day(5), "p"), (4, "b", None, day(5), "undated")], [(5, "a", day(4), day(6), "late"), (2, "a", day(5), day(6), "again"), (6, None, None, day(6), "p")], [(7, "b", day(1), day(7), "dated"), (10, "a", day(5), day(7), "by number")]]
    log = run(spark, tmp_path, batches, expires="90 days", event_time="seen", delay="30 days")
    assert sorted((r.id, r._key) for r in log.collect()) == [(2, "a"), (3, None), (4, "b"), (6, None), (7, "b"), (10, "a")]
    assert {r.id for r in current(log, "id").collect()} == {3, 6, 7, 10}


def test_wrong_arguments(spark):
    import pytest

    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        latest_changes(df, F.col("reg"), F.col("day"), "id", expires="1 day")
    with pytest.raises(ValueError):
        latest_changes(df, F.col("reg"), F.col("day"), "day")
