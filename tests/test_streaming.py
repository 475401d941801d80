from pathlib import Path

from vicinity.sources import stage
from vicinity.streaming import value_stream


def test_stream_of_targets(spark, tmp_path):
    """Each micro-batch of targets is valued against the market."""
    market = spark.createDataFrame([(i, "casa", 100.0 + i, 3000.0 - i) for i in range(6)], "id long, purpose string, built_area double, unit double")
    spark.createDataFrame([(1, "casa", 102.0), (2, "loja", 50.0)], "target_id long, purpose string, built_area double").coalesce(1).write.parquet(f"{tmp_path}/in")
    targets = spark.readStream.schema("target_id long, purpose string, built_area double").parquet(f"{tmp_path}/in")
    got = {}
    query = value_stream(market, targets, 2026, lambda df, n: got.update({r.target_id: (r.status, r.n_candidates) for r in df.collect()}), f"{tmp_path}/checkpoint", local_filter=False)
    query.processAllAvailable()
    query.stop()
    assert got == {1: ("ok", 6), 2: ("fewer than 2 candidates", None)}


def test_batches_leave_nothing_staged(spark, tmp_path):
    """What a micro-batch stages goes with it."""
    top = Path((spark.conf.get("spark.checkpoint.dir", None) or stage._local_dir(spark.sparkContext.applicationId)).removeprefix("file://"))
    staged = lambda: set(top.glob("stage-*"))
    before = staged()
    market = spark.createDataFrame([(i, "casa", 100.0 + i, 3000.0 - i) for i in range(9)], "id long, purpose string, built_area double, unit double")
    for k in range(3):
        spark.createDataFrame([(k, "casa", 102.0 + k)], "target_id long, purpose string, built_area double").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    targets = spark.readStream.schema("target_id long, purpose string, built_area double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got, held = {}, []

    def sink(df, n):
        got.update({r.target_id: r.status for r in df.collect()})
        held.append(len(staged() - before))

    query = value_stream(market, targets, 2026, sink, f"{tmp_path}/checkpoint")
    query.processAllAvailable()
    query.stop()
    assert got == {0: "ok", 1: "ok", 2: "ok"} and all(held)
    assert staged() <= before
