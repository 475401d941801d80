"""Pieces that no query reaches: duplicate counts, deviation, projection, ids of any size."""
import math

from pyspark.sql import functions as F

from vicinity.operators import dedup, geocode, knn, report
from vicinity.sources.market_view import market_rows


def test_duplicate_groups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "b"), (6, "c"), (7, ""), (8, ""), (9, None)], "id long, k string")
    assert tuple(dedup.duplicate_groups(df, F.col("k")).first()) == (2, 3)
    assert tuple(dedup.duplicate_groups(df.limit(0), F.col("k")).first()) == (0, 0)


def test_weighted_deviation(spark):
    market = spark.createDataFrame([(str(i), "casa", 100.0 + 3 * i, 3000.0 - 40 * i + 7 * (i % 3)) for i in range(12)], "id string, purpose string, built_area double, unit double")
    t = knn.resolve_targets(spark.createDataFrame([(1, "casa", 110.0)], "target_id long, purpose string, built_area double"), 2026)
    near = knn.neighbours(market, t, 2026, local_filter=False)
    rows, est = near.collect(), knn.estimates(near).first()
    assert abs(sum(r.weight for r in rows) - 1) < 1e-9
    assert math.isclose(est.unit_estimate, sum(r.weight * r.clipped for r in rows))
    assert math.isclose(est.unit_std, math.sqrt(sum(r.weight * (r.unit - est.unit_estimate) ** 2 for r in rows)), rel_tol=1e-6)


def test_projection_inverse(spark):
    """A published worked example of the transverse Mercator (Clarke 1866, zone 18)."""
    lat, lon = geocode.transverse_mercator_inverse(F.col("x"), F.col("y"), lat0=0.0, lon0=-75.0, k0=0.9996, fe=0.0, fn=0.0, a=6378206.4, f=1 / 294.978698214)
    r = spark.createDataFrame([(127106.5, 4484124.4), (0.0, 0.0)], "x double, y double").select(lat.alias("lat"), lon.alias("lon")).collect()
    assert abs(r[0].lat - 40.5) < 1e-5 and abs(r[0].lon + 73.5) < 1e-5
    assert abs(r[1].lat) < 1e-9 and abs(r[1].lon + 75) < 1e-9


def test_ids_of_large_keys(spark, tmp_path):
    """Keys far beyond a 64-bit product give ids that differ."""
    big = 60_000_000_000_000
    spark.createDataFrame([(big + i, 1 + i, 2_000_000_000 + i, 3_000_000_000, 10.0, 1000.0, 0.0, "R") for i in range(3)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string").withColumn("l_shipdate", F.current_timestamp()).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(2_000_000_000 + i, "LARGE", 5, 900.0) for i in range(3)], "p_partkey long, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(big + i,) for i in range(3)], "o_orderkey long").withColumn("o_orderdate", F.current_timestamp()).write.parquet(f"{tmp_path}/orders.parquet")
    assert {r.id for r in market_rows(spark, str(tmp_path)).select("id").collect()} == {f"{big + i}-{1 + i}-{2_000_000_000 + i}-3000000000" for i in range(3)}


def test_map_of_targets_with_neighbours(spark):
    near = spark.createDataFrame([(1, "a", -30.0, -51.0, 0.6, 10.0, 0.5), (1, "b", 95.0, -51.0, 0.4, 12.0, 0.7), (2, "c", None, None, 1.0, 9.0, None)], "target_id long, id string, lat double, lon double, weight double, unit double, geo_km double")
    targets = spark.createDataFrame([(1, -30.001, -51.0), (2, None, None), (3, -30.1, -51.2)], "target_id long, lat double, lon double")
    got = {(r.target_id, r.position): (r.id, r.is_target, r.distance_text) for r in report.map_points(near, targets).collect()}
    assert got == {(1, 0): (None, True, "0,000"), (1, 1): ("a", False, "0,500"), (3, 0): (None, True, "0,000")}
    views = {r.target_id: (r.n_points, r.n_discarded, r.zoom) for r in report.map_extents(near, targets).collect()}
    assert views == {1: (2, 1, 15.5), 3: (1, 0, 15.0)}  # the second has no point at all


def test_keep_latest_deals_out_rows_without_key(spark):
    """Rows without a key, also with equal ids, all stay and don't meet in one task; the input is read once."""
    df = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.concat(F.lit("k"), (F.col("id") % 100).cast("string"))).otherwise("").alias("k"), F.lit("2020-01-01").alias("d"), (F.col("id") % 3000).alias("_row_id"))
    kept = dedup.keep_latest(df, F.col("k"), F.to_timestamp("d"))
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in kept.where("k = ''").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 3000 and max(sizes) < 1500
    assert kept.where("k <> ''").count() == 25
