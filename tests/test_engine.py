import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity.functions import roles
from vicinity.operators import backtest, dedup, enrich, geocode, knn
from vicinity.operators.discount import offer_discount
from vicinity.operators.robust import capped_weights, center_scale, quantiles, weighted_quantile
from vicinity.plans import params
from vicinity.plans.prepare import prepare
from vicinity.sources.stage import spread

SCHEMA = "id long, purpose string, built_area double, private_area double, lot_area double, frontage double, year double, lat double, lon double, unit double"


def market(spark, rows):
    return spark.createDataFrame([(i, "casa", a, None, lot, None, y, lat, lon, u) for i, (a, lot, y, lat, lon, u) in enumerate(rows)], SCHEMA)


def target(spark, **given):
    base = {"target_id": 0, "purpose": "casa", "built_area": None, "lot_area": None, "year": None, "lat": None, "lon": None, "min_k": 2, "max_k": 3, "goal": 1.0, "physical": 0.8, "cap": 1.0, "power": 1.0, "mad": 2.0} | given
    return spark.createDataFrame([tuple(base.values())], "target_id long, purpose string, built_area double, lot_area double, year double, lat double, lon double, min_k int, max_k int, goal double, physical double, cap double, power double, mad double")


BASE = [(100.0, None, 1990.0, -30.030, -51.230, 3000.0), (105.0, None, 2000.0, -30.031, -51.231, 2950.0), (110.0, None, 2010.0, -30.032, -51.232, 2900.0), (115.0, None, None, -30.033, -51.233, 2850.0)]


def test_year_counts_and_is_audited(spark):
    t = knn.resolve_targets(target(spark, built_area=105.0, year=2000.0, lat=-30.031, lon=-51.231), 2026)
    m = market(spark, BASE)
    assert [r._stage for r in knn.pairs(m, t, 2026, audit=True).collect()] == [knn.STAGE_YEAR]
    near = knn.neighbours(m, t, 2026).orderBy("rank").collect()
    assert near[0].id == 1 and near[0].n_candidates == 3
    assert sum(r.weight for r in near) == pytest.approx(1)


def test_location_is_optional(spark):
    m = market(spark, [(100.0, 250.0, None, -30.03, -51.23, 4000.0), (115.0, 290.0, None, -30.031, -51.231, 3739.0), (130.0, 340.0, None, -30.032, -51.232, 3615.0), (150.0, 420.0, None, None, None, 3467.0)])
    out = knn.value_targets(m, target(spark, built_area=120.0, lot_area=300.0, max_k=2), 2026).first()
    assert out.k_used == 2 and out.n_candidates == 4 and not out.use_place and out.geo_median_km is None
    t = knn.resolve_targets(target(spark, built_area=120.0, lot_area=300.0, lat=-30.031, lon=-51.231), 2026)
    assert [r._stage for r in knn.pairs(m, t, 2026, audit=True).collect()] == [knn.STAGE_PLACE]


def test_bad_targets_have_a_reason(spark):
    m = market(spark, BASE)
    for given, status in ((dict(built_area=100.0, year=2000.5), "invalid construction year"), (dict(lot_area=450.0), "no frontage"), (dict(), "no feature")):
        assert knn.value_targets(m, target(spark, **given), 2026).first().status == status
    faults = [(knn.resolve_targets(target(spark, built_area=100.0, **bad), 2026).first().status, what) for bad, what in (({"min_k": 1}, "min_k"), ({"max_k": 1}, "max_k"), ({"goal": 0.0}, "goal"), ({"physical": 1.5}, "physical"), ({"cap": 0.0}, "cap"), ({"power": 0.0}, "power"), ({"mad": 0.0}, "mad"))]
    assert all(status.startswith(what) for status, what in faults)
    # a year that the market has no column for doesn't count, even if it is no year
    t = knn.resolve_targets(target(spark, built_area=100.0, year=2000.5), 2026, [c for c in market(spark, BASE).columns if c != "year"]).first()
    assert t.status is None and t.n_features == 1


def capped(raw, cap):
    cap, raw = max(cap, 1 / len(raw)), np.array(raw, float)
    w, free, left = np.zeros(len(raw)), np.ones(len(raw), bool), 1.0
    while free.any():
        p = left * raw[free] / raw[free].sum()
        over = np.flatnonzero(free)[p > cap + 1e-15]
        if not len(over):
            w[free] = p
            break
        w[over], free[over] = cap, False
        left = 1 - w[~free].sum()
    return w / w.sum()


def test_capped_weights(spark):
    rng = np.random.default_rng(1)
    groups = [rng.pareto(1, rng.integers(1, 12)) + 1e-3 for _ in range(40)]
    df = spark.createDataFrame([(g, i, float(x)) for g, xs in enumerate(groups) for i, x in enumerate(xs)], "g int, i int, x double")
    got = {(r.g, r.i): r.weight for r in capped_weights(df, ["g"], F.col("x"), F.lit(0.3), "i").collect()}
    for g, xs in enumerate(groups):
        assert np.allclose([got[g, i] for i in range(len(xs))], capped(xs, 0.3), atol=1e-9)


def test_statistics(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (1, 3, 5.0), (1, 4, 9.0), (2, 1, 7.0), (3, 1, None)], "g int, i int, x double")
    got = {r.g: (r.x_center, r.x_scale) for r in center_scale(df, ["g"], ["x"]).collect()}
    assert got[2] == (7.0, 7.0) and got[3] == (0.0, 1.0) and got[1][0] == 5.0
    q = weighted_quantile(df, ["g"], F.col("x"), F.col("i").cast("double"), {"m": 0.5}, "i")
    assert {r.g: r.m for r in q.collect()} == {1: 5.0, 2: 7.0}


def test_quantiles_of_large_and_small_groups(spark):
    """Group a is past the size from which brackets are used, with ties in y and nulls;
    b is small and has no y, c has nothing."""
    rng = np.random.default_rng(2)
    rows = [("a", float(x), float(y) if y else None) for x, y in zip(rng.normal(size=30_000), rng.integers(0, 9, 30_000))]
    rows += [("b", float(x), None) for x in range(7)] + [("c", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    levels = [0.1, 0.5, 0.75]
    got = {(r.g, r.name): (r.n, r.q) for r in quantiles(df, ["g"], {"x": F.col("x"), "y": F.col("y")}, levels).collect()}
    assert set(got) == {("a", "x"), ("a", "y"), ("b", "x")}
    for (g, name), (n, q) in got.items():
        values = [r["xy".index(name) + 1] for r in rows if r[0] == g and r["xy".index(name) + 1] is not None]
        assert n == len(values) and np.allclose(q, np.quantile(values, levels), atol=1e-12)


def test_spread_of_few_and_many_partitions(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == cores
    assert spread(spark.range(0, 10, 1, cores + 3)).rdd.getNumPartitions() == cores + 3
    assert sorted(r.id for r in spread(spark.range(0, 10, 1, 1)).collect()) == list(range(10))


def test_discount_states(spark):
    rows = [("a", 1.0, False, True), ("b", 1.0, True, False), ("c", 1.0, True, False), ("c", 2.0, False, True)]
    rows += [("d", float(80 + i), True, False) for i in range(6)] + [("d", float(100 + i), False, True) for i in range(6)]
    got = {r.g: (r.source, round(r.discount, 4)) for r in offer_discount(spark.createDataFrame(rows, "g string, unit_value double, is_sale boolean, is_offer boolean"), ["g"]).collect()}
    assert got["a"] == ("offers_only_fallback", 0.1) and got["b"] == ("no_offers", 0.0) and got["c"] == ("insufficient_mixed_sample", 0.0)
    q = np.linspace(0.1, 0.9, 6)
    assert got["d"][1] == pytest.approx(np.median(1 - np.quantile(np.arange(80, 86), q) / np.quantile(np.arange(100, 106), q)), abs=1e-4)


def test_keep_latest(spark):
    df = spark.createDataFrame([(1, "k", None), (2, "k", "2020-01-01"), (3, "k", "2020-01-01"), (4, "", None), (5, None, None)], "_row_id long, k string, d string")
    assert sorted(r._row_id for r in dedup.keep_latest(df, F.col("k"), F.to_timestamp("d")).collect()) == [3, 4, 5]


def test_portal_sheet_end_to_end(spark):
    kinds = ["Casa", "Casa de condomínio", "Casa", "Casa", "Sobrado", "Casa", "Casa"]
    announced, private, built, total = [130, 250, 547, 241, 450, 580, 70], [130.0, None, None, 241.0, None, None, None], [None] * 5 + [580.0, None], [None] * 6 + [125.11]
    value = [1_500_000, 1_800_000, 3_800_000, 2_700_000, 1_600_000, 3_000_000, 320_000]
    rows = [(i + 1, k, "Venda", a, p, b, t, v, f"http://x/{i}") for i, (k, a, p, b, t, v) in enumerate(zip(kinds, announced, private, built, total, value))]
    df = spark.createDataFrame(rows, "id_vivareal long, tipo_imovel string, finalidade string, area_anunciada_m2 long, area_privativa_descrita_m2 double, area_construida_descrita_m2 double, area_total_descrita_m2 double, valor_oferta_rs long, url_anuncio string")
    rich, info = enrich.enrich(df)
    assert not info.siri and {r._info_type for r in rich.collect()} == {"Oferta"}
    assert [r._built_area for r in rich.orderBy("id_vivareal").collect()] == [130, 250, 547, 241, 450, 580, 70]
    mapping, missing = roles.build_mapping(rich.columns)
    assert not missing and mapping.value == "valor_oferta_rs"
    done = prepare(rich, mapping, "CASA / RESIDÊNCIA", minimum=2)
    assert done.kept.count() == 7 and done.discount.first().source == "offers_only_fallback"
    t = spark.createDataFrame([(1, "CASA / RESIDÊNCIA", 250.0)], "target_id long, purpose string, built_area double")
    out = knn.value_targets(done.kept.withColumn("id", F.col("_row_id")), t, 2026).first()
    assert out.status == "ok" and out.k_used == 5 and not out.use_place and out.total_estimate > 0


def test_regimes():
    assert params.choose_regime("construida", {"total": 9, "private": 3}, 5) == ("total", "preferred")
    assert params.choose_regime("privativa", {"total": 9, "private": 3}, 5) == ("total", "alternative")
    with pytest.raises(ValueError):
        params.choose_regime("privativa", {"total": 1, "private": 1}, 5)


def test_interpolation_and_ranges(spark):
    pts = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]
    df = spark.createDataFrame([(pts, [0])], "points array<struct<x:double,y:double>>, parts array<int>")
    at = lambda f: tuple(df.select(geocode.interpolate(F.col("points"), F.col("parts"), F.lit(f)).alias("p")).first().p)
    assert at(0.75) == (10.0, 5.0) and at(0.0) == (0.0, 0.0) and at(2.0) == (10.0, 10.0)
    streets = spark.createDataFrame([(1, "Rua dos Andradas"), (2, "Avenida Ipiranga")], "cdlog long, name string")
    got = {r.street: (r.cdlog, r.score) for r in geocode.match_streets(spark.createDataFrame([("RUA DOS ANDRADAS",), ("Rua dos Andrada",), ("Rua Y",)], "street string"), streets).collect()}
    assert got["RUA DOS ANDRADAS"] == (1, 100.0) and got["Rua dos Andrada"][0] == 1 and got["Rua Y"][0] is None


def test_backtest_leaves_itself_out(spark):
    rng = np.random.default_rng(2)
    rows = [(float(100 + i), 200.0, 2000.0, -30.0 + 0.001 * i, -51.0, float(3000 + rng.integers(-100, 100))) for i in range(30)]
    m = market(spark, rows).withColumn("is_sale", F.lit(True))
    out = backtest.backtest(m, backtest.as_targets(backtest.eligible(m, 2026)), 2026)
    assert out.where("predicted IS NULL").count() == 0
    row = backtest.metrics(out).first()
    assert row.n_tested == 30 and row.mdape < 0.1
