"""The index search and the passes against plain versions, with ties, groups left out and bounds."""
import random

import numpy as np
from pyspark.sql import functions as F
from vicinity.operators import knn

MARKET = "id string, purpose string, group string, built_area double, year double, lat double, lon double, unit double"


def market_rows(rng, n=900):
    rows = []
    for i in range(n):
        built = rng.choice([None, 0.0, *[float(rng.randrange(30, 300)) for _ in range(18)]])
        year = rng.choice([None, 1400.0, *[float(rng.randrange(1950, 2026)) for _ in range(8)]])
        lat, lon = (-30.0 + rng.randrange(60) * 0.003, -51.2 + rng.randrange(60) * 0.003) if rng.random() < 0.93 else (None, 200.0)
        rows.append((f"{i:04d}", "casa" if i % 3 else "loja", f"g{i % 7}", built, year, lat, lon, rng.choice([0.0, *[round(rng.lognormvariate(8, 0.5), 2) for _ in range(30)]])))
    return rows + [(f"t{i}", *rows[5][1:]) for i in range(30)]  # ties


def target_rows(rng, rows, n=40):
    out = []
    for k in range(n):
        placed = k % 4 != 3
        out.append((k, "casa" if k % 3 else "loja", float(rng.randrange(40, 280)), float(rng.randrange(1960, 2020)) if k % 2 else None, -30.0 + rng.random() * 0.18 if placed else None, -51.2 + rng.random() * 0.18 if placed else None, rows[k][0] if k % 5 == 0 else None, f"g{k % 7}" if k % 6 == 0 else None))
    return out


def plain(rows, t, lowest=None):
    """[(dist, id)] of a target's candidates, in order, and how many there are."""
    _, purpose, built, year, lat, lon, own, group = t
    ok = [r for r in rows if r[1] == purpose and r[7] > 0 and (r[3] or 0) > 0 and r[0] != own and not (group and r[2] == group) and (lowest is None or r[7] >= lowest)]
    if year is not None:
        ok = [r for r in ok if r[4] is not None and 1500 <= r[4] <= 2026]
    if lat is not None:
        ok = [r for r in ok if r[5] is not None and abs(r[6]) <= 180]
    scale = lambda v: (np.quantile(v, 0.75) - np.quantile(v, 0.25)) or max(abs(np.median(v)), 1)
    b = np.array([r[3] for r in ok])
    attr = ((b - built) / scale(b)) ** 2
    if year is not None:
        y = np.array([r[4] for r in ok])
        attr = (attr + ((y - year) / scale(y)) ** 2) / 2
    physical = {"casa": 0.45, "loja": 0.45}[purpose]
    if lat is None:
        d = np.sqrt(attr)
    else:
        km = np.hypot(6371.0088 * np.cos(np.radians(lat)) * np.radians(np.array([r[6] for r in ok]) - lon), 6371.0088 * np.radians(np.array([r[5] for r in ok]) - lat))
        d = np.sqrt(physical * attr + (1 - physical) * (km / min(20, max(0.25, np.median(km[km > 0])))) ** 2)
    return sorted((round(float(x), 9), r[0]) for x, r in zip(d, ok)), len(ok)


def frames(spark, seed=3):
    rng = random.Random(seed)
    rows = market_rows(rng)
    targets = target_rows(rng, rows)
    t = spark.createDataFrame(targets, "target_id long, purpose string, built_area double, year double, lat double, lon double, exclude_id string, exclude_group string")
    return rows, targets, spark.createDataFrame(rows, MARKET), knn.resolve_targets(t, 2026)


def near_of(df):
    out = {}
    for r in df.orderBy("target_id", "rank").collect():
        out.setdefault(r.target_id, []).append((round(r.dist, 9), r.id))
    return out


def test_search_is_exact(spark, monkeypatch):
    """The nearest of all candidates, by few of the pairs, in one block of targets and in several."""
    rows, targets, market, resolved = frames(spark)
    want = {t[0]: plain(rows, t) for t in targets}
    monkeypatch.setattr(knn, "CELL_ROWS", 2)
    for most, limit in ((10, 20_000), (4, 11)):
        monkeypatch.setattr(knn, "BROADCAST_TARGETS", limit)
        got = near_of(knn.nearest(market, resolved, 2026, most))
        assert got == {k: near[:most] for k, (near, _) in want.items()}
    scale = knn.scales(market, resolved, 2026)
    assert {r.target_id: r.n_candidates for r in scale.collect()} == {k: n for k, (_, n) in want.items()}
    pairs = knn.search(knn.indexed(market, 2026), resolved, scale, 2026, most=4).count()
    assert 160 <= pairs < 0.25 * sum(n for _, n in want.values())


def test_search_under_bounds(spark):
    """Candidates below a target's bound neither count nor stand for others."""
    rows, targets, market, resolved = frames(spark, 5)
    bounds = spark.createDataFrame([(k, 2500.0 + 20 * k) for k in range(0, 40, 2)], "target_id long, _bound double")
    heads = [t | {"bound": 2500.0 + 20 * t["target_id"] if t["target_id"] % 2 == 0 else None} for t in knn.target_rows(resolved)]
    knn.scale_targets(knn._columns(market), heads, 2026)
    found = knn.search(knn.indexed(market, 2026), resolved, knn._scales(resolved, heads), 2026, bounds)
    want = {t[0]: plain(rows, t, 2500.0 + 20 * t[0] if t[0] % 2 == 0 else None)[0][:25] for t in targets}
    assert near_of(knn.ranked(found)) == want


def test_few_and_no_candidates(spark):
    rows, _, market, _ = frames(spark)
    t = spark.createDataFrame([(1, "casa", 100.0), (2, "nothing", 100.0)], "target_id long, purpose string, built_area double")
    out = {r.target_id: r.status for r in knn.value_targets(market, t, 2026).collect()}
    assert out == {1: "ok", 2: "fewer than 2 candidates"}
    assert knn.value_targets(market.limit(0), t, 2026).where("status = 'ok'").count() == 0
    assert knn.value_targets(market, t.limit(0), 2026).count() == 0
    same = market.where("purpose = 'casa' AND built_area > 0 AND unit > 0").limit(3).withColumn("built_area", F.lit(80.0))
    assert {r.target_id: r.n_candidates for r in knn.value_targets(same, t, 2026).collect()} == {1: 3, 2: None}


def test_nearest_mode(spark):
    """Targets unlike everything take their reference set by distance."""
    rows = [(f"{i:03d}", "casa", "", 1000.0 + i, 2000.0, None, None, 3000.0 + i) for i in range(40)] + [("low", "casa", "", 1000.0, 2000.0, None, None, 100.0)]
    market = spark.createDataFrame(rows, MARKET)
    t = knn.resolve_targets(spark.createDataFrame([(1, "casa", 50.0)], "target_id long, purpose string, built_area double"), 2026)
    cut = knn.local_cutoffs(market, t, 2026).first()
    assert (cut["mode"], cut.n_reference, cut.cancelled) == ("nearest", 41, None) and 100 < cut.bound < 3000
    assert [r.id for r in knn.local_exclusions(knn.pairs(market, t, 2026), knn.local_cutoffs(market, t, 2026)).collect()] == ["low"]


def test_cells_once(spark):
    """Cells are computed once, not again where rows are joined to them, and hold every row
    of a positive value; equal values, nulls and an area without cuts included."""
    from vicinity.operators import knn

    rows = [(k, "p" if k % 3 else "q", float(k % 7) or None, 2000.0 + k % 11, -30 + k % 5 / 100, None if k % 4 == 0 else -51.0, float(k % 13)) for k in range(300)]
    market = spark.createDataFrame(rows, "id long, purpose string, built_area double, year double, lat double, lon double, unit double")
    found, cells = knn.indexed(market, 2026)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == sum(r[6] > 0 for r in rows)
    want = {(r.purpose, r._cell): (r.n, r.lo, r.hi) for r in found.groupBy("purpose", "_cell").agg(F.count("*").alias("n"), F.min("year").alias("lo"), F.max("year").alias("hi")).collect()}
    assert {(r.purpose, r._cell): (r.n, r.year_lo, r.year_hi) for r in cells.collect()} == want
    cuts = found.groupBy("purpose").agg(F.percentile_approx("unit", F.array(F.lit(0.5)), F.lit(1000))[0].alias("cut"))
    part = found.join(cuts, "purpose").select(F.shiftright("_cell", 6 + 32).alias("part"), (F.col("unit") > F.col("cut")).cast("long").alias("above"))
    assert part.where("part <> above").isEmpty()
