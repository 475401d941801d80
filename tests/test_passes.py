"""Rows found by distance, columns that passes read, parts of wide tables."""
import numpy as np
import pyarrow as pa

from vicinity.operators import passes
from vicinity.sources import stage


def _rows(n=5000, seed=3):
    r = np.random.default_rng(seed)
    lat, lon = r.uniform(-30.2, -29.9, n), r.uniform(-51.4, -51.0, n)
    lat[:40], lon[40:60], lat[60:70] = np.nan, np.nan, 95.0
    lat[100:200], lon[100:200] = -30.05, -51.2  # many at one place
    return passes.Rows(pa.table({"lat": lat, "lon": lon, "unit": r.uniform(1, 9, n)}), 2026)


def test_rows_by_distance():
    rows = _rows()
    ok = rows.place_ok
    for lat, lon in ((-30.05, -51.2), (-30.2, -51.0), (-29.0, -51.2), (89.9999, 0.0), (-30.05, 179.0)):
        t = {"lat": lat, "lon": lon}
        km = rows.km(t, np.arange(rows.n))
        for low, high in ((0.0, 0.0), (0.0, 5.0), (3.0, 3.1), (0.0, 1e5), (7.5, 12.0)):
            got = rows.around(t, low, high)
            assert len(got) == len(set(got.tolist()))
            with np.errstate(invalid="ignore"):
                assert set(np.flatnonzero(ok & (km >= low) & (km <= high)).tolist()) <= set(got.tolist())
    assert len(rows.around({"lat": -30.05, "lon": -51.2}, 5.0, 5.02)) < rows.n / 10  # a ring, not the disc


def test_buckets_keep_the_order():
    v = np.sort(np.concatenate([-np.logspace(-8, 6, 500), [0.0], np.logspace(-8, 6, 500)]))
    b = passes.bucket_of(v)
    assert (np.diff(b) >= 0).all() and passes.bucket_of(np.array([np.nan]))[0] == 0
    for x, k in zip(v[v > 0], b[v > 0]):
        low, high = passes.bucket_ends(int(k))
        assert low <= x < high


def test_passes_read_what_targets_use(spark):
    market = spark.createDataFrame([("a", "casa", "g", 10.0, 1.0, 2.0, 3.0, 2000.0, -30.0, -51.0, 5.0)], "id string, purpose string, group string, built_area double, private_area double, lot_area double, frontage double, year double, lat double, lon double, unit double")
    t = {"t": 0, "purpose": "casa", **dict.fromkeys(passes.FEATURES), "built_area": 9.0, "use_place": False, "exclude_id": None, "exclude_group": ""}
    out = passes.met(market, [t], 2026, lambda t, rows: [(len(rows.valid(t)), ",".join(rows.table.column_names))], "n long, c string").first()
    assert (out.n, set(out.c.split(","))) == (1, {"purpose", "unit", "built_area"})


def test_parts_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(stage, "PART_ROWS", 100)
    assert len(stage.staged_wide(spark.range(0, 1000, 1, 2)).inputFiles()) == 10


def test_rows_at_once_are_few(spark):
    """A worker's memory follows the rows it holds at once, not its part of the market."""
    market = spark.range(0, 200_000, 1, 1).selectExpr("'LOJA' as purpose", "1.0D as unit", "cast(id as double) as built_area")
    target = {"t": 0, "purpose": "LOJA", **dict.fromkeys(passes.FEATURES), "built_area": 1.0, "use_place": False, "exclude_id": None, "exclude_group": None}
    sizes = [r.n for r in passes.met(market, [target], 2026, lambda t, rows: [(rows.n,)], "n long").collect()]
    assert sum(sizes) == 200_000 and max(sizes) <= 80_000


def test_reference_sets_take_one_pass(spark, monkeypatch):
    """Mode, size and first rows of strict, relaxed and nearest sets come from one pass,
    also where no chunk alone holds a set."""
    n = 400
    market = spark.range(0, n, 1, 40).selectExpr("lpad(id, 4, '0') as id", "'LOJA' as purpose", "'' as `group`", "cast(id + 1 as double) as built_area", "1.0D as unit")
    local = {"proximity_power": 1.0, "max_reference": 30}
    base = {"purpose": "LOJA", **dict.fromkeys(passes.FEATURES), "use_place": False, "exclude_id": None, "exclude_group": None, "n_features": 1, "physical": 1.0, "built_area_scale": 10.0, "min_k": 5, "max_k": 10, "local": local, "n_candidates": n}
    targets = [base | {"t": k, "built_area": x} for k, x in enumerate((100.0, 2.6, 0.1))]
    calls, real = [], passes.met
    monkeypatch.setattr(passes, "met", lambda *a, **k: calls.append(1) or real(*a, **k))
    got = {t["t"]: t for t in passes.weigh_targets(market, targets, 2026)}
    area = np.arange(1, n + 1, dtype=float)
    for k, (x, mode) in enumerate(((100.0, "strict"), (2.6, "nearest"), (0.1, "nearest"))):
        strict = (area / x >= 0.5) & (area / x <= 2.0)
        size = int(strict.sum()) if mode == "strict" else 20
        d = np.abs(area - x) / 10.0
        last = 5 if mode == "strict" else size
        assert (got[k]["mode"], got[k]["n_ref"]) == (mode, size) and abs(got[k]["reach"][0] - np.sort(d[strict] if mode == "strict" else d)[last - 1]) < 1e-12
    assert len(calls) == 1
