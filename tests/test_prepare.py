"""Preparation of one purpose and of all at once: regimes of area, conflicts, duplicates, counts."""
import pytest
from pyspark.sql import functions as F

from vicinity.functions.roles import ColumnMapping
from vicinity.operators import dedup
from vicinity.operators.discount import adjust, offer_discount
from vicinity.plans import params
from vicinity.plans.prepare import STAGE_CONFLICT, STAGE_REGIME, prepare, prepare_all

SCHEMA = "_row_id long, tipo string, finalidade string, valor double, total double, privativa double, lote double, ano double, data_registro timestamp, siat_inscricao string, _purpose_conflict string"
MAPPING = ColumnMapping(info_type="tipo", purpose="finalidade", value="valor", built_area="total", private_area="privativa", lot_area="lote", year="ano")


def sheet(spark, rows):
    return spark.createDataFrame([(k, kind, purpose, value, total, private, lot, year, None, registration, conflict) for k, (kind, purpose, value, total, private, lot, year, registration, conflict) in enumerate(rows)], SCHEMA)


def some(purpose, n, total=100.0, private=80.0, lot=None, year=2000.0, conflict="Não", kind="Oferta", value=300000.0, registration=""):
    return [(kind, purpose, value + k, total, private, lot, year, registration, conflict) for k in range(n)]


def test_regimes_and_conflicts_of_all_purposes(spark):
    rows = some("Apartamento", 12) + some("Apartamento", 3, private=None)  # private area, 12 needed
    rows += some("Sala Comercial", 8) + some("Sala Comercial", 9, private=None)  # 8 with a private area, 9 needed
    rows += some("Casa / Residência", 4) + some("Casa / Residência", 5, conflict="Sim")  # 4 without conflicts, 5 needed
    rows += some("GARAGEM / VAGA", 7) + some("GARAGEM / VAGA", 2, conflict="Moderado")  # enough without
    rows += some("Terreno", 2, lot=500.0) + some("Gleba", 1, lot=500.0)  # 2 needed
    rows += some("Loja", 11) + some("", 3) + some("Apartamento", 2, kind="Oferta Aluguel")
    done = prepare_all(sheet(spark, rows), MAPPING)
    got = {r.purpose: (r.regime, r.why, r.conflict_policy) for r in done.choices.collect()}
    assert got == {
        "Apartamento": ("private", "preferred", "none"), "Sala Comercial": ("total", "alternative", "none"), "Casa / Residência": ("total", "preferred", "included"), "GARAGEM / VAGA": ("private", "preferred", "excluded"),
        "Terreno": ("lot", "territorial", "none"), "Gleba": (None, "insufficient", "none"), "Loja": (None, "insufficient", "none"),
    }
    assert done.conflict_used
    counts = {(r.purpose, r._status, r._stage): (r.n, r.flagged) for r in done.rows.groupBy("purpose", "_status", "_stage").agg(F.count("*").alias("n"), F.count_if("_flagged").alias("flagged")).collect()}
    assert counts["Apartamento", "kept", None] == (12, 0) and counts["Sala Comercial", "kept", None] == (17, 0)
    assert counts["Casa / Residência", "kept", None] == (9, 5) and counts["GARAGEM / VAGA", "kept", None] == (7, 0) and counts["GARAGEM / VAGA", "excluded", STAGE_CONFLICT] == (2, 0)
    assert counts["Loja", "excluded", STAGE_REGIME] == (11, 0) and counts["Gleba", "excluded", STAGE_REGIME] == (1, 0)
    units = {r.purpose: r.u for r in done.kept.groupBy("purpose").agg(F.min("unit").alias("u")).collect()}
    assert units["Apartamento"] == pytest.approx(300000 / 80 * 0.9) and units["Sala Comercial"] == pytest.approx(3000 * 0.9) and units["Terreno"] == pytest.approx(600 * 0.9)
    t = done.totals
    assert (t["n_rows"], t["conflict_rows"], t["kept"], t["excluded_by_conflict"], t["excluded_by_regime"], t["conflict_rows_included"]) == (64, 7, 47, 2, 12, 5)
    assert t["deterministic_excluded"] == 3 and t["statistical_excluded"] == 0 and t["prefilter_input"] == 50 and t["flagged"] == 5


def test_lots_and_years_that_count(spark):
    rows = some("Casa / Residência", 5, lot=300.0) + some("Casa / Residência", 4) + some("Apartamento", 11) + some("Apartamento", 4, year=None)
    got = {r.purpose: r for r in prepare_all(sheet(spark, rows), MAPPING, last_year=2026).choices.collect()}
    house, flat = got["Casa / Residência"], got["Apartamento"]
    assert house.use_land and house.n_land == 5 and house.n_total == 5 and house.regime == "total"
    assert not flat.use_land and flat.n_private == 11 and flat.why == "insufficient"


def test_one_purpose_meets_the_same_duplicates(spark):
    rows = some("Loja", 3, registration="123456", kind="Guia ITBI") + [("Guia ITBI", "Loja", 300000.0, 100.0, 80.0, None, None, "123456", "Sim")] + some("Loja", 2)
    done = prepare(sheet(spark, rows), MAPPING, "loja", minimum=4)
    assert not done.conflict_used and done.totals["removed_by_registration"] == 1 and done.totals["removed_by_registration_without_conflicts"] == 0
    assert sorted((r._row_id, r._status) for r in done.rows.collect()) == [(0, "kept"), (1, "kept"), (2, "kept"), (3, "excluded"), (4, "kept"), (5, "kept")]
    with_all = prepare(sheet(spark, rows), MAPPING, "loja", minimum=6)
    assert with_all.conflict_used and sorted(r._row_id for r in with_all.kept.collect()) == [1, 2, 3, 4, 5]  # of the equal ones the last stays


def test_nothing_to_prepare(spark):
    done = prepare_all(sheet(spark, some("", 1)), MAPPING)
    assert done.rows.count() == 0 and done.choices.count() == 0 and done.totals["n_rows"] == 0


def test_choices_of_rows_agree_with_single_ones(spark):
    df = spark.range(400).selectExpr("id as _row_id", "cast(id % 3 as string) as g", "'guia itbi' as t", "cast(id % 17 as string) as r", "cast(id % 5 as double) as v", "id % 4 = 0 as c", "timestamp_seconds(id * 7919 % 40) as d", "cast(id % 23 as string) as anuncio", "id % 2 = 0 as offer")
    out = dedup.deduplicate_choices(df, {"full": F.lit(True), "part": ~F.col("c")}, "t", F.col("d"), F.col("r"), F.col("v"), ["anuncio"], F.col("offer"), ["g"]).collect()
    assert len(out) == 400
    for name, rows in (("full", df), ("part", df.where("NOT c"))):
        one = [dedup.deduplicate(rows.where(F.col("g") == g), "t", F.col("d"), F.col("r"), F.col("v"), ["anuncio"], F.col("offer")) for g in "012"]
        assert {r._row_id for r in out if r[name]} == {r._row_id for x in one for r in x.collect()}


def test_regime_columns_agree_with_the_driver(spark):
    cases = [(p, a, b, lot, k) for p in ("privativa", "construida", "privativa_ou_construida", "terreno") for a in (None, 1, 5) for b in (None, 1, 5) for lot in (None, 1, 2) for k in (1, 5)]
    df = spark.createDataFrame(cases, "p string, a long, b long, l long, k int")
    for r in df.select("*", *(c.alias(n) for c, n in zip(params.regime_choice(*map(F.col, "pablk")), ("regime", "why")))).collect():
        try:
            want = params.choose_regime(r.p, {n: c for n, c in (("private", r.a), ("total", r.b), ("lot", r.l)) if c is not None}, r.k)
        except ValueError:
            want = (None, "insufficient")
        assert (r.regime, r.why) == want, r


def test_duplicates_in_one_pass_and_purposes_not_dealt_out(spark):
    """Steps of choices read their rows once; rows aren't dealt out by purpose to meet discounts."""
    df = spark.range(400).selectExpr("id as _row_id", "cast(id % 3 as string) as g", "'guia itbi' as t", "cast(id % 17 + 100000 as string) as r", "cast(id % 5 as double) as v", "id % 4 = 0 as c", "timestamp_seconds(id) as d", "cast(id % 23 as string) as anuncio", "id % 2 = 0 as offer")
    out = dedup.deduplicate_choices(df, {"full": F.lit(True), "part": ~F.col("c")}, "t", F.col("d"), F.col("r"), F.col("v"), ["anuncio"], F.col("offer"), ["g"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    rows = df.selectExpr("g", "v + 1 as unit_value", "NOT offer as is_sale", "offer as is_offer")
    plan = adjust(rows, offer_discount(rows, ["g"]), ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    names = [*params.CLASSES, " garagem /  vaga", "Apartamento", "outra"]
    got = [r.f for r in spark.createDataFrame([(k, p) for k, p in enumerate(names)], "k int, p string").orderBy("k").select(params.floor_of(F.col("p")).alias("f")).collect()]
    assert got == [params.FLOORS.get(params.plain(p), 0.0) for p in names]
