"""Reports of neighbours, counts by source, areas that totals are for."""
import pytest
from pyspark.sql import functions as F

from vicinity.functions.roles import ColumnMapping
from vicinity.operators import knn, report

MARKET = "id long, purpose string, built_area double, unit double"


def test_export_names_order_and_columns(spark):
    near = spark.createDataFrame([(1, 7, 100.0, 90.0, 0.2, 18.0, 10.0), (1, 8, 80.0, 80.0, 0.8, 64.0, 0.0), (0, 8, 80.0, 80.0, 1.0, 80.0, 0.0)], "target_id long, id long, unit double, clipped double, weight double, contribution double, adjustment double")
    sheet = spark.createDataFrame([(7, 71, "guia itbi", 1.0, 5.0, "x"), (8, 81, "oferta", 2.0, 6.0, None), (9, 91, "oferta", 3.0, 7.0, "z")], "id long, _row_id long, info_type string, unit double, unit_value double, `peso_knn` string")
    out = report.neighbour_export(near, sheet, ("adjustment", "peso_knn", "missing"))
    assert out.columns == ["target_id", "id", "linha_excel", "info_type", "valor_unitario_original", "valor_unitario_ajustado", "valor_unitario_robusto", "peso_knn", "contribuicao_valor_unitario", "adjustment", "peso_knn_2"]
    assert [tuple(r) for r in out.collect()] == [(0, 8, 81, "oferta", 6.0, 80.0, 80.0, 1.0, 80.0, 0.0, None), (1, 8, 81, "oferta", 6.0, 80.0, 80.0, 0.8, 64.0, 0.0, None), (1, 7, 71, "guia itbi", 5.0, 100.0, 90.0, 0.2, 18.0, 10.0, "x")]


def test_export_of_rows_the_sheet_lacks_and_of_none(spark):
    near = spark.createDataFrame([(1, 5, 1.0)], "target_id long, id long, weight double")
    sheet = spark.createDataFrame([], "id long, value double")
    assert [tuple(r) for r in report.neighbour_export(near, sheet).collect()] == [(1, 5, None, 1.0)]
    assert report.neighbour_export(near.limit(0), sheet).count() == 0


def test_counts_by_source_and_conflict(spark):
    rows = [("a", "FINALIDADE_CRAWLER", "Sim", True, False), ("a", "FINALIDADE_CRAWLER_REFINADA_SIAT", "Não", False, True), ("a", "SIAT", None, True, False), ("a", "TIPO_CRAWLER", "Moderado", False, False), ("b", "SIAT_FALLBACK", "Não aplicável", False, True), ("b", None, None, False, False)]
    df = spark.createDataFrame(rows, "purpose string, _purpose_source string, _purpose_conflict string, is_sale boolean, is_offer boolean")
    got = {r.purpose: tuple(r)[1:] for r in report.source_counts(df, ["purpose"]).collect()}
    assert got == {"a": (3, 1, 1, 1, 0, 2, 2), "b": (1, 0, 0, 0, 1, 0, 1)}


def test_adjustment_adds_up(spark):
    market = spark.createDataFrame([(i, "casa", 100.0 + i, 9000.0 if i == 3 else 3000.0 + i) for i in range(9)], MARKET)
    targets = knn.resolve_targets(spark.createDataFrame([(1, "casa", 103.0)], "target_id long, purpose string, built_area double"), 2026)
    near = knn.neighbours(market, targets, 2026, local_filter=False).collect()
    assert all(r.unit == pytest.approx(r.clipped + r.adjustment) and r.contribution == pytest.approx(r.weight * r.clipped) for r in near)
    assert {r.id for r in near if r.adjustment > 1} == {3}


def test_area_of_the_total(spark):
    """By column, else by the role that the mapping gives it; not positive: no total."""
    mapping = ColumnMapping(built_area="area_construida", private_area="area util")
    t = spark.createDataFrame([(1, 50.0, 70.0, None), (2, 50.0, 70.0, 90.0), (3, 50.0, -1.0, float("inf")), (4, None, None, float("nan"))], "target_id long, built_area double, private_area double, `area util` double")
    size = lambda name, m=None: [r.s for r in t.orderBy("target_id").select(knn.reference_size(t, name, m).alias("s")).collect()]
    assert size("area util", mapping) == [70.0, 90.0, None, None]
    assert size("built_area") == [50.0, 50.0, 50.0, None] and size("area_construida", mapping) == [50.0, 50.0, 50.0, None]
    assert size("private_area") == [70.0, 70.0, None, None] and size("lot_area") == [None] * 4
    with pytest.raises(ValueError):
        knn.reference_size(t, "area_construida")
    market = spark.createDataFrame([(i, "casa", 100.0 + i, 3000.0) for i in range(6)], MARKET)
    targets = spark.createDataFrame([(1, "casa", 102.0, 40.0)], "target_id long, purpose string, built_area double, private_area double")
    (got,) = knn.value_targets(market, targets, 2026, "area util", local_filter=False, mapping=mapping).select(F.round("total_estimate", 3), "status").collect()
    assert tuple(got) == (120000.0, "ok")
