"""Alerts, coverage counts and tables for reports and maps."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import valid_coordinates, valid_year
from ..functions.roles import unique_headers
from ..functions.text import brazilian_money, brazilian_number, brazilian_percent, norm
from ..sources.stage import staged
from .robust import by_name, quantiles

CONTROL = ("_row_id", "_status", "_stage", "_reasons", "_alert", "_flagged", "unit_value", "adjusted_unit", "_floor", "_score", "_low", "_high")


# Map zoom by the larger span in degrees.
ZOOMS = ((0.002, 15.5), (0.005, 14.5), (0.010, 13.8), (0.030, 12.5), (0.080, 11.3), (0.200, 10.2), (0.500, 9.0))


def discount_alert(source: Column, raw: Column, discount: Column) -> Column:
    """Level of a discount: by its source first, then by the raw median."""
    return (
        F.when(source == "offers_only_fallback", "10% convencional — somente ofertas").when(source == "no_offers", "sem ofertas")
        .when(source.isin("insufficient_mixed_sample", "empirical_failure"), "amostra mista insuficiente").when(raw > 0.20, "razão empírica acima de 20%")
        .when(discount > 0.15, "acima de 15% até 20%").when(discount > 0.10, "acima de 10% até 15%").when(discount > 0, "até 10%").otherwise("0% empírico")
    )


def composition_alert(n_sales: Column, n_offers: Column) -> Column:
    """Level of a sample's balance of sales and offers."""
    imbalance = F.greatest(n_sales, n_offers) / F.greatest(F.least(n_sales, n_offers), F.lit(1))
    few = F.least(n_sales, n_offers)
    return (
        F.when((n_sales == 0) & (n_offers > 0), "offers_only").when(n_offers == 0, "no_offers").when(few < 2, "critical").when(few < 10, "low").when(few < 15, "limited")
        .when(imbalance > 5, "very_unbalanced").when(imbalance > 3, "unbalanced").otherwise("ok")
    )


def coverage_counts(df: DataFrame, by: list[str], last_year: int) -> DataFrame:
    """Counts that tell what a sample supports, in one aggregation."""
    usable = (F.col("value") > 0) & (F.col("area") > 0)
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.count_if("is_sale").alias("n_sales"), F.count_if("is_offer").alias("n_offers"), F.count_if(F.col("info_type").contains("aluguel")).alias("n_rentals"), F.count_if(usable).alias("n_usable"),
        F.count_if(usable & (F.col("lot_area") > 0)).alias("n_lot"), F.count_if(usable & valid_year(F.col("year"), last_year)).alias("n_year"), F.count_if(valid_coordinates(F.col("lat"), F.col("lon"))).alias("n_placed"),
        F.bool_or(F.col("private_area").isNotNull()).alias("has_private"), F.count_distinct("group").alias("n_groups"),
    )


def source_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts of rows by where their purpose comes from (refined ones have a source of
    their own and aren't among these), of those whose sources conflict, and of sales and
    offers whose sources don't."""
    source, conflict = F.col("_purpose_source"), F.coalesce(norm(F.col("_purpose_conflict")).isin("sim", "moderado"), F.lit(False))
    usable = F.col("is_sale") | F.col("is_offer")
    return df.groupBy(*by).agg(
        F.count_if(usable).alias("n_usable"), F.count_if(source == "FINALIDADE_CRAWLER").alias("n_explicit"), F.count_if(source == "TIPO_CRAWLER").alias("n_listed"), F.count_if(source == "SIAT").alias("n_cadastral"),
        F.count_if(source == "SIAT_FALLBACK").alias("n_fallback"), F.count_if(conflict).alias("n_conflict"), F.count_if(usable & ~conflict).alias("n_clean_usable"),
    )


# Columns of a neighbour that reports show, in this order.
EXPORTED = (
    "target_id", "id", "_row_id", "info_type", "_info_type", "purpose", "_purpose_explicit", "_purpose_cadastral", "_purpose_listed", "_purpose", "_purpose_source", "_purpose_conflict", "_purpose_confidence", "_use_nature",
    "regime", "_conflict", "value", "area", "built_area", "private_area", "lot_area", "frontage", "year", "lat", "lon", "query", "method", "matched", "score", "cdlog", "failure", "unit_value", "unit", "clipped", "geo_km", "weight", "contribution",
)
# Their names in reports.
EXPORT_NAMES = {
    "_row_id": "linha_excel", "unit_value": "valor_unitario_original", "unit": "valor_unitario_ajustado", "clipped": "valor_unitario_robusto", "geo_km": "distancia_geografica_km", "weight": "peso_knn",
    "contribution": "contribuicao_valor_unitario",
}


def neighbour_export(near: DataFrame, sheet: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Neighbours with the columns of their rows in the sheet that reports show, then
    those named in `more`, under the reports' names and in order of weight.  What both
    tables have is the neighbour's; names that are repeated get numbers; what neither
    has is left out.  Rows of the sheet are found by id."""
    own = [c for c in dict.fromkeys((*EXPORTED, *more)) if c in near.columns]
    theirs = [c for c in dict.fromkeys((*EXPORTED, *more)) if c in sheet.columns and c not in own]
    shown = [c for c in dict.fromkeys((*EXPORTED, *more)) if c in own or c in theirs]
    order = [F.col("target_id"), F.desc("weight"), F.col("id")]
    out = near.select(*own).join(sheet.select("id", *(f"`{c}`" for c in theirs)), "id", "left").select(*(f"`{c}`" for c in shown))
    return out.orderBy(*order).toDF(*unique_headers(EXPORT_NAMES.get(c, c) for c in shown))


def map_table(near: DataFrame) -> DataFrame:
    """Neighbours in order of weight, with marker sizes and texts."""
    w = Window.partitionBy("target_id")
    low, high = F.min("weight").over(w), F.max("weight").over(w)
    size = 15 + 16 * F.when(high > low, (F.col("weight") - low) / (high - low)).otherwise(1.0)
    place = F.row_number().over(w.orderBy(F.desc("weight"), "id"))
    return near.where(valid_coordinates(F.col("lat"), F.col("lon"))).select("target_id", place.alias("position"), "id", "lat", "lon", "weight", size.alias("marker_size"), brazilian_money(F.col("unit")).alias("unit_text"), brazilian_number(F.col("geo_km"), 3).alias("distance_text"), brazilian_percent(F.col("weight")).alias("weight_text"))


def map_view(points: DataFrame, by: list[str]) -> DataFrame:
    """Centre (medians) and zoom of a map of points."""
    points = staged(points.select(*by, "lat", "lon"))
    v = points.groupBy(*by).agg(F.greatest(F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon")).alias("span"), F.count("*").alias("n_points"))
    v = v.join(by_name(quantiles(points, by, {"lat": F.col("lat"), "lon": F.col("lon")}, [0.5]), by, {"lat": ("lat", 0), "lon": ("lon", 0)}), by, "left")
    zoom = F.lit(7.8)
    for limit, z in reversed(ZOOMS):
        zoom = F.when(F.col("span") <= limit, z).otherwise(zoom)
    return v.withColumn("zoom", F.when(F.col("n_points") == 1, 15.0).otherwise(zoom))


def map_points(near: DataFrame, targets: DataFrame) -> DataFrame:
    """map_table() with a row for each target that has a place, at position 0."""
    own = targets.where(valid_coordinates(F.col("lat"), F.col("lon"))).select("target_id", F.lit(0).alias("position"), "lat", "lon", brazilian_number(F.lit(0.0), 3).alias("distance_text"), F.lit("—").alias("weight_text"))
    return map_table(near).unionByName(own, allowMissingColumns=True).withColumn("is_target", F.col("position") == 0)


def map_extents(near: DataFrame, targets: DataFrame) -> DataFrame:
    """map_view() of each target together with its neighbours, and n_discarded: its
    neighbours without a place.  Targets without any point have no view."""
    points = near.select("target_id", "lat", "lon", F.lit(False).alias("own")).unionByName(targets.select("target_id", "lat", "lon", F.lit(True).alias("own")))
    points = staged(points.withColumn("placed", F.coalesce(valid_coordinates(F.col("lat"), F.col("lon")), F.lit(False))))
    lost = points.groupBy("target_id").agg(F.count_if(~F.col("own") & ~F.col("placed")).alias("n_discarded"))
    return map_view(points.where("placed"), ["target_id"]).join(lost, "target_id")


def audit_columns(df: DataFrame) -> DataFrame:
    """Control columns first."""
    first = [c for c in CONTROL if c in df.columns]
    return df.select(*first, *(c for c in df.columns if c not in first))
