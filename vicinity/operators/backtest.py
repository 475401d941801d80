"""Leave-one-out and leave-group-out backtests with ratio-study metrics, in one plan."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import valid_coordinates, valid_year
from ..functions.text import group_value
from ..sources.stage import staged
from .knn import FEATURES, estimates, neighbours, resolve_targets
from .robust import by_name, quantiles


def eligible(market: DataFrame, last_year: int, territorial: bool = False, reference_area: str = "built_area", sales_only: bool = True) -> DataFrame:
    """Rows that can be targets: unit value, reference area, coordinates, and year
    (buildings) or frontage (land)."""
    ok = (F.col("unit") > 0) & (F.col(reference_area) > 0) & valid_coordinates(F.col("lat"), F.col("lon"))
    ok = ok & (F.col("frontage").isNotNull() if territorial else valid_year(F.col("year"), last_year))
    return market.where(F.coalesce(ok & (F.col("is_sale") if sales_only else F.lit(True)), F.lit(False)))


def sample(rows: DataFrame, n: int, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """n rows drawn by a hash of id and seed (the same on every run and layout); with
    `by`, n of each group."""
    from pyspark.sql import Window

    draw = F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")))
    if not by:
        return rows.orderBy(draw, "id").limit(n)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(draw, "id"))).where(F.col("_n") <= n).drop("_n")


def as_targets(rows: DataFrame, territorial: bool = False) -> DataFrame:
    """Each row as a target that leaves out itself and its group."""
    positive = {f: F.when(F.col(f) > 0, F.col(f)).alias(f) for f in FEATURES}
    group = group_value(F.col("group")) if "group" in rows.columns else F.lit("")
    return rows.select(F.col("id").alias("target_id"), "purpose", *positive.values(), "lat", "lon", F.lit(territorial).alias("territorial"), F.col("id").alias("exclude_id"), group.alias("exclude_group"), F.col("unit").alias("actual"))


def backtest(market: DataFrame, targets: DataFrame, last_year: int, local_filter: bool = True) -> DataFrame:
    """(target_id, purpose, actual, predicted, k_used, n_eff, ratio, ape); targets that
    can't be valued have null predictions."""
    t = staged(resolve_targets(targets, last_year, market.columns))
    est = estimates(neighbours(market, t, last_year, local_filter)).select("target_id", "k_used", "n_eff", F.col("unit_estimate").alias("predicted"))
    out = t.select("target_id", "purpose", "actual").join(est, "target_id", "left")
    return out.withColumns({"ratio": F.col("predicted") / F.col("actual"), "ape": F.abs(F.col("predicted") - F.col("actual")) / F.col("actual")})


def metrics(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Ratio-study metrics of predictions, one row (or one per group)."""
    whole = not by
    by = by or ["_all"]
    predictions = predictions.withColumn("_all", F.lit(1)) if whole else predictions
    ok = F.col("predicted").isNotNull()
    p = staged(predictions.select(*by, "predicted", "actual", "ratio", "ape").withColumn("e", F.col("predicted") - F.col("actual")))
    q = quantiles(p.where(ok), by, {"ratio": F.col("ratio"), "error": F.abs("e"), "ape": F.col("ape"), "bias": F.col("e") / F.col("actual")}, [0.5, 0.9])
    med = by_name(q, by, {"median_ratio": ("ratio", 0), "medae": ("error", 0), "mdape": ("ape", 0), "p90_ape": ("ape", 1), "median_bias": ("bias", 0)})
    med = staged(p.groupBy(*by).agg(F.avg(F.when(ok, F.col("actual"))).alias("ma")).join(med, by, "left"))
    a = p.join(med, by).groupBy(*by).agg(
        F.count("predicted").alias("n_tested"), F.count_if(~ok).alias("n_failed"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("ape").alias("mape"),
        (1 - F.sum(F.col("e") * F.col("e")) / F.nullif(F.sum(F.when(ok, F.pow(F.col("actual") - F.col("ma"), 2))), F.lit(0.0))).alias("r2"), (F.avg(F.abs(F.col("ratio") - F.col("median_ratio"))) / F.max("median_ratio") * 100).alias("cod"),
        (F.avg("ratio") / (F.sum("predicted") / F.sum(F.when(ok, F.col("actual"))))).alias("prd"),
    )
    a = a.join(med.drop("ma"), by)
    return a.drop("_all") if whole else a
