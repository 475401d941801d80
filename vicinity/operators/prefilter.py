"""Deterministic and robust filters over market rows, with an audit trail.

All rows stay in one DataFrame: _status is kept or excluded, _flagged marks rows to
look at, _stage and _reasons say why.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import roles
from ..functions.numbers import number, transmitted_share
from ..functions.text import NON_MARKET, bound, norm
from ..plans.params import floor_of
from ..sources.stage import staged
from .robust import quantiles

SYMBOLIC = 1.00
MIN_TESTED, MIN_EXCLUDE, ALERT_Z, EXCLUDE_Z, OUTER_IQR = 8, 15, 2.5, 3.5, 3.0
STAGE_RULE, STAGE_ROBUST, STAGE_ALERT = "regra determinística", "filtro robusto automático", "alerta robusto"
REASONS = {
    "value": "valor ausente ou não positivo", "symbolic": "valor simbólico", "area": "área de referência ausente ou não positiva", "unit": "valor unitário inválido",
    "floor": "valor unitário abaixo do piso da finalidade", "nature": "natureza não mercadológica", "fraction": "transmissão parcial", "count": "transmissão de vários imóveis",
}


def unit_value(value: Column, area: Column, kind: str) -> Column:
    if kind not in ("total", "unit"):
        raise ValueError(f"unknown kind of value: {kind}")
    return F.try_divide(value, F.when(area > 0, area)) if kind == "total" else value


def rule_tests(value: Column, area: Column, unit: Column, floor: Column, sale: Column, nature: Column, fraction: Column, count: Column) -> list[tuple[str, Column]]:
    """The rules in their order: code, and whether a row breaks it."""
    bad = lambda c: F.coalesce(~(c > 0), F.lit(True))
    rules = (
        ("value", bad(value)), ("symbolic", (value > 0) & (value <= SYMBOLIC)), ("area", bad(area)), ("unit", bad(unit)), ("floor", (floor > 0) & (unit > 0) & (unit < floor)),
        ("nature", sale & nature), ("fraction", sale & fraction), ("count", sale & count),
    )
    return [(code, F.coalesce(test, F.lit(False))) for code, test in rules]


def sheet_predicates(df: DataFrame) -> tuple[Column, Column, Column]:
    """Whether any nature, fraction or count column of the sheet says that a sale isn't
    one of a whole property at market terms."""
    types = dict(df.dtypes)
    some = lambda names, test: F.greatest(*found) if len(found := [F.coalesce(test(c), F.lit(False)) for c in roles.matching_columns(df.columns, names)]) > 1 else (found or [F.lit(False)])[0]
    col = lambda c: F.col(f"`{c}`")
    share = lambda c: transmitted_share(col(c), c)
    return (
        some(roles.NATURE, lambda c: norm(col(c).cast("string")).rlike(NON_MARKET)),
        some(roles.FRACTION, lambda c: bound(share(c), lambda s: (s > 0) & (s < 0.999999))),
        some(roles.PROPERTY_COUNT, lambda c: number(col(c), types[c]) > 1),
    )


def apply_rules(df: DataFrame, purpose: str = "purpose", is_sale: Column | None = None, kind: str = "total", floor: Column | None = None, sheet: tuple[Column, Column, Column] | None = None) -> DataFrame:
    """Adds unit_value and the outcome of the rules; df has value and area columns."""
    sale = F.lit(False) if is_sale is None else is_sale
    nature, fraction, count = sheet or (F.lit(False),) * 3
    out = df.withColumn("unit_value", unit_value(F.col("value"), F.col("area"), kind)).withColumn("_floor", floor_of(F.col(purpose)) if floor is None else floor)
    tests = rule_tests(F.col("value"), F.col("area"), F.col("unit_value"), F.col("_floor"), sale, nature, fraction, count)
    out = out.withColumn("_broken", reduce(lambda a, b: a | b, (test for _, test in tests)))
    excluded = F.col("_broken")
    return out.withColumns({
        "_status": F.when(excluded, "excluded").otherwise("kept"), "_stage": F.when(excluded, STAGE_RULE), "_reasons": F.concat_ws("; ", *(F.when(test, REASONS[code]) for code, test in tests)),
        "_flagged": F.lit(False), "_alert": F.lit(""), "_log_unit": F.when(F.col("unit_value") > 0, F.ln("unit_value")),
    }).drop("_broken")


def robust_bounds(df: DataFrame, group: list[str], is_sale: Column) -> DataFrame:
    """Per group the statistics of log unit values of sales that the rules keep."""
    sales = staged(df.where((F.col("_status") == "kept") & is_sale).select(*group, "_log_unit"))
    q = quantiles(sales, group, {"x": F.col("_log_unit")}, [0.25, 0.5, 0.75])
    centre = q.select(*group, F.col("n").alias("n_tested"), *(F.get("q", F.lit(k)).alias(c) for k, c in enumerate(("q1", "med", "q3"))))
    spread = quantiles(sales.join(centre, group), group, {"x": F.abs(F.col("_log_unit") - F.col("med"))}, [0.5])
    return centre.join(spread.select(*group, F.get("q", F.lit(0)).alias("mad")), group)


def robust_filter(df: DataFrame, group: list[str], is_sale: Column, bounds: DataFrame | None = None) -> DataFrame:
    """Tests kept sales by modified z-scores of log unit values (by outer quartile
    fences if the median deviation is zero).  Extremes of samples of 15 or more are
    excluded, otherwise flagged, as are scores in the band of attention.  The statistics
    are those of these rows, or `bounds`."""
    out = df.join(robust_bounds(df, group, is_sale) if bounds is None else bounds, group, "left")
    tested = (F.col("_status") == "kept") & is_sale & (F.col("n_tested") >= MIN_TESTED)
    by_mad, iqr = F.col("mad") > 1e-12, F.col("q3") - F.col("q1")
    score = F.when(tested & by_mad, 0.6745 * (F.col("_log_unit") - F.col("med")) / F.col("mad"))
    reach = EXCLUDE_Z * F.col("mad") / 0.6745
    low = F.when(tested & by_mad, F.exp(F.col("med") - reach)).when(tested & (iqr > 1e-12), F.exp(F.col("q1") - OUTER_IQR * iqr))
    high = F.when(tested & by_mad, F.exp(F.col("med") + reach)).when(tested & (iqr > 1e-12), F.exp(F.col("q3") + OUTER_IQR * iqr))
    out = out.withColumns({"_score": score, "_low": low, "_high": high})
    fence = F.col("_score").isNull() & ((F.col("_log_unit") < F.ln("_low")) | (F.col("_log_unit") > F.ln("_high")))
    extreme = F.coalesce((F.abs("_score") > EXCLUDE_Z) | fence, F.lit(False))
    attention = F.coalesce((F.abs("_score") > ALERT_Z) & (F.abs("_score") <= EXCLUDE_Z), F.lit(False))
    gone = extreme & (F.col("n_tested") >= MIN_EXCLUDE)
    return out.withColumn("_gone", gone).withColumn("_watch", (extreme & ~gone) | attention).withColumns({
        "_status": F.when(F.col("_gone"), "excluded").otherwise(F.col("_status")), "_flagged": F.col("_watch"),
        "_stage": F.when(F.col("_gone"), STAGE_ROBUST).when(F.col("_watch"), STAGE_ALERT).otherwise(F.col("_stage")),
        "_reasons": F.when(F.col("_gone"), "valor unitário extremo na amostra de transações").otherwise(F.col("_reasons")),
        "_alert": F.when(F.col("_watch"), "valor unitário atípico na amostra de transações").otherwise(""),
    }).drop("_gone", "_watch", "q1", "q3", "med", "mad")


def exclusion_histogram(df: DataFrame) -> DataFrame:
    """Rows by stage and reason."""
    return df.where("_stage IS NOT NULL").groupBy("_stage", F.when(F.col("_status") == "excluded", F.col("_reasons")).otherwise(F.col("_alert")).alias("reason")).agg(F.count("*").alias("rows"))
