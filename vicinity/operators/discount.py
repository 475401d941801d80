"""Discount of asking prices against recorded sales, by paired quantiles."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.params import DISCOUNT_CAP, OFFERS_ONLY_DISCOUNT
from ..sources.stage import staged
from .robust import histogram_quantiles


def offer_discount(df: DataFrame, group: list[str], unit: str = "unit_value", is_sale: str = "is_sale", is_offer: str = "is_offer", cap: float = DISCOUNT_CAP) -> DataFrame:
    """Per group: n_sales, n_offers, n_quantiles, raw_median, raw_mean, discount, source.

    With two of each, n = clip(min(counts), 5, 19) levels from 0.1 to 0.9; the median
    of 1 - sale quantile / offer quantile, clipped to [0, cap].  Only offers: a fixed
    10 %.  Counts first, then both sides' quantiles at each group's own levels, all
    groups in one pass.  Staged: Spark then knows its size where it is joined.
    """
    price = F.when(F.col(unit) > 0, F.col(unit))
    rows = staged(df.select(*group, F.when(F.col(is_sale), price).alias("s"), F.when(F.col(is_offer), price).alias("o")))
    stats = rows.groupBy(*group).agg(F.count("s").alias("n_sales"), F.count("o").alias("n_offers"))
    both = (F.col("n_sales") >= 2) & (F.col("n_offers") >= 2)
    stats = staged(stats.withColumn("n_quantiles", F.when(both, F.greatest(F.lit(5), F.least(F.lit(19), F.least("n_sales", "n_offers")))).cast("int")))
    k = F.col("n_quantiles")
    levels = stats.where(k.isNotNull()).select(*group, F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.lit(0.1) + F.lit(0.8) * i / (k - 1)).alias("levels"))
    side = lambda c: rows.where(F.col(c).isNotNull()).select(*group, F.lit(c).alias("name"), F.col(c).alias("v"))
    q = histogram_quantiles(side("s").unionByName(side("o")), [*group, "name"], levels)
    q = q.groupBy(*group).agg(*(F.max(F.when(F.col("name") == c, F.col("q"))).alias(f"q{c}") for c in ("s", "o")))
    ratio = F.zip_with("qs", "qo", lambda a, b: F.when(b > 0, 1 - a / b))
    out = stats.join(q, group, "left").withColumn("d", F.array_sort(F.array_compact(ratio)))
    m = F.size("d")
    median = F.when(m > 0, (F.element_at("d", F.floor((m + 1) / 2).cast("int")) + F.element_at("d", F.floor((m + 2) / 2).cast("int"))) / 2)
    mean = F.when(m > 0, F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / m)
    source = (
        F.when((F.col("n_sales") == 0) & (F.col("n_offers") > 0), "offers_only_fallback").when(F.col("n_offers") == 0, "no_offers")
        .when(~both, "insufficient_mixed_sample").when(F.coalesce(m, F.lit(0)) == 0, "empirical_failure").otherwise("empirical_ratio")
    )
    out = out.withColumns({"raw_median": F.when(both, median), "raw_mean": F.when(both, mean), "source": source})
    value = F.when(F.col("source") == "offers_only_fallback", OFFERS_ONLY_DISCOUNT).when(F.col("source") == "empirical_ratio", F.greatest(F.lit(0.0), F.least(F.lit(cap), F.col("raw_median")))).otherwise(0.0)
    return staged(out.select(*group, "n_sales", "n_offers", "n_quantiles", "raw_median", "raw_mean", value.alias("discount"), "source", F.coalesce(both & (F.col("raw_median") > cap), F.lit(False)).alias("was_capped")))


def adjust(df: DataFrame, discounts: DataFrame, group: list[str], unit: str = "unit_value", is_offer: str = "is_offer") -> DataFrame:
    """Adds factor and adjusted_unit; the discounts are one row per group and staged, so
    that Spark broadcasts them when they are small: dealt out by group, all rows of a
    large group would meet in one task."""
    out = df.join(discounts.select(*group, "discount"), group, "left")
    factor = F.when(F.col(is_offer), 1 - F.coalesce("discount", F.lit(0.0))).otherwise(1.0)
    return out.withColumn("factor", factor).withColumn("adjusted_unit", F.col(unit) * F.col("factor")).drop("discount")
