"""Keeps the latest of duplicated records, in one pass."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, listing_key, money_key, registration_key
from ..sources.stage import staged

# A key that holds very many rows: the limit to a key's first row is taken within tasks
# before the shuffle too (WindowGroupLimit), so that a task sends one row of a hot key.


def keep_latest(df: DataFrame, key: Column, date: Column, row_id: str = "_row_id", only: Column | None = None) -> DataFrame:
    """Of rows with equal key (not '') keeps the one with the latest date, undated rows
    first, then the highest row id; rows without a key, or for which `only` doesn't
    hold, all stay.  One pass and one shuffle; rows without a key have numbers of their
    own and are dealt out by them."""
    keyed = bound(key, lambda k: F.when((k != "") if only is None else ((k != "") & F.coalesce(only, F.lit(False))), k))
    marked = df.withColumns({"_key": keyed, "_date": F.coalesce(F.unix_micros(date.cast("timestamp")), F.lit(-(1 << 62)))})
    marked = marked.withColumns({"_hash": F.xxhash64("_key"), "_alone": F.when(F.col("_key").isNull(), F.monotonically_increasing_id())})  # hashes sort faster than texts
    order = Window.partitionBy("_hash", "_key", "_alone").orderBy(F.desc("_date"), F.desc(row_id))
    return marked.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_hash", "_key", "_alone", "_date", "_place")


def primary_key(info_type: Column, registration: Column, value: Column) -> Column:
    """type::registration::amount where both parts are valid."""
    both = lambda r: bound(money_key(value), lambda m: F.when((r != "") & (m != ""), F.concat_ws("::", info_type, r, m)).otherwise(""))
    return bound(registration_key(registration), both)


def deduplicate(df: DataFrame, info_type: str, date: Column, registration: Column | None, value: Column | None, listing_columns: list[str], is_offer: Column, row_id: str = "_row_id") -> DataFrame:
    """First by registration and amount (all rows), then offers by listing id."""
    out = df
    if registration is not None and value is not None:
        out = keep_latest(out, primary_key(F.col(info_type), registration, value), date, row_id)
    if listing_columns:
        out = keep_latest(out, listing_key([(c, F.col(f"`{c}`").cast("string")) for c in listing_columns]), date, row_id, is_offer)
    return out


def deduplicate_choices(df: DataFrame, choices: dict[str, Column], info_type: str, date: Column, registration: Column | None, value: Column | None, listing_columns: list[str], is_offer: Column, within: list[str], row_id: str = "_row_id", path: str | None = None) -> DataFrame:
    """deduplicate() of several choices of rows at once, each within groups: adds for each
    choice whether a row is left in it, as a column of its name, and the step (1: by
    registration, 2: by listing) that took it out, as <name>_by; no row is dropped.  A
    step is one shuffle for all choices: from a key's latest row on, a choice keeps its
    first.  Rows without a key have numbers of their own and are dealt out by them.

    With a path (a staging_folder(), to be removed by the caller once the result is
    written) rows are staged there between steps, so that a step's shuffle is gone before
    the next one's is written, and rows without a key aren't shuffled after the first."""
    out = df.withColumns({name: F.coalesce(c, F.lit(False)) for name, c in choices.items()} | {f"{name}_by": F.lit(None).cast("int") for name in choices} | {"_date": F.coalesce(F.unix_micros(date.cast("timestamp")), F.lit(-(1 << 62)))})
    steps = {}
    if registration is not None and value is not None:
        steps[1] = primary_key(F.col(info_type), registration, value)
    if listing_columns:
        steps[2] = F.when(F.coalesce(is_offer, F.lit(False)), listing_key([(c, F.col(f"`{c}`").cast("string")) for c in listing_columns]))
    for k, (step, key) in enumerate(steps.items()):
        out, rest = out.withColumn("_key", F.nullif(key, F.lit(""))), None
        if k and path:
            out = staged(out, f"{path}/{step}")
            out, rest = out.where(F.col("_key").isNotNull()), out.where(F.col("_key").isNull())
        out = out.withColumns({"_hash": F.xxhash64(*within, "_key"), "_alone": F.when(F.col("_key").isNull(), F.monotonically_increasing_id())})
        upto = Window.partitionBy("_hash", *within, "_key", "_alone").orderBy(F.desc("_date"), F.desc(row_id)).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({f"_n_{c}": F.count_if(F.col(c)).over(upto) for c in choices})
        lost = {c: F.col(c) & (F.col(f"_n_{c}") > 1) for c in choices}
        out = out.withColumns({f"{c}_by": F.when(gone, step).otherwise(F.col(f"{c}_by")) for c, gone in lost.items()} | {c: F.col(c) & ~gone for c, gone in lost.items()})
        out = out.drop("_hash", "_key", "_alone", *(f"_n_{c}" for c in choices))
        if rest is not None:
            out = out.unionByName(rest.drop("_key"))
    return out.drop("_date")


def duplicate_groups(df: DataFrame, key: Column) -> DataFrame:
    """One row: groups with more than one row, and the rows that keep-latest removes."""
    sizes = df.select(key.alias("k")).where(F.coalesce(F.col("k") != "", F.lit(False))).groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    return sizes.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"))
