"""Robust statistics by group, as aggregations and windows.

Groups may hold any share of all rows.  A group of up to SMALL rows is sorted by one
task.  Of a larger one a sketch gives a bracket around each wanted value, rows below
it are counted (combined before the shuffle), and only the rows inside, about a
thousandth, are sorted: the result is exact.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import staged

TINY = 1e-12
SMALL = 5_000
ACCURACY, MARGIN = 10_000, 6e-4  # of the sketch: its error is 1 / ACCURACY of the ranks; the margin covers it, and two ranks, for more than SMALL rows
SORTED = 200_000  # rows of a group whose weights one task sums in order
BUCKETS, STEP = 256, 16  # of a large group's values where weights are summed, and how many share a coarse cut


def quantiles(df: DataFrame, group: list[str], values: dict[str, Column], levels: list[float]) -> DataFrame:
    """(*group, name, n, q): linear quantiles of each named value at ascending levels,
    nulls left out.  Levels must lie further apart than the sketch's margins.  The table
    is read a few times: a costly one is staged by the caller."""
    keys, every = [*group, "name"], range(len(levels))
    if any(b - a < 4 * MARGIN for a, b in zip(levels[:-1], levels[1:])):
        raise ValueError("levels must be ascending and apart")
    rows = df.select(*group, *(v.cast("double").alias(f"v_{k}") for k, v in values.items()))
    each = lambda fields: F.explode(F.filter(F.array(*(F.struct(F.lit(k).alias("name"), *fields(k)) for k in values)), lambda r: r.v.isNotNull() & r.part.isNotNull())).alias("r")
    most = rows.groupBy(*group).agg(F.greatest(F.lit(0), *(F.count(f"v_{k}") for k in values)).alias("n")).agg(F.max("n")).first()[0]
    if (most or 0) <= SMALL:
        one = rows.select(*group, each(lambda k: (F.col(f"v_{k}").alias("v"), F.lit(0).alias("part")))).select(*group, "r.*")
        return _picked(one.withColumns({"n": F.count("*").over(Window.partitionBy(*keys)), "below": F.lit(0).cast("long")}), keys, levels)
    near = F.array(*(F.lit(x) for level in levels for x in (max(0.0, level - MARGIN), min(1.0, level + MARGIN))))
    head = rows.groupBy(*group).agg(*(F.count(f"v_{k}").alias(f"n_{k}") for k in values), *(F.percentile_approx(f"v_{k}", near, F.lit(ACCURACY)).alias(f"s_{k}") for k in values))
    # brackets of the large groups, (low, high) for each level
    head = staged(head.withColumns({f"s_{k}": F.when(F.col(f"n_{k}") > SMALL, F.col(f"s_{k}")) for k in values}))
    all_ = rows.join(head, group)
    low, high = (lambda k, i: F.get(f"s_{k}", F.lit(2 * i))), (lambda k, i: F.get(f"s_{k}", F.lit(2 * i + 1)))
    part = lambda k: F.when(F.col(f"s_{k}").isNull(), 0).otherwise(F.coalesce(*(F.when(F.col(f"v_{k}").between(low(k, i), high(k, i)), i) for i in every)))
    inside = all_.select(*group, each(lambda k: (F.col(f"n_{k}").alias("n"), F.col(f"v_{k}").alias("v"), part(k).alias("part")))).select(*group, "r.*")
    below = all_.groupBy(*group).agg(F.array(*(F.struct(F.lit(k).alias("name"), F.array(*(F.count_if(F.col(f"v_{k}") < low(k, i)) for i in every)).alias("_below")) for k in values)).alias("r"))
    below = below.select(*group, F.explode("r").alias("r")).select(*group, "r.*")
    return _picked(inside.join(below, keys).withColumn("below", F.coalesce(F.get("_below", F.col("part")), F.lit(0))), keys, levels)


def _picked(inside: DataFrame, keys: list[str], levels: list[float]) -> DataFrame:
    """Quantiles from rows (*keys, n, v, part, below) that hold all wanted ranks: a part's
    rows follow on `below` others."""
    every = range(len(levels))
    at = F.col("below") + F.row_number().over(Window.partitionBy(*keys, "part").orderBy("v")) - 1
    place = [x * (F.col("n") - 1) for x in levels]
    ends = F.array(*(F.struct(F.lit(i).alias("i"), end(place[i]).alias("k"), F.lit(e).alias("end")) for i in every for e, end in enumerate((F.floor, F.ceil))))
    held = inside.withColumn("at", at).select(*keys, "n", "v", F.explode(F.filter(ends, lambda r: r.k == F.col("at"))).alias("r"))
    found = held.groupBy(*keys, "n").agg(*(F.max(F.when((F.col("r.i") == i) & (F.col("r.end") == e), F.col("v"))).alias(f"v{e}{i}") for i in every for e in (0, 1)))
    q = [F.col(f"v0{i}") + (F.col(f"v1{i}") - F.col(f"v0{i}")) * (place[i] - F.floor(place[i])) for i in every]
    return staged(found.select(*keys, "n", F.array(*q).alias("q")))


def histogram_quantiles(rows: DataFrame, group: list[str], levels: list[float] | DataFrame) -> DataFrame:
    """(*group, n, q) from rows (*group, v): the linear quantiles at levels, the same for
    all or a table (*group, levels); nulls are left out.

    Rows are never put in order: the first pass sums them by logarithmic bucket (combined
    before the shuffle), which shows the buckets that hold a wanted rank; the second sums
    the rows of those buckets by value.  A costly table is staged by the caller."""
    rows = rows.where("v IS NOT NULL").withColumn("b", F.floor(F.signum("v") * F.log1p(F.abs("v") * 1e6) * 256))
    hits = wanted_buckets(rows.groupBy(*group, "b").agg(F.count("*").alias("n"), F.count("*").alias("m")), group, levels)
    own = rows.join(hits.select(*group, "b"), [*group, "b"], "left_semi").groupBy(*group, "b", "v").agg(F.count("*").alias("m"))
    return picked_values(own, hits, group)


def _hit(r: Column, before: Column, upto: Column, weighted: bool) -> Column:
    """Whether a wanted rank, or share of the weight, lies in what follows on `before`."""
    return (before < r.k * F.col("total")) & (upto >= r.k * F.col("total")) if weighted else (before <= r.k) & (r.k < upto)


def wanted_buckets(h: DataFrame, keys: list[str], levels: list[float] | DataFrame, weighted: bool = False) -> DataFrame:
    """Of buckets (*keys, b, n rows, m: rows or weight) those that hold a wanted rank, with
    what lies before them (*keys, b, n, total, before, levels, wanted)."""
    order, whole = Window.partitionBy(*keys).orderBy("b"), Window.partitionBy(*keys)
    h = h.withColumns({"n": F.sum("n").over(whole), "upto": F.sum("m").over(order)}).withColumns({"before": F.coalesce(F.lag("upto").over(order), F.lit(0)), "total": F.max("upto").over(whole)})
    h = h.withColumn("levels", F.array(*map(F.lit, levels))) if isinstance(levels, list) else h.join(levels, [c for c in keys if c in levels.columns])
    if weighted:  # the least sum that reaches the level, but for rounding
        wanted = F.transform("levels", lambda x, i: F.struct(i.alias("i"), F.lit(0).alias("end"), (x - 1e-12).alias("k")))
    else:
        at = lambda x: x * (F.col("n") - 1)
        wanted = F.flatten(F.transform("levels", lambda x, i: F.array(F.struct(i.alias("i"), F.lit(0).alias("end"), F.floor(at(x)).alias("k")), F.struct(i.alias("i"), F.lit(1).alias("end"), F.ceil(at(x)).alias("k")))))
    h = h.withColumn("wanted", F.filter(wanted, lambda r: _hit(r, F.col("before"), F.col("upto"), weighted)))
    return h.where(F.size("wanted") > 0).select(*keys, "b", "n", "total", "before", "levels", "wanted")


def picked_values(own: DataFrame, hits: DataFrame, keys: list[str], weighted: bool = False) -> DataFrame:
    """(*keys, n, q) from the values (*keys, b, v, m) of the wanted buckets: for each level
    the linear quantile, or the first value whose cumulative weight reaches it."""
    inside = Window.partitionBy(*keys, "b").orderBy("v")
    own = own.join(hits, [*keys, "b"]).withColumn("sum", F.sum("m").over(inside))
    own = own.withColumns({"upto": F.col("before") + F.col("sum"), "start": F.col("before") + F.coalesce(F.lag("sum").over(inside), F.lit(0)), "last": F.lead("v").over(inside).isNull()})
    # the last value of a bucket stands in where sums in another order fall short of the level
    hit = lambda r: _hit(r, F.col("start"), F.when(F.col("last"), F.greatest("upto", F.col("before"), r.k * F.col("total"))).otherwise(F.col("upto")) if weighted else F.col("upto"), weighted)
    found = own.select(*keys, "n", "levels", "v", F.explode(F.filter("wanted", hit)).alias("r"))
    found = found.groupBy(*keys, "n", "levels", "r.i").agg(F.max(F.when(F.col("r.end") == 0, F.col("v"))).alias("low"), F.max(F.when(F.col("r.end") == 1, F.col("v"))).alias("high"))
    place = F.element_at("levels", F.col("i") + 1) * (F.col("n") - 1)
    value = F.col("low") if weighted else F.col("low") + (F.col("high") - F.col("low")) * (place - F.floor(place))
    lists = found.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("i", value.alias("q")))).alias("q"))  # one entry a level
    return lists.select(*keys, "n", F.col("q.q").alias("q"))


def by_name(q: DataFrame, group: list[str], fields: dict[str, tuple[str, int]]) -> DataFrame:
    """One row per group from quantiles(): column -> (name, number of the level)."""
    return q.groupBy(*group).agg(*(F.max(F.when(F.col("name") == name, F.get("q", F.lit(k)))).alias(c) for c, (name, k) in fields.items()))


def center_scale(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Per group n_rows, and for each column <c>_center (median) and <c>_scale: the
    quartile range, or 1.4826 * MAD, or the population deviation, or max(|center|, 1),
    each where those before are near zero.  Nulls are left out; without values 0 and 1."""
    df = staged(df.select(*group, *columns))
    q = quantiles(df, group, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75])
    first = df.groupBy(*group).agg(F.count("*").alias("n_rows"), *(F.stddev_pop(c).alias(f"{c}_s") for c in columns))
    first = first.join(by_name(q, group, {f"{c}_{k}": (c, k) for c in columns for k in range(3)}), group, "left")
    flat = q.where(F.get("q", F.lit(2)) - F.get("q", F.lit(0)) <= TINY)
    # the deviation from the median is needed only where the quartiles coincide
    if flat.isEmpty():
        first = first.withColumns({f"{c}_m": F.lit(None).cast("double") for c in columns})
    else:
        middle = by_name(flat, group, {f"{c}_c": (c, 1) for c in columns})
        off = quantiles(df.join(middle, group), group, {c: F.abs(F.col(c) - F.col(f"{c}_c")) for c in columns}, [0.5])
        first = first.join(by_name(off, group, {f"{c}_m": (c, 0) for c in columns}), group, "left")

    def scale(c: str) -> Column:
        median = F.coalesce(F.col(f"{c}_1"), F.lit(0.0))
        options = (F.col(f"{c}_2") - F.col(f"{c}_0"), 1.4826 * F.col(f"{c}_m"), F.col(f"{c}_s"))
        return F.coalesce(*(F.when(o > TINY, o) for o in options), F.greatest(F.abs(median), F.lit(1.0)))

    return first.select(*group, "n_rows", *(F.coalesce(F.col(f"{c}_1"), F.lit(0.0)).alias(f"{c}_center") for c in columns), *(scale(c).alias(f"{c}_scale") for c in columns))


def weighted_quantiles(df: DataFrame, group: list[str], value: Column, weight: Column, q: dict[str, float], tie: str) -> DataFrame:
    """weighted_quantile() for groups of any size: of large ones weights are summed by
    bucket, and only the buckets in which a level is reached are sorted."""
    rows = staged(df.select(*group, value.alias("v"), weight.alias("w"), F.col(tie).alias("t")).where("v IS NOT NULL AND w > 0"))
    sizes = staged(rows.groupBy(*group).agg((F.count("*") > SORTED).alias("_large")))
    if sizes.where("_large").isEmpty():
        return weighted_quantile(rows, group, F.col("v"), F.col("w"), q, "t")
    few = weighted_quantile(rows.join(sizes.where("NOT _large"), group), group, F.col("v"), F.col("w"), q, "t")
    rows = rows.join(sizes.where("_large"), group)
    cuts = rows.groupBy(*group).agg(F.percentile_approx("v", F.array(*(F.lit(i / BUCKETS) for i in range(1, BUCKETS))), F.lit(4 * BUCKETS)).alias("_cuts"))
    cuts = staged(cuts.withColumn("_coarse", F.transform(F.sequence(F.lit(STEP), F.lit(BUCKETS - STEP), F.lit(STEP)), lambda i: F.element_at("_cuts", i))))
    below = lambda c: F.size(F.filter(c, lambda x: x < F.col("v")))
    rows = rows.join(cuts, group).withColumn("_part", below(F.col("_coarse"))).withColumn("_b", F.col("_part") * STEP + below(F.slice("_cuts", F.col("_part") * STEP + 1, STEP)))
    rows = staged(rows.drop("_cuts", "_coarse", "_part"))
    sums = rows.groupBy(*group, "_b").agg(F.sum("w").alias("own"))
    order = Window.partitionBy(*group).orderBy("_b")
    sums = sums.withColumn("upto", F.sum("own").over(order)).withColumn("before", F.coalesce(F.lag("upto").over(order), F.lit(0.0))).withColumn("total", F.max("upto").over(Window.partitionBy(*group)))
    reached = lambda x: (F.col("before") < x * F.col("total")) & (F.col("upto") >= x * F.col("total"))
    hits = sums.withColumns({f"_is_{name}": reached(level) for name, level in q.items()}).where(" OR ".join(f"_is_{name}" for name in q)).drop("own", "upto")
    run = Window.partitionBy(*group, "_b").orderBy("v", "t").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.join(hits, [*group, "_b"]).withColumn("c", F.col("before") + F.sum("w").over(run))
    # the last row of a bucket that reaches a level stands in where sums in another order fall short of it
    first = lambda name, level: F.coalesce(F.min(F.when(F.col(f"_is_{name}") & (F.col("c") >= level * F.col("total")), F.col("v"))), F.max(F.when(F.col(f"_is_{name}"), F.col("v"))))
    return few.unionByName(held.groupBy(*group).agg(*(first(name, level).alias(name) for name, level in q.items())))


def weighted_quantile(df: DataFrame, group: list[str], value: Column, weight: Column, q: dict[str, float], tie: str) -> DataFrame:
    """Per group, for each named level: the first value, in order, whose cumulative
    weight reaches level * total.  Values or weights that are null or not positive
    weights are left out.  One window a group: for groups of bounded size."""
    rows = df.select(*group, value.alias("_v"), weight.alias("_w"), F.col(tie).alias("_t")).where("_v IS NOT NULL AND _w > 0")
    order = Window.partitionBy(*group).orderBy("_v", "_t")
    rows = rows.withColumn("_c", F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_total", F.max("_c").over(Window.partitionBy(*group)))
    return rows.groupBy(*group).agg(*(F.min(F.when(F.col("_c") >= level * F.col("_total"), F.col("_v"))).alias(name) for name, level in q.items()))


def capped_weights(df: DataFrame, group: list[str], raw: Column, cap: Column, tie: str) -> DataFrame:
    """Adds weight: raw weights scaled to sum 1 with none above max(cap, 1/n).

    Closed form of raising and sharing out in turns: with weights from high to low,
    the smallest m for which the largest of the rest fits under the cap once m are at
    it; those m get the cap and the rest share what is left in proportion.  Windows over
    each group: for groups of bounded size.
    """
    w = Window.partitionBy(*group).orderBy(F.desc("_raw"), tie)
    whole = Window.partitionBy(*group)
    rows = df.withColumn("_raw", F.when(raw > 0, raw).otherwise(0.0))
    rows = rows.withColumn("_raw", F.when(F.sum("_raw").over(whole) > 0, F.col("_raw")).otherwise(1.0))
    rows = rows.withColumn("_n", F.count("*").over(whole)).withColumn("_m", F.row_number().over(w) - 1)
    rows = rows.withColumn("_cap", F.least(F.lit(1.0), F.greatest(cap, 1 / F.col("_n"))))
    rows = rows.withColumn("_tail", F.sum("_raw").over(w.rowsBetween(0, Window.unboundedFollowing)))
    fits = (F.col("_tail") > 0) & ((1 - F.col("_m") * F.col("_cap")) * F.col("_raw") <= (F.col("_cap") + 1e-15) * F.col("_tail"))
    rows = rows.withColumn("_capped", F.coalesce(F.min(F.when(fits, F.col("_m"))).over(whole), F.col("_n")))
    rows = rows.withColumn("_rest", F.max(F.when(F.col("_m") == F.col("_capped"), F.col("_tail"))).over(whole))
    share = F.when(F.col("_m") < F.col("_capped"), F.col("_cap")).otherwise((1 - F.col("_capped") * F.col("_cap")) * F.col("_raw") / F.col("_rest"))
    rows = rows.withColumn("_share", F.greatest(F.lit(0.0), F.least(share, F.col("_cap"))))
    return rows.withColumn("weight", F.col("_share") / F.sum("_share").over(whole)).drop("_raw", "_n", "_m", "_cap", "_tail", "_capped", "_rest", "_share")


def robust_mean(df: DataFrame, group: list[str], value: str, weight: str, threshold: Column, tie: str) -> DataFrame:
    """Adds clipped (value within threshold * 1.4826 * weighted MAD of the weighted
    median; unchanged if that is near zero) to every row; the estimate is
    sum(weight * clipped)."""
    median = weighted_quantile(df, group, F.col(value), F.col(weight), {"_median": 0.5}, tie)
    rows = df.join(median, group)
    mad = weighted_quantile(rows, group, F.abs(F.col(value) - F.col("_median")), F.col(weight), {"_mad": 0.5}, tie)
    sigma = 1.4826 * F.col("_mad")
    low, high = F.col("_median") - threshold * sigma, F.col("_median") + threshold * sigma
    clipped = F.when(sigma > TINY, F.least(F.greatest(F.col(value), low), high)).otherwise(F.col(value))
    return rows.join(mad, group).withColumn("clipped", clipped).drop("_median", "_mad")
