"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash of its id and text.  Words are summed by source and hash
bucket; the running sums of a source's buckets show in which one its budget ends.
Only the rows of that boundary bucket are summed again, by the next bits of the hash,
until the bucket is a single hash value.  A document is then taken by comparing its
hash with its source's threshold: nothing is sorted, and budgets are nested, since a
smaller one has a lower threshold.  A source whose target exceeds its size is taken
whole as often as fits, and below the threshold once more.

Targets: sources in code-point order (null last) take their weights in turn and share
`share` times all words by them, none beyond `most` times its own words; what lies
above is shared out again by weight among the others (min(level * weight, most * size),
with the level at which the targets add up).

Documents at the threshold itself (one, unless ids and texts repeat) share what is left
in proportion to their sizes, rounded down: they are taken in part, from their start.
So a source misses its target by less than one word for each such document, and rows
that repeat id and text are taken alike.  Null text has size 0; a null id hashes like
an empty one; a null source is a source; one without words has target 0; an empty table
gives no rows.  Other columns are ignored.

Every document is read once; later steps read (id, source, size, hash).  Tables of one
row a source, or one row a source and bucket, are joined as tables, not broadcast by
hint, and the driver sees none of them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

DIGITS = 15  # hexadecimal digits of the hash: 60 bits


def n_words(text: Column) -> Column:
    """Number of words, without a list of them: each, with the white space before it,
    becomes one character (the full stop added at the end takes trailing space with it)."""
    one = F.regexp_replace(F.concat(F.coalesce(text, F.lit("")), F.lit(" .")), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", ".")
    return (F.length(one) - 1).cast("long")


def targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    w = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), turn + 1)).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    filled = Window.orderBy(F.col("cap") / F.col("weight"))  # the order in which sources reach their caps as the level rises
    upto, whole = filled.rangeBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    w = w.withColumns({"all": F.sum("source_size").over(whole) * F.lit(share), "weights": F.sum("weight").over(whole), "caps_upto": F.sum("cap").over(upto), "weight_upto": F.sum("weight").over(upto)})
    caps, weight = F.col("caps_upto") - F.sum("cap").over(filled.rangeBetween(0, 0)), F.col("weight_upto") - F.sum("weight").over(filled.rangeBetween(0, 0))
    w = w.withColumn("level", (F.col("all") - caps) / (F.col("weights") - weight))  # with all that fill earlier at their caps
    w = w.withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)  # of the first that doesn't fill; counting it as full gives later ones less
    return w.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame, bits: int = 12) -> DataFrame:
    """(source, at, left, tied): rows (source, h of DIGITS * 4 bits, size) with h below
    `at` fit in the source's budget, and those with h = at, of `tied` words together,
    share what is `left`.  Sources whose budget reaches their size don't appear.

    Each level sums the rows of the bucket that the level before found, so all levels
    after the first read a small share of the rows."""
    shift = DIGITS * 4
    ends = budgets.select("source", F.col("budget").alias("left"))
    while shift:
        step = min(bits, shift)
        shift -= step
        bucket = F.shiftright("h", shift)
        if "at" in ends.columns:
            rows = written(rows.alias("r").join(ends.select(F.col("source").alias("s"), "at"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + step) == F.col("at"))).select("source", "h", "size"))
        sums = rows.groupBy("source", bucket.alias("at")).agg(F.sum("size").alias("tied"))
        sums = sums.alias("x").join(ends.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        before = F.sum("tied").over(Window.partitionBy("source").orderBy("at")) - F.col("tied")  # at most 2^bits rows a source
        ends = sums.withColumn("before", before).where("before <= left AND left < before + tied").select("source", "at", (F.col("left") - F.col("before")).alias("left"), "tied")
        ends = written(ends)
    return ends


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """(id_col, source, size, source_size, target, taken) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text)
    h = F.conv(F.substring(F.md5(named.cast("binary")), 1, DIGITS), 16, 10).cast("long")
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), h.alias("h")))
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = written(plan.withColumn("passes", passes).withColumn("budget", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0))))
    ends = thresholds(rows.select("source", "h", "size").where("size > 0"), plan)
    plan = plan.alias("p").join(ends.select(F.col("source").alias("s"), "at", "left", "tied"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumnRenamed("source", "of")
    again = F.when(F.col("h") < F.col("at"), F.col("size")).when(F.col("h") == F.col("at"), F.floor(F.col("size") * F.col("left") / F.col("tied"))).otherwise(F.lit(0))
    taken = (F.col("passes") * F.col("size") + again).cast("long")
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.alias("taken"))


#: The same rows, by sorting hashes instead of narrowing buckets.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
    CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight
  FROM s),
f AS (
  SELECT x.source, x.source_size, x.cap, x.weight,
    (any_value(t.budget) - coalesce(sum(y.cap), 0)) / (any_value(t.weights) - coalesce(sum(y.weight), 0)) AS level
  FROM w x CROSS JOIN (SELECT 1.5::DOUBLE * sum(source_size) AS budget, sum(weight) AS weights FROM w) t
  LEFT JOIN w y ON y.cap / y.weight < x.cap / x.weight
  GROUP BY x.source, x.source_size, x.cap, x.weight),
g AS (
  SELECT source, source_size, CASE WHEN cap / weight <= level THEN cap ELSE weight * (SELECT max(level) FROM f WHERE cap / weight > level) END AS target
  FROM f),
p AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM g),
b AS (
  SELECT doc_id, d.source, size, h, source_size, target, passes, greatest(target - passes * source_size, 0) AS budget,
    CAST(sum(size) OVER (PARTITION BY d.source, h) AS DOUBLE) AS tied,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(passes * size + CASE WHEN upto <= budget THEN size WHEN upto - tied <= budget THEN floor(size * (budget - (upto - tied)) / tied) ELSE 0 END AS BIGINT) AS taken
FROM b
"""
