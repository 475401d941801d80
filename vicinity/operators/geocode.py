"""Addresses to coordinates: parse, match a street, find the segment, interpolate.

Streets: cdlog, name.  Segments: cdlog, ordinal, even_from, even_to, odd_from, odd_to,
points array<struct<x, y>>, parts array<int> (offsets of parts).
"""
from __future__ import annotations

import sys
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import valid_coordinates
from ..functions.text import norm, street_and_number
from ..sources.stage import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_SCORE = 85.0


def address_queries(df: DataFrame, parts: dict[str, str | None], locality: str | None = None) -> Column:
    """The query text of a row from a full address, or from its components."""
    text = lambda p: F.trim(F.coalesce(_plain_number(F.col(f"`{parts[p]}`")), F.lit(""))) if parts.get(p) else F.lit("")
    names = ("street", "number", "neighborhood", "city", "state", "postal_code")
    joined = F.array_join(F.filter(F.array(*map(text, names)), lambda x: x != ""), ", ")
    full = text("full")
    numbered = full.rlike(r"\d")
    more = [F.when((text(p) != "") & ~F.contains(F.lower(full), F.lower(text(p))) & (F.lit(p != "number") | ~numbered), text(p)) for p in names[1:]]
    long = F.array_join(F.array_compact(F.array(F.nullif(full, F.lit("")), *more)), ", ")
    query = F.when(full != "", long).otherwise(joined)
    if locality:
        query = F.when((query != "") & ~F.contains(F.lower(query), F.lit(locality.lower())), F.concat(query, F.lit(", " + locality))).otherwise(query)
    return F.regexp_replace(query, r"^[ ,]+|[ ,]+$", "")


def _plain_number(c: Column) -> Column:
    """136.0 as 136; other text as it is."""
    t = c.cast("string")
    n = t.try_cast("double")
    near = F.abs(n - F.rint(n)) <= 1e-9 + 1e-5 * F.abs(F.rint(n))
    return F.when(F.coalesce(near & t.rlike(r"^\d+\.\d+$"), F.lit(False)), F.rint(n).cast("long").cast("string")).otherwise(t)


def ratio(a: str, b: str) -> float:
    """100 * 2 * longest common subsequence / both lengths (bit-parallel)."""
    if not a or not b:
        return 0.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit) | (row - hit)
    return 200.0 * (len(a) - (row & (1 << len(a)) - 1).bit_count()) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """How alike two names are, from 0 to 100: the ratio as they stand, or 0.95 of it with
    words in order, or with the words that both have set apart (100 where one name has
    only words of the other).  Names of which one is half as long again aren't alike."""
    if max(len(a), len(b)) >= 1.5 * min(len(a), len(b)):
        return ratio(a, b)
    x, y = a.split(), b.split()
    best = max(ratio(a, b), 0.95 * ratio(" ".join(sorted(x)), " ".join(sorted(y))))
    both, x, y = set(x) & set(y), set(x) - set(y), set(y) - set(x)
    if both:
        if not x or not y:
            return max(best, 95.0)
        base = " ".join(sorted(both))
        with_x, with_y = (f"{base} {' '.join(sorted(z))}" for z in (x, y))
        best = max(best, 0.95 * max(ratio(with_x, with_y), ratio(base, with_x), ratio(base, with_y)))
    return best


MISSING = 0.20  # share of a name's letters in words that an alike one may lack


def _keys(names: DataFrame, words: bool) -> DataFrame:
    """(name, key, weight, room): a name's words with their lengths, or the 3-letter
    grams of its words, each word padded, repeats numbered; and how much of the weight
    an alike name may lack."""
    word = F.explode(F.array_distinct(F.split("name", " "))) if words else F.posexplode(F.split("name", " ")).alias("w", "word")
    if words:
        return names.select("name", word.alias("key")).withColumn("weight", F.length("key").cast("double")).withColumn("room", F.length("name") * MISSING)
    padded = F.concat(F.lit("  "), F.col("word"), F.lit("  "))
    grams = F.transform(F.sequence(F.lit(1), F.length("word") + 2), lambda i: F.substr(padded, i, F.lit(3)))
    g = names.select("name", word).select("name", F.explode(grams).alias("gram")).groupBy("name", "gram").agg(F.count("*").alias("n"))
    g = g.select("name", F.explode(F.transform(F.sequence(F.lit(1), "n"), lambda i: F.concat(F.col("gram"), F.lit("#"), i.cast("string")))).alias("key"))
    # a ratio of 85 leaves 1.15 deletions + 0.85 insertions <= 0.3 letters; they take 3 and
    # 2 grams each, and a deleted space one more
    return g.withColumn("weight", F.lit(1.0)).withColumn("room", F.floor(F.length("name") * 0.783) + F.size(F.split("name", " ")) - 1)


def _rare(keys: DataFrame, often: DataFrame) -> DataFrame:
    """(name, key): of each name the rarest keys, as many as no alike name can lack all."""
    order = Window.partitionBy("name").orderBy("often", "key").rowsBetween(Window.unboundedPreceding, -1)
    k = keys.join(often, "key", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    return k.withColumn("before", F.coalesce(F.sum("weight").over(order), F.lit(0.0))).where("before <= room").select("name", "key")


def candidate_pairs(queries: DataFrame, streets: DataFrame) -> DataFrame:
    """(q, s) that may be alike, from names (name) of both: of the grams that both have,
    ordered by rarity among the streets, one of the first must be shared if few letters
    differ, and as many as they leave; if words are missing or in another order, a rare word of one side must be a
    word of the other.  What nearly all names have is no key, so that only names of such
    words meet all streets."""
    gq, gs, wq, ws = (_keys(x, words) for words in (False, True) for x in (queries, streets))
    count = lambda k: k.groupBy("key").agg(F.count("*").alias("often"))
    grams, words = staged(count(gs)), staged(count(ws))
    q, s = (lambda k: k.select(F.col("name").alias("q"), "key")), (lambda k: k.select(F.col("name").alias("s"), "key"))
    sides = ((_rare(gq, grams), _rare(gs, grams)), (_rare(wq, words), ws), (wq, _rare(ws, words)))
    by_grams, *by_words = (q(a).join(s(b), "key").select("q", "s").distinct() for a, b in sides)
    short, long = F.least(F.length("q"), F.length("s")), F.greatest(F.length("q"), F.length("s"))
    lists = lambda k, name: k.groupBy(F.col("name").alias(name)).agg(F.collect_list("key").alias(f"of_{name}"))
    counted = by_grams.where(long * 0.85 <= short * 1.15 + 1e-9).join(lists(gq, "q"), "q").join(lists(gs, "s"), "s")
    apart = F.length("s") - F.length("q")
    gone = F.floor((0.15 * (short + long) - apart) / 2 + 1e-9)  # letters of the query that the street may lack, so many
    come = F.floor((0.15 * (short + long) + apart) / 2 + 1e-9)  # letters of the street that the query may
    shared, spaces = F.size(F.array_intersect("of_q", "of_s")), lambda c: F.size(F.split(c, " ")) - 1
    enough = (shared >= F.size("of_q") - 3 * gone - 2 * come - spaces("q")) & (shared >= F.size("of_s") - 3 * come - 2 * gone - spaces("s"))
    met = reduce(DataFrame.unionByName, (counted.where(enough).select("q", "s"), *(w.where(long < 1.5 * short) for w in by_words)))
    return met.distinct()


def match_streets(queries: DataFrame, streets: DataFrame, street: str = "street") -> DataFrame:
    """Adds cdlog, matched and score: the street whose name is most like the query's, if
    it is by MIN_SCORE (likeness(), on normal forms).  An equal name wins by a join on
    it; others are compared with candidate_pairs()."""
    s = streets.select("cdlog", norm(F.col("name")).alias("s")).where("s <> ''").groupBy("s").agg(F.max("cdlog").alias("cdlog"))
    q = queries.select(norm(F.col(street)).alias("q")).where("q <> ''").distinct()
    equal = q.join(s, F.col("q") == F.col("s")).select("q", "s", "cdlog", F.lit(100.0).alias("score"))
    rest = q.join(s, F.col("q") == F.col("s"), "left_anti")
    score = F.pandas_udf(lambda a, b: pd.Series([likeness(x, y) for x, y in zip(a, b)], dtype="float64"), "double")
    close = candidate_pairs(rest.select(F.col("q").alias("name")), s.select(F.col("s").alias("name"))).withColumn("score", score("q", "s")).where(F.col("score") >= MIN_SCORE)
    best = close.join(s, "s").groupBy("q").agg(F.max_by(F.struct("s", "cdlog", "score"), F.struct("score", "cdlog", "s")).alias("b")).select("q", "b.*")
    found = equal.unionByName(best.select("q", "s", "cdlog", "score"))
    out = queries.withColumn("q", norm(F.col(street))).join(found.select("q", F.col("s").alias("matched"), "cdlog", "score"), "q", "left")
    return out.drop("q")


def street_index(records: DataFrame) -> DataFrame:
    """(cdlog, name) from records (ordinal, cdlog, name, short_name) of a street axis: of
    records that share a name in capitals, white space collapsed, the last one has it,
    its short name after its name."""
    upper = lambda c: F.trim(F.regexp_replace(F.upper(F.coalesce(F.col(c), F.lit(""))), r"(?U)\s+", " "))
    names = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), upper(c).alias("name")) for k, c in enumerate(("name", "short_name")))))
    each = records.where("cdlog IS NOT NULL").select("ordinal", "cdlog", names.alias("n")).where("n.name <> ''")
    return each.groupBy(F.col("n.name").alias("name")).agg(F.max_by("cdlog", F.struct("ordinal", "n.field")).alias("cdlog")).select("cdlog", "name")


def first_queries(df: DataFrame, query: Column, row_id: str, most: int) -> DataFrame:
    """(query): the `most` distinct queries, not empty, that come first by row id, for
    services that limit how many may be asked."""
    return df.select(F.trim(query).alias("query"), row_id).where("query <> ''").groupBy("query").agg(F.min(row_id).alias("_at")).orderBy("_at", "query").limit(max(1, most)).select("query")


def number_range(number: Column) -> tuple[Column, Column]:
    """Ends of a segment's range on the side of the number's parity."""
    even = number % 2 == 0
    return F.when(even, F.col("even_from")).otherwise(F.col("odd_from")), F.when(even, F.col("even_to")).otherwise(F.col("odd_to"))


def match_segments(addresses: DataFrame, segments: DataFrame, key: str = "query") -> DataFrame:
    """For each address (cdlog, number) the first segment whose range holds the number,
    with fraction: how far along it lies (0.5 where the range is one number)."""
    a, b = number_range(F.col("number"))
    j = addresses.join(segments, "cdlog").withColumns({"_a": a, "_b": b})
    j = j.where(F.col("number").between(F.least("_a", "_b"), F.greatest("_a", "_b")))
    j = j.withColumn("fraction", F.when(F.col("_a") == F.col("_b"), 0.5).otherwise((F.col("number") - F.col("_a")) / (F.col("_b") - F.col("_a"))))
    first = j.groupBy(key).agg(F.min_by(F.struct("cdlog", "ordinal", "fraction", "points", "parts"), "ordinal").alias("s"))
    return first.select(key, "s.*")


def interpolate(points: Column, parts: Column, fraction: Column) -> Column:
    """The point at a fraction of the length of a line in parts; gaps between parts and
    pieces without length don't count."""
    n = F.size(points)
    breaks = F.array_union(parts, F.array(n))
    piece = lambda i: F.struct(points[i].x.alias("x1"), points[i].y.alias("y1"), points[i + 1].x.alias("x2"), points[i + 1].y.alias("y2"), F.hypot(points[i + 1].x - points[i].x, points[i + 1].y - points[i].y).alias("d"))
    pieces = F.filter(F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: (i + 1 < n) & ~F.array_contains(breaks, i + 1)), piece), lambda p: p.d > 0)
    total = F.aggregate(pieces, F.lit(0.0), lambda a, p: a + p.d)
    want = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction)) * total
    start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

    def step(acc, p):
        t = (want - acc.run) / p.d
        here = acc.x.isNull() & (acc.run + p.d >= want - 1e-12)
        return F.struct((acc.run + p.d).alias("run"), F.when(here, p.x1 + t * (p.x2 - p.x1)).otherwise(acc.x).alias("x"), F.when(here, p.y1 + t * (p.y2 - p.y1)).otherwise(acc.y).alias("y"))

    found = F.aggregate(pieces, start, step)
    only = F.when(n > 0, F.struct(points[0].x.alias("x"), points[0].y.alias("y")))
    return F.when(F.size(pieces) > 0, F.struct(found.x.alias("x"), found.y.alias("y"))).otherwise(only)


def transverse_mercator_inverse(x: Column, y: Column, lat0: float, lon0: float, k0: float, fe: float, fn: float, a: float = 6378137.0, f: float = 1 / 298.257222101) -> tuple[Column, Column]:
    """Latitude and longitude of projected coordinates (series to the sixth order)."""
    from math import radians, sin

    e2 = f * (2 - f)
    ep2, e1 = e2 / (1 - e2), (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    arc = lambda p: a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * sin(2 * p) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * sin(4 * p) - (35 * e2**3 / 3072) * sin(6 * p))
    m = F.lit(arc(radians(lat0))) + (y - fn) / k0
    mu = m / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    p1 = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu)
    c1, t1 = ep2 * F.cos(p1) ** 2, F.tan(p1) ** 2
    w = 1 - e2 * F.sin(p1) ** 2
    n1, r1 = a / F.sqrt(w), a * (1 - e2) / F.pow(w, 1.5)
    d = (x - fe) / (n1 * k0)
    lat = p1 - (n1 * F.tan(p1) / r1) * (d**2 / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1**2 - 9 * ep2) * d**4 / 24 + (61 + 90 * t1 + 298 * c1 + 45 * t1**2 - 252 * ep2 - 3 * c1**2) * d**6 / 720)
    lon = F.lit(radians(lon0)) + (d - (1 + 2 * t1 + c1) * d**3 / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1**2 + 8 * ep2 + 24 * t1**2) * d**5 / 120) / F.cos(p1)
    return F.degrees(lat), F.degrees(lon)


def geocode(queries: DataFrame, streets: DataFrame, segments: DataFrame, projection: dict | None = None) -> DataFrame:
    """(query, lat, lon, method, matched, score, cdlog, failure) of distinct queries."""
    q = queries.select("query").where(F.col("query") != "").distinct()
    street, number = street_and_number(F.col("query"))
    q = match_streets(q.withColumns({"street": street, "number": number}), streets)
    seg = match_segments(q.where("cdlog IS NOT NULL AND number IS NOT NULL"), segments)
    seg = seg.withColumn("p", interpolate(F.col("points"), F.col("parts"), F.col("fraction")))
    x, y = F.col("p.x"), F.col("p.y")
    lat, lon = (y, x) if projection is None else transverse_mercator_inverse(x, y, **projection)
    out = q.join(seg.select("query", lat.alias("lat"), lon.alias("lon")), "query", "left")
    failure = F.when(F.col("number").isNull(), "no door number").when(F.col("cdlog").isNull(), "street not found").when(F.col("lat").isNull(), "no segment holds the number")
    return out.select("query", "lat", "lon", F.when(F.col("lat").isNotNull(), "street axis").alias("method"), "matched", "score", "cdlog", failure.alias("failure"))


def attach(df: DataFrame, query: Column, found: DataFrame, lat: str | None = None, lon: str | None = None) -> DataFrame:
    """Adds coordinates by query; valid coordinates of the sheet come first."""
    g = found.select(F.col("query").alias("_q"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("method").alias("_method"))
    out = df.withColumn("_query", query).join(g, F.col("_query") == F.col("_q"), "left")
    own = valid_coordinates(F.col(lat), F.col(lon)) if lat and lon else F.lit(False)
    pick = lambda a, b: F.when(own, F.col(a)).otherwise(F.col(b)) if a else F.col(b)
    method = F.when(own, "coordenadas da planilha").otherwise(F.col("_method"))
    return out.withColumns({"_geo_lat": pick(lat, "_lat"), "_geo_lon": pick(lon, "_lon"), "_geo_method": method}).drop("_q", "_lat", "_lon", "_method", "_query")
