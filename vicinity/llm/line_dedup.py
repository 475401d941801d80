"""Line dedup by winnowing, with DataFrame functions only.

A run is a stretch of lines (blank ones are skipped) of at least `min_lines` lines or
`min_words` words.  A run that occurs at an earlier place, in order of (id, text, line),
is deleted line by line; the first place stays.

1. Winnowing: from each line on, the shortest run is a window, and the line of its
   smallest hash is selected.  What is selected depends on the window alone, so every
   repeated run holds a selected line at the same point of all its places; lines that no
   window selects take no part in what follows.
2. Positions are joined by the hash of the selected line: those that occur once go.
3. Matches are extended both ways: around a selected line, every run of up to
   `min_lines` lines that holds it, to the left and to the right, is compared with its
   own first place, since a longer match may have its first place elsewhere than a
   shorter one.  Longer runs are chains of such: a run of min_lines lines or more has a
   selected line in each of its windows.

The result is that of the definition: a line goes if and only if it lies in a run that
occurs at an earlier place (ORACLE is written from it, without winnowing).

Minima are one small row a selected line.  A line that a third of all texts hold is a
hot key of such rows only: counts and first places are combined before their shuffle,
and AQE can split the joins.  Texts are shuffled once, to take the lines out.

Null text stays null, empty stays empty; rows with a null id are left alone.  Rows that
repeat an id are documents of their own, and what is deleted from one stays in the
other; rows that repeat id and text are one place, and are cleaned alike.  Lines are
compared by 64-bit hashes, of the selected line and the run together.  Columns of any
other names stay as they are, but for n_lines and n_removed, which are replaced.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written


def _words(line: Column) -> Column:
    t = F.trim(line)
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)


def _lines(text: Column) -> Column:
    """Lines that aren't blank, as structs of position, hash and words."""
    every = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("p"), F.xxhash64(x).alias("h"), _words(x).alias("w")))
    return F.filter(every, lambda r: r.w > 0)


def _is_run(rows: list[Column], min_words: int, min_lines: int) -> Column:
    """Whether lines (structs; null beyond the ends) that follow one another are a run."""
    there = reduce(lambda a, b: a & b, (r.isNotNull() for r in rows))
    return there if len(rows) >= min_lines else there & F.coalesce(sum((r.w for r in rows[1:]), rows[0].w) >= min_words, F.lit(False))


def _selected(lines: Column, min_words: int, min_lines: int) -> Column:
    """Numbers of the lines that windows select."""

    def window(line, i):
        at = [line, *(F.get(lines, i + k) for k in range(1, min_lines))]
        hashes = lambda n: F.array(*(r.h for r in at[:n]))
        least = lambda n: i + (F.array_position(hashes(n), F.array_min(hashes(n))) - 1).cast("int")
        return F.coalesce(*(F.when(_is_run(at[:n], min_words, min_lines), least(n)) for n in range(1, min_lines + 1)))

    return F.array_distinct(F.array_compact(F.transform(lines, window)))


def _runs(around: Column, centre: Column, min_words: int, min_lines: int) -> Column:
    """The runs of up to min_lines lines that hold the middle of `around`."""
    at = [F.get(around, F.lit(k)) for k in range(2 * min_lines - 1)]
    out = []
    for n in range(1, min_lines + 1):
        for a in range(min_lines - n, min_lines):
            own = at[a : a + n]
            run = F.struct(F.xxhash64(F.lit(n), *(r.h for r in own)).alias("run"), (centre + (a - min_lines + 1)).alias("start"), F.array(*(r.p for r in own)).alias("covers"))
            out.append(F.when(_is_run(own, min_words, min_lines), run))
    return F.array_compact(F.array(*out))


def repeated_lines(docs: DataFrame, id_col="doc_id", text_col="text", min_words: int = 50, min_lines: int = 3) -> DataFrame:
    """(id, t, removed array<int>): the numbers, from 0 and ascending, of lines to delete
    from the text of id with the hash t."""
    how = (min_words, min_lines)
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("t"), _lines(F.col(text_col)).alias("lines"))
    rows = rows.select("id", "t", "lines", _selected(F.col("lines"), *how).alias("at"))
    reach = min_lines - 1
    around = lambda i: F.transform(F.sequence(i - reach, i + reach), lambda k: F.get("lines", k))
    marks = F.transform("at", lambda i: F.struct(i.alias("i"), F.get("lines", i).h.alias("mark"), around(i).alias("around")))
    # explode_outer: a filter on the array's size would be pushed down and compute lines for every use
    marks = written(rows.select("id", "t", F.explode_outer(marks).alias("m")).where("m IS NOT NULL").select("id", "t", "m.*"))
    again = marks.groupBy("mark").agg(F.count("*").alias("places")).where("places > 1").select("mark")
    runs = marks.join(again, "mark").select("id", "t", "mark", F.explode_outer(_runs(F.col("around"), F.col("i"), *how)).alias("r")).where("r IS NOT NULL").select("id", "t", "mark", "r.*")
    place = F.struct("id", "t", "start")
    first = runs.groupBy("mark", "run").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("last > first").drop("last")
    later = runs.join(first, ["mark", "run"]).where(place > F.col("first"))
    return later.select("id", "t", F.explode("covers").alias("p")).groupBy("id", "t").agg(F.sort_array(F.collect_set("p")).alias("removed"))


def _mask(removed: Column) -> Column:
    """True at each of the ascending numbers, false between them."""
    gap = lambda p, j: F.concat(F.array_repeat(F.lit(False), p - F.coalesce(F.get(removed, j - 1), F.lit(-1)) - 1), F.array(F.lit(True)))
    return F.flatten(F.transform(removed, gap))


def dedup_lines(docs: DataFrame, id_col="doc_id", text_col="text", **how) -> DataFrame:
    """All columns of docs with the text cleaned, and n_lines (not blank), n_removed."""
    names = {c.lower() for c in docs.columns}
    own = lambda c: c if c not in names else own("_" + c)
    key, hashed, mask, count = map(own, ("gone_id", "gone_text", "gone_mask", "gone_count"))
    gone = repeated_lines(docs, id_col, text_col, **how)
    gone = gone.select(F.col("id").alias(key), F.col("t").alias(hashed), _mask(F.col("removed")).alias(mask), F.size("removed").alias(count))
    text = docs[text_col]
    joined = docs.join(gone, (docs[id_col] == F.col(key)) & (F.xxhash64(text) == F.col(hashed)), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.coalesce(F.get(F.col(mask), i), F.lit(False))), "\n")
    clean = F.when(F.col(mask).isNull() | text.isNull(), text).otherwise(kept)
    lines = F.when(text.isNull(), 0).otherwise(F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")))
    columns = [clean.alias(c) if c == text_col else docs[c] for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return joined.select(*columns, lines.alias("n_lines"), F.coalesce(F.col(count), F.lit(0)).alias("n_removed"))


#: What is to come out, in DuckDB's SQL, from the definition of a run and for the
#: defaults: every run of up to three lines is compared with its own first place.
ORACLE = """
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
n AS (
  SELECT *, length(trim(line)) - length(replace(trim(line), ' ', '')) + 1 AS w FROM l WHERE trim(line) <> ''),
x AS (
  SELECT doc_id, text, p, line AS a, w, lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c, lead(p, 1) OVER o AS pb, lead(p, 2) OVER o AS pc, lead(w, 1) OVER o AS wb
  FROM n WINDOW o AS (PARTITION BY doc_id, text ORDER BY p)),
r AS (
  SELECT doc_id, text, p, 1 AS size, a, NULL AS b, NULL AS c, [p] AS covers FROM x WHERE w >= 50
  UNION ALL SELECT doc_id, text, p, 2, a, b, NULL, [p, pb] FROM x WHERE b IS NOT NULL AND w + wb >= 50
  UNION ALL SELECT doc_id, text, p, 3, a, b, c, [p, pb, pc] FROM x WHERE c IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY size, a, b, c ORDER BY doc_id, text, p) AS place FROM r),
d AS (SELECT DISTINCT doc_id, unnest(covers) AS p FROM f WHERE place > 1),
g AS (SELECT doc_id, list(p) AS gone, count(*) AS n_removed FROM d GROUP BY doc_id)
SELECT t.doc_id, coalesce((SELECT count(*) FROM n WHERE n.doc_id = t.doc_id), 0) AS n_lines,
  coalesce(g.n_removed, 0) AS n_removed,
  md5(CASE WHEN g.gone IS NULL THEN t.text ELSE
    coalesce(array_to_string(list_filter(string_split(t.text, chr(10)), lambda v, j: NOT list_contains(g.gone, j - 1)), chr(10)), '') END) AS text_md5
FROM documents t LEFT JOIN g USING (doc_id)
"""
