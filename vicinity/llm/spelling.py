"""Spelling variants: words one edit apart, by a bit-sliced position index.

Words are maximal runs of letters of all texts, A-Z in lower case; by a rule of the
hash of document and run, some lose one letter.  Those of `least_length` letters and
`least_count` occurrences are the vocabulary.

Words one inserted, deleted or replaced letter apart agree in their first half or in
the rest, whichever the edit leaves alone.  So the words of a length and the next are
dealt to regions by their first half, and again by the rest, and only words of a region
are compared.  Regions are put together into groups of `group` letters on average; one
of more than `tile` letters is dealt out as pairs of tiles.  In a group every letter of
every position has a bitset over the group's entries, and a word's letters are followed
through the positions for 64 entries at once: the set that agrees so far, and the sets
with one error so far, with the entry's position shifted by none (replaced), one more
(inserted) or one less (deleted).  A pair that agrees in both halves is taken in the
region of the first.  Each word leaves a group as one row: how many words are near it
and the best of them; no pair is emitted.

A word's form is its commonest near word (ties: first in code-point order) if that is
`ratio` times as common; its root is where forms lead in the end.

Null texts and texts without letters have no words; a null id counts as an empty text;
rows that repeat count again; an empty table gives no rows.  Other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AT_ONCE = 1 << 18  # 64-bit words of a set of bitsets


def damaged(key: Column, word: Column, one_in: int = 199) -> Column:
    """The word, without the letter that the hash of key and word names where one_in divides it."""
    h = F.crc32(F.concat(key, word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % one_in == 0, F.concat(word.substr(F.lit(1), at), word.substr(at + 2, F.length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, id_col="doc_id", text_col="text") -> DataFrame:
    """(word, n).  Shorter runs can't give a word and are left out before rows are made of runs."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTERS}{{{least_length},}}+"), F.lit(0))
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"))
    words = docs.select(key.alias("key"), F.explode(runs).alias("run")).select("key", F.translate("run", UPPER, LOWER).alias("run"))
    words = words.select(damaged(F.col("key"), F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def near_of_length(letters: np.ndarray, longer: np.ndarray, suffix: np.ndarray, region: np.ndarray, tile: np.ndarray, two_tiles: np.ndarray):
    """Yields (entries, bitsets of the entries near each) for the words of two lengths
    that follow each other.  letters: entries x positions, zero where a shorter word has
    ended; longer: whether a word has the greater length; suffix: whether the words of
    its region agree in the rest rather than the first half; two_tiles: whether only
    entries of the other tile count."""
    n, deep = letters.shape
    short, width = deep - 1, -(-n // 64)

    def packed(flags):  # rows of flags as bitsets
        bits = np.zeros((len(flags), width * 64), np.uint8)
        bits[:, :n] = flags
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    def sets(values):  # the bitsets of entries with each value, and which of them each entry's is
        kinds, at = np.unique(values, return_inverse=True)
        return packed(values[None, :] == kinds[:, None]), at.reshape(-1)

    alphabet, coded = np.unique(letters, return_inverse=True)
    coded = coded.reshape(letters.shape)
    kinds = np.arange(len(alphabet))[:, None]
    index = lambda p: packed(coded[:, p][None, :] == kinds) if 0 <= p < deep else np.zeros((len(kinds), width), np.uint64)
    in_region, of_region = sets(region)
    in_tile, of_tile = sets(tile)
    long_ones, no_set = packed(longer[None, :])[0], np.uint64(0)
    for at in range(0, n, rows := max(1, AT_ONCE // width)):
        q = np.arange(at, min(n, at + rows))
        start = in_region[of_region[q]]
        start = np.where(two_tiles[q][:, None], start & ~in_tile[of_tile[q]], start)
        exact, replaced, inserted, deleted, halfway = start, np.zeros_like(start), start, np.zeros_like(start), start
        before, here, after = (index(p) for p in (-1, 0, 1))
        near = None
        for j in range(deep):
            c = coded[q, j]
            agree = exact & here[c]
            replaced = (replaced & here[c]) | (exact & ~here[c])
            inserted = (inserted & after[c]) | agree
            deleted = (deleted & before[c]) | exact
            exact = agree
            halfway = exact if j + 1 == short // 2 else halfway
            if j + 1 == short:  # where the shorter words end
                near = np.where(longer[q][:, None], no_set, (replaced & ~long_ones) | (inserted & long_ones))
            before, here, after = here, after, index(j + 2)
        near = np.where(longer[q][:, None], deleted & ~long_ones, near)
        yield q, np.where(suffix[q][:, None], near & ~halfway, near)


def _best(q, near, n, rank):
    """Of each row of bitsets: how many entries, and the one with the largest n (ties: lowest rank)."""
    rows, entries = np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little"))
    if not len(rows):
        return q[:0], rows, rows
    order = np.lexsort((rank[entries], -n[entries], rows))
    first = np.unique(rows[order], return_index=True)[1]
    got = rows[order][first]
    return q[got], np.bincount(rows)[got], entries[order][first]


def near_words(words: DataFrame, tile: int = 1 << 15, group: int = 1 << 14) -> DataFrame:
    """(word, n_near, form, form_n) of the words (word, n) that have near ones; form is
    the commonest near word."""
    size = F.length("word")
    sides = F.explode(F.array(*(F.struct((size - k).alias("short"), F.lit(s).alias("suffix")) for k in (0, 1) for s in (False, True))))
    half = F.floor(F.col("short") / 2).cast("int")
    rest = F.col("short") - half
    e = words.select("word", "n", sides.alias("x")).select("word", "n", "x.short", "x.suffix")
    e = e.withColumn("part", F.when(F.col("suffix"), F.col("word").substr(size - rest + 1, rest)).otherwise(F.col("word").substr(F.lit(1), half)))
    region = ["short", "suffix", "part"]
    # A region without words of its shorter length has only pairs that belong to another.
    counts = e.groupBy(*region).agg(F.count("*").alias("entries"), F.min(F.length("word") - F.col("short")).alias("least")).where("entries > 1 AND least = 0")
    tiles = F.least("entries", F.ceil(F.col("entries") * F.col("short") / tile)).cast("int")
    counts = written(counts.select(*region, tiles.alias("tiles"), (F.col("entries") * F.col("short")).alias("letters")))
    groups = max(1, -(-(counts.agg(F.sum("letters")).first()[0] or 0) // group))
    e = e.join(counts, region)
    e = e.withColumn("t", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    e = e.withColumns({"i": F.least("t", "o"), "j": F.greatest("t", "o")}).withColumn("region", F.xxhash64(*region, "i", "j"))
    e = e.withColumn("bin", F.when(F.col("tiles") > 1, F.col("region")).otherwise(F.pmod("region", F.lit(groups))))

    def run(table):
        table = table.sort_by("word")  # by UTF-8, the order of code points
        out = []
        for short in np.unique(table.column("short").to_numpy()):
            part = table.filter(pa.compute.equal(table.column("short"), pa.scalar(short)))
            get = lambda c: part.column(c).to_numpy()  # noqa: E731, B023
            word = part.column("word").to_pylist()
            length = np.array([len(w) for w in word])
            letters = np.zeros((len(word), short + 1), np.int32)
            letters[np.arange(short + 1)[None, :] < length[:, None]] = np.frombuffer("".join(word).encode("utf-32-le"), np.int32)
            n, names = get("n"), part.column("word")
            for q, near in near_of_length(letters, length > short, get("suffix"), get("region"), get("t"), get("i") < get("j")):
                q, count, best = _best(q, near, n, np.arange(len(word)))
                out.append(pa.table({"word": names.take(pa.array(q)), "n_near": pa.array(count, pa.int64()), "form": names.take(pa.array(best)), "form_n": pa.array(n[best], pa.int64())}))
        return pa.concat_tables(out)

    found = e.select("word", "n", "short", "suffix", "t", "i", "j", "region", "bin").groupBy("bin").applyInArrow(run, "word string, n_near long, form string, form_n long")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("r"), "form")).alias("b")).select("word", "n_near", "b.form", (-F.col("b.r")).alias("form_n"))


def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, id_col="doc_id", text_col="text", tile: int = 1 << 15) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    words = written(vocabulary(docs, least_length, least_count, id_col, text_col))
    known = words.join(near_words(words, tile), "word", "left")
    better = F.col("form_n") >= ratio * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(better, F.col("form")).alias("form"), F.when(better, F.col("form_n")).alias("form_n"))
    known = written(known)
    roots = known.select("word", F.coalesce("form", "word").alias("root"))
    while True:  # each turn doubles the way followed; counts rise `ratio` times a step, so ways are short
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next")).where("root != next")
        roots = written(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = roots.where("moved").limit(1).count()
        roots = roots.drop("moved")
        if not moved:
            break
    return known.join(roots, "word").select("word", "form", "root", "n", "n_near", "form_n")
