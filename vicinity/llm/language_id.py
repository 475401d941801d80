"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text gives, at any position of
a new text, the longest match found in that language.  A text is cut greedily
into longest matches (phrases); the language that needs the fewest phrases per
letter wins.  Phrases don't cross white space, so the count of a text is the sum
over its words and each distinct word of a slice of texts is parsed once; the
parse runs over all those words in step, one automaton transition per letter (the
few that are much longer than the others end one by one, from the state they are
in); digits, punctuation and symbols are left out of both sides.

Every character of a language's sample has a symbol of its own.  Transitions by the
language's most frequent characters are a table, unless there are many languages;
all others are sparse.  A character that the sample lacks matches nothing.

Bounds: `train_chars` characters of labelled text per language are held, so its
automaton has at most 2 * train_chars states and 3 * train_chars transitions.  All
languages are learned, unless `max_languages` asks for the most frequent only.
Documents are scored whole, with no shuffle.

Null text or text without a letter: `und`, score 0.  Null or unlearned languages
are never predicted.  Ties go to the language that sorts first.  Without any
labelled text every document is `und`.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import tidy

SYMBOLS = 64  # symbols of the table
TABLES = 24  # languages up to which there are tables, of some 8 MB each
SEGMENT, FEW = 64, 32  # beyond so many letters, fewer words than these are ended one by one
POINTS = 0x110000
UND = "und"


def _automaton(codes: list[int], width: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest automaton that accepts exactly the substrings of `codes`; state 0 is
    the start.  Transitions by symbols below width are a table [state, symbol] -> state + 1
    or 0, of 16 bits where they do; those by others are keys (state << 32 | symbol), ascending, and states."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    table = np.zeros((len(step), width), np.uint16 if len(step) < 1 << 16 else np.int32)
    rare = {}
    for s, out in enumerate(step):
        for c, to in out.items():
            if c < width:
                table[s, c] = to + 1
            else:
                rare[s << 32 | c] = to
    keys = np.array(sorted(rare), np.int64)
    return table, keys, np.array([rare[k] for k in keys.tolist()], np.int32)


def suffix_automaton(codes: list[int]) -> np.ndarray:
    """The table alone, for codes below SYMBOLS."""
    return _automaton(codes)[0]


def fit(texts: dict[str, list[str]], train_chars: int) -> dict | None:
    """Automata by language from labelled texts (driver side, bounded input)."""
    joined = {lang: " ".join(re.sub(r"[^\w\s]|[\d_]", "", t.lower()) for t in texts[lang]) for lang in sorted(texts)}
    joined = {lang: " ".join(t.split())[:train_chars] for lang, t in joined.items()}
    joined = {k: v for k, v in joined.items() if v}
    if not joined:
        return None
    width = SYMBOLS if len(joined) <= TABLES else 1
    every = sorted(set().union(*joined.values()))
    index = {c: k for k, c in enumerate(every, 1)}
    char = np.zeros(POINTS, np.int32)  # 0: a character of no sample
    char[[ord(c) for c in every]] = np.arange(1, len(every) + 1)
    codes, automata = [], []
    for t in joined.values():
        code = np.zeros(len(every) + 1, np.int32)  # 0: a character that matches nothing
        for k, (c, _) in enumerate(sorted(Counter(t).items(), key=lambda x: (-x[1], x[0])), 1):
            code[index[c]] = k
        codes.append(code)
        automata.append(_automaton([int(code[index[c]]) for c in t], width))
    letter = np.fromiter((chr(c).isalpha() for c in range(POINTS)), bool, POINTS)
    return {"langs": list(joined), "char": char, "codes": codes, "letter": letter, "tables": automata}


def _walk(table: np.ndarray, rare: tuple[np.ndarray, np.ndarray]):
    """The transition of one state by one symbol, -1 without: reads the arrays as they
    are, so that nothing is held once the model is gone."""
    flat, width = memoryview(table.reshape(-1)), table.shape[1]
    keys, targets = map(memoryview, rare)

    def step(s: int, c: int) -> int:
        if c < width:
            return flat[s * width + c] - 1
        want = s << 32 | c
        at = bisect_left(keys, want)
        return targets[at] if at < len(keys) and keys[at] == want else -1

    return step


def phrases(table: np.ndarray, codes: np.ndarray, starts: np.ndarray, lens: np.ndarray, rare=(np.zeros(0, np.int64), np.zeros(0, np.int32))) -> np.ndarray:
    """Number of greedy longest matches in each segment of `codes`."""
    order = np.argsort(-lens, kind="stable")
    starts, lens = starts[order], lens[order]
    flat, width = table.reshape(-1), table.shape[1]
    keys, targets = rare

    def move(state, c):
        far = c >= width
        to = flat[state * width + np.where(far, 0, c)].astype(np.int64) - 1
        if far.any():
            to[far] = -1
            if len(keys):
                want = state[far] << 32 | c[far]
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                to[far] = np.where(keys[at] == want, targets[at], -1)
        return to

    state = np.zeros(len(starts), np.int64)
    count = np.zeros(len(starts), np.int64)
    live = len(starts)
    for t in range(int(lens[0]) if len(lens) else 0):
        live = int(np.searchsorted(-lens[:live], -t, "left"))
        if t >= SEGMENT and live < FEW:
            step = _walk(table, rare)
            for k in range(live):
                s, n = int(state[k]), 0
                for c in codes[starts[k] + t : starts[k] + lens[k]].tolist():
                    to = step(s, c)
                    if to < 0:
                        n += s > 0
                        to = step(0, c)
                        if to < 0:
                            n, to = n + 1, 0
                    s = to
                state[k] = s
                count[k] += n
            break
        c = codes[starts[:live] + t].astype(np.int64)
        to = move(state[:live], c)
        stuck = to < 0
        fresh = move(np.zeros(int(stuck.sum()), np.int64), c[stuck])
        begun = state[:live][stuck] > 0
        count[:live][stuck] += begun.astype(np.int64) + (fresh < 0)  # ends the phrase; an unknown character is one of its own
        to[stuck] = np.maximum(fresh, 0)
        state[:live] = to
    count += state > 0
    out = np.zeros(len(starts), np.int64)
    out[order] = count
    return out


def _word_counts(model: dict):
    def compute(store, words):
        lowered = [w.lower() for w in words]
        lens = np.fromiter(map(len, lowered), np.int64, len(lowered))
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
        letter = model["letter"][points]
        lens = np.bincount(np.repeat(np.arange(len(words)), lens)[letter], minlength=len(words))
        chars = model["char"][points[letter]]
        starts = np.cumsum(lens) - lens
        rows = np.empty((len(words), len(model["tables"]) + 1), np.float32)
        for k, (table, *rare) in enumerate(model["tables"]):
            rows[:, k] = phrases(table, model["codes"][k][chars], starts, lens, rare)
        rows[:, -1] = lens
        before = 0 if store is None else len(store)
        return (rows if store is None else np.concatenate([store, rows])), np.arange(before, before + len(rows))

    return compute


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, lang_pred, score, *carry) of every row.  score is 1 - phrases of the
    best language / mean phrases of the others, 0 to 1; 1 where only one is known.
    Columns named in carry come along unchanged."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        cache = tx.WordCache(_word_counts(m)) if m else None
        for batch in batches:
            langs, scores = [], []
            for a, b, data, offsets in tx.text_slices(batch.column(1), tx.SMALL_SLICE):
                n = b - a
                pred, score = np.full(n, -1), np.zeros(n)
                if m:
                    starts, ends, first = tx.spans(~tx.WHITE[data], offsets)
                    if len(starts):
                        store, rows = cache.look_up(data, starts, ends)
                        totals = np.stack([tx.per_document(store[rows, k].astype(np.int64), first) for k in range(store.shape[1])], 1).astype(float)
                        counts, letters = totals[:, :-1], totals[:, -1]
                        best = counts.argmin(1)
                        low = counts[np.arange(n), best]
                        others = (counts.sum(1) - low) / max(1, counts.shape[1] - 1)
                        some = letters > 0
                        pred[some] = best[some]
                        score[some] = 1 - low[some] / np.maximum(others[some], 1e-9) if counts.shape[1] > 1 else 1.0
                langs += [m["langs"][k] if k >= 0 else UND for k in pred.tolist()]
                scores.append(np.clip(score, 0, 1))
            own = [pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *own, *(batch.column(c) for c in carry)], [id_col, "lang_pred", "score", *carry])

    schema = ", ".join(f"`{c}` {k}" for c, k in ((id_col, docs.schema[id_col].dataType.simpleString()), ("lang_pred", "string"), ("score", "double"), *((c, docs.schema[c].dataType.simpleString()) for c in carry)))
    return docs.select(id_col, text_col, *(c for c in carry if c not in (id_col, text_col))).mapInArrow(tidy(run), schema)


def learn(docs: DataFrame, learnable: Column, id_col="doc_id", text_col="text", lang_col="lang", train_chars=30_000, max_languages: int | None = None) -> dict | None:
    """Fits the automata on labelled rows for which `learnable` holds.

    Rows are counted by language; then each language's rows are kept by a hash at a
    rate of its own that gives about twice the characters needed, and that with its
    smallest hash always.  Of a longer text a passage of `train_chars` letters, from a
    place that the hash gives, counts.  Equal texts of a language count once.
    """
    rows = docs.where(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    rows = rows.where(F.col("t").rlike("\\p{L}")).withColumn("d", F.pmod("h", F.lit(10**12)))
    counts = rows.groupBy("l").agg(F.sum(F.least(F.length("t"), F.lit(train_chars))).alias("c"), F.min("d").alias("least"))
    if max_languages is not None:
        counts = counts.orderBy(F.desc("c"), "l").limit(max_languages)
    counts = counts.collect()
    if not counts:
        return None
    rates = [(r.l, max(r.least, int(1e12 * min(1.0, 2.5 * train_chars / max(1, r.c))))) for r in counts]
    rates = docs.sparkSession.createDataFrame(rates, "l string, most long")
    drawn = rows.join(F.broadcast(rates), "l").where("d <= most")
    letters = F.regexp_replace("t", "[^\\p{L}\\s]", "")
    passage = F.substring(letters, F.pmod("d", F.greatest(F.lit(1), F.length(letters) - train_chars + 1)).cast("int") + 1, F.lit(train_chars))
    drawn = drawn.select("l", "d", F.when(F.length("t") > train_chars, passage).otherwise(F.col("t")).alias("t")).groupBy("l", "t").agg(F.min("d").alias("d"))
    texts: dict[str, list[str]] = {}
    held: Counter = Counter()
    for r in drawn.orderBy("d", "l", "t").collect():
        if held[r.l] < train_chars:
            texts.setdefault(r.l, []).append(r.t)
            held[r.l] += len(r.t)
    return fit(texts, train_chars)


def identify(docs: DataFrame, learnable: Column, id_col="doc_id", text_col="text", lang_col="lang", **bounds) -> DataFrame:
    """Learns from the labelled rows and predicts all rows."""
    return predict(docs, learn(docs, learnable, id_col, text_col, lang_col, **bounds), id_col, text_col)
