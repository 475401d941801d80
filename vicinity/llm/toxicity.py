"""Counterfactual-regularised toxicity classifier.

A logistic model over the words of a whole text (letters only, ASCII lower case,
hashed to `2**bits` features, presence not count).  It is fitted with a penalty on
counterfactuals: wherever a labelled text names a group, the name is swapped for
each other identity term, and the squared change of the score's logit counts
against the model.  Neutral mentions of a group then can't carry the score.

Fitting is bounded: labelled rows are drawn by a hash of their id at a rate that
gives about `max_labelled` of them, and at most 1.2 times as many are broadcast as
the labels to join.  Which words matter is decided on those rows by Spark (sums by
feature), at most `max_features` of them reach the driver; the driver then fits on
rows of selected features only.  Scoring reads every text whole, with no shuffle.

Null or empty text: the score of a text without words.  Null labels are ignored,
rows labelled twice count twice.  Without labels of both kinds the score is the
rate of toxic labels (0.5 without labels).  Extra columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import tidy

#: Identity terms that are swapped for one another; a parameter of fit().
IDENTITY_TERMS = (
    "women men girls boys muslim muslims christian christians jewish jews hindu hindus buddhist buddhists atheist atheists "
    "black white asian african european latino latina immigrant immigrants refugee refugees gay lesbian bisexual straight "
    "transgender disabled blind deaf elderly frauen männer muslime christen juden femmes hommes musulmans juifs mujeres hombres musulmanes judíos"
).split()

LETTER = tx.byte_set(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


@dataclass
class ToxicityModel:
    bits: int
    bias: float
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def table(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.features] = self.weights
        return out


def word_features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature of every word of a slice, and each document's first word."""
    starts, ends, first = tx.spans(LETTER[data], offsets)
    return (tx.span_hashes(tx.LOWER[data], starts, ends) >> np.uint64(64 - bits)).astype(np.int64), first


def _distinct(features: np.ndarray, first: np.ndarray):
    """Distinct features of each document in turn."""
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        yield np.unique(features[a:b])


def _labelled(docs: DataFrame, labels: DataFrame, id_col, text_col, label_col, most: int) -> DataFrame:
    """Texts with labels, for about `most` labelled rows."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(6)), F.lit(1_000_000)) < int(1e6 * most / n))
    rows = rows.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).limit(most + most // 5)
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(rows), "k").select("y", "t")


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", identity_terms=tuple(IDENTITY_TERMS), bits=20, max_labelled=8_000, max_features=1_000, l2=0.05, fairness=5.0) -> ToxicityModel:
    """`labels` holds the rows that may be learned from."""
    rows = _labelled(docs, labels, id_col, text_col, label_col, max_labelled)

    def count(batches):
        pos, neg, totals = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32), [0, 0]
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            totals[0] += int((y == 0).sum())
            totals[1] += int((y == 1).sum())
            for a, b, data, offsets in tx.text_slices(batch.column(1), tx.SMALL_SLICE):
                features, first = word_features(data, offsets, bits)
                for label, own in zip(y[a:b].tolist(), _distinct(features, first)):
                    (pos if label else neg)[own] += 1
        used = np.flatnonzero(pos + neg >= 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(pos[used], totals[1]).astype(np.int64)), pa.array(np.append(neg[used], totals[0]).astype(np.int64))], ["f", "p", "n"])

    counts = rows.mapInArrow(tidy(count), "f long, p long, n long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    total = counts.where("f = -1").first()
    if total is None or not total.p + total.n:
        return ToxicityModel(bits, 0.0)
    if not total.p or not total.n:
        return ToxicityModel(bits, float(np.log((total.p + 1e-6) / (total.n + 1e-6))))
    rate = (F.col("p") / F.lit(total.p)) - (F.col("n") / F.lit(total.n))
    both = (F.col("p") + F.col("n")) / F.lit(total.p + total.n)
    z = F.abs(rate) / F.sqrt((both * (1 - both) + 1e-9) * F.lit(1 / total.p + 1 / total.n))
    top = counts.where((F.col("f") >= 0) & (F.col("p") + F.col("n") >= 3)).select("f", z.alias("z")).where("z > 4").orderBy(F.desc("z"), "f").limit(max_features).collect()
    terms = pa.array(list(identity_terms), pa.string())
    groups = np.concatenate([word_features(data, offsets, bits)[0] for _, _, data, offsets in tx.text_slices(terms)] or [np.zeros(0, np.int64)])
    features = np.unique(np.concatenate([np.array([r.f for r in top], np.int64), groups]))
    chosen = docs.sparkSession.sparkContext.broadcast(features)

    def select(batches):
        keep = np.full(1 << bits, -1, np.int32)
        keep[chosen.value] = np.arange(len(chosen.value))
        for batch in batches:
            own = []
            for _, _, data, offsets in tx.text_slices(batch.column(1), tx.SMALL_SLICE):
                f, first = word_features(data, offsets, bits)
                own += [k[k >= 0].tolist() for k in (keep[u] for u in _distinct(f, first))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32()))], ["y", "f"])

    sample = rows.mapInArrow(tidy(select), "y int, f array<int>").toPandas()
    return _solve(sample, features, np.searchsorted(features, np.unique(groups)), bits, l2, fairness)


def _solve(sample, features, groups, bits, l2, fairness) -> ToxicityModel:
    """Minimises log loss + l2 + the counterfactual penalty by Newton steps on the
    features that occur, in numpy (rows and features are both bounded)."""
    y = sample.y.to_numpy(float)
    x = np.zeros((len(y), len(features)), np.float32)
    for k, f in enumerate(sample.f):
        x[k, np.asarray(f, np.int64)] = 1
    used = np.flatnonzero(x.sum(0) > 0)
    # a text that names group a, swapped to b: logit changes by w_b - w_a
    named = x[:, groups].sum(0)
    penalty = np.zeros((len(features), len(features)))
    for a, n in zip(groups, named):
        if n:
            for b in groups:
                if a != b:
                    d = fairness * n / len(groups)
                    penalty[a, a] += d
                    penalty[b, b] += d
                    penalty[a, b] -= d
                    penalty[b, a] -= d
    # features of equal groups of rows stay; the curvature is bounded by 1/4, so fixed steps converge
    used = np.union1d(used, groups[np.array([penalty[g, g] > 0 for g in groups], bool)] if len(groups) else groups).astype(int)
    x, penalty = x[:, used], penalty[np.ix_(used, used)]
    w, bias = np.zeros(len(used)), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-4).astype(np.float32)
        grad = x.T @ (p - y) + l2 * w + penalty @ w
        hess = (x.T * s) @ x + np.diag(np.full(len(used), l2)) + penalty
        cross = x.T @ s
        full = np.block([[hess, cross[:, None]], [cross[None, :], np.array([[s.sum()]])]])
        step = np.linalg.solve(full, np.append(grad, (p - y).sum()))
        size = min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
        w, bias = w - size * step[:-1], bias - size * step[-1]
        if np.abs(step).max() < 1e-5:
            break
    return ToxicityModel(bits, float(bias), features[used], w)


def score(docs: DataFrame, model: ToxicityModel, id_col="doc_id", text_col="text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, score, *carry) of every row; a word counts once however often it
    occurs.  Columns named in carry come along unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bits, model.bias, model.features, model.weights))

    def run(batches):
        m = ToxicityModel(*shared.value)
        table = m.table()
        for batch in batches:
            out = [np.zeros(0)]
            for a, b, data, offsets in tx.text_slices(batch.column(1), tx.SMALL_SLICE):
                f, first = word_features(data, offsets, m.bits)
                hit = np.flatnonzero(table[f])  # words that weigh anything
                doc = np.searchsorted(first, hit, "right") - 1
                pairs = np.unique(doc * (1 << m.bits) + f[hit])
                logit = m.bias + np.bincount(pairs >> m.bits, table[pairs & ((1 << m.bits) - 1)], b - a)
                out.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out)), *(batch.column(c) for c in carry)], [id_col, "score", *carry])

    schema = ", ".join(f"`{c}` {k}" for c, k in ((id_col, docs.schema[id_col].dataType.simpleString()), ("score", "double"), *((c, docs.schema[c].dataType.simpleString()) for c in carry)))
    return docs.select(id_col, text_col, *(c for c in carry if c not in (id_col, text_col))).mapInArrow(tidy(run), schema)
