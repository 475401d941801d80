"""Quality rules: lines labelled by a linear-chain conditional random field.

Each line of a text has a few shape features (words, symbols, capitals, digits,
repetition, punctuation); a chain over the lines marks each as content or
boilerplate by Viterbi decoding, so a doubtful line goes with its neighbours.  A
document is kept if enough of its words lie in content lines and the base rules
don't fail it.

The field is fitted by gradient ascent on the conditional likelihood of lines that
inherit their document's quality label, all lines of about `max_labelled` documents
drawn by a hash of their id (at most 1.2 times as many labels); beyond DRIVER_LINES of
them tasks sum the gradients of each step.  Everything else reads all documents whole,
without a shuffle.

Null or empty text: no words, base rules fail.  Ties in decoding go to content.
Without labels of both kinds every line is content.  Repeated rows are judged each
on its own; extra columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import written

DRIVER_LINES = 500_000  # 20 MB of features
SYMBOL = tx.byte_set(b"#*$%&|<>")
DIGIT = tx.byte_set(b"0123456789")
UPPER = tx.byte_set(bytes(range(65, 91)))
LETTER = tx.byte_set(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
POINT = np.array([b & 0xC0 != 0x80 for b in range(256)])  # first bytes of code points
STOP = tx.byte_set(b".!?:;")
N_FEATURES = 10
WINDOW = 8
MIN_WORDS, REPEAT_PERCENT = 20, 30


def _sums(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(mask, dtype=np.int64)])
    return total[ends] - total[starts]


def analyse(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base counts [document, 5], line features [line, N_FEATURES], words of each
    line, and each document's first line."""
    n = len(offsets) - 1
    starts, ends, first = tx.spans(~tx.WHITE[data], offsets)
    hashes = tx.span_hashes(data, starts, ends)
    grams, at = tx.gram_hashes(hashes, first, WINDOW)
    doc = np.searchsorted(first, at, "right") - 1
    _, back, times = np.unique(tx.mix(grams ^ tx.mix(doc.astype(np.uint64))), return_inverse=True, return_counts=True)
    twice = at[times[back.reshape(-1)] >= 2]
    edge = np.bincount(twice, minlength=len(starts) + 1)[: len(starts) + 1] - np.bincount(np.minimum(twice + WINDOW, len(starts)), minlength=len(starts) + 1)[: len(starts) + 1]
    repeated = np.cumsum(edge)[: len(starts)] > 0

    newline = np.flatnonzero(data == 10)
    opening = np.union1d(offsets[:-1][np.diff(offsets) > 0], newline + 1)
    opening = opening[opening < len(data)] if len(data) else opening[:0]
    closing = np.append(opening[1:], len(data))[: len(opening)]
    ends_nl = closing - (data[closing - 1] == 10) if len(opening) else closing
    first_line = np.searchsorted(opening, offsets)
    line_words = np.searchsorted(starts, closing) - np.searchsorted(starts, opening)
    line_hash = tx.span_hashes(data, opening, ends_nl)
    line_doc = np.searchsorted(first_line, np.arange(len(opening)), "right") - 1
    with_word = np.flatnonzero(line_words > 0)
    dup = np.zeros(len(opening), bool)
    if len(with_word):
        _, where, back = np.unique(tx.mix(line_hash[with_word] ^ tx.mix(line_doc[with_word].astype(np.uint64))), return_index=True, return_inverse=True)
        dup[with_word] = where[back.reshape(-1)] != np.arange(len(with_word))

    points = POINT[data]
    chars = _sums(points & ~tx.WHITE[data], opening, closing)
    letters, upper = _sums(LETTER[data], opening, closing), _sums(UPPER[data], opening, closing)
    symbols, digits = _sums(SYMBOL[data], opening, closing), _sums(DIGIT[data], opening, closing)
    rep = np.concatenate([np.zeros(1, np.int64), np.cumsum(repeated)])
    w0 = np.searchsorted(starts, opening)
    line_rep = rep[w0 + line_words] - rep[w0]
    last = np.zeros(len(opening), bool)
    some = line_words > 0
    last[some] = STOP[data[ends[w0[some] + line_words[some] - 1] - 1]]
    per = np.maximum(chars, 1)
    words = np.maximum(line_words, 1)
    feats = np.stack([
        np.ones(len(opening)), np.log1p(line_words) / 5, np.minimum(1, 4 * symbols / per), upper / np.maximum(letters, 1), digits / per,
        np.clip(chars / words / 20, 0, 1), last, dup, line_rep / words, np.clip(letters / (LETTER_BYTES * per), 0, 1),
    ], 1).astype(np.float32)
    base = np.stack([
        np.diff(first), _sums(points & ~tx.WHITE[data], offsets[:-1], offsets[1:]), _sums(SYMBOL[data], offsets[:-1], offsets[1:]),
        np.bincount(line_doc[dup], minlength=n)[:n], tx.per_document(repeated.astype(np.int64), first),
    ], 1).astype(np.int64)
    return base, feats, line_words, first_line


LETTER_BYTES = 1.2  # bytes of a letter, about, in the texts' languages


@dataclass
class LineCrf:
    """Weights of features [2, N_FEATURES] and of label pairs [2, 2]; label 0 is
    content, 1 boilerplate."""

    emit: np.ndarray
    pair: np.ndarray

    def decode(self, feats: np.ndarray, first_line: np.ndarray) -> np.ndarray:
        """Best labels of the lines of each document; documents move in step."""
        score = feats @ self.emit.T
        lens = np.diff(first_line)
        order = np.argsort(-lens, kind="stable")
        begin, lens = first_line[:-1][order], lens[order]
        back = np.zeros((len(feats), 2), np.int8)
        best = np.zeros((len(order), 2))
        for t in range(int(lens[0]) if len(lens) else 0):
            live = int(np.searchsorted(-lens, -t, "left"))
            if t:
                step = best[:live, :, None] + self.pair
                back[begin[:live] + t] = step.argmax(1)
                best[:live] = step.max(1)
            best[:live] += score[begin[:live] + t]
        labels = np.zeros(len(feats), np.int8)
        state = best.argmax(1)
        for t in range(int(lens[0]) - 1 if len(lens) else -1, -1, -1):
            live = int(np.searchsorted(-lens, -t, "left"))
            labels[begin[:live] + t] = state[:live]
            state[:live] = back[begin[:live] + t, state[:live]]
        return labels


def gradient(emit: np.ndarray, pair: np.ndarray, feats: np.ndarray, first_line: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Gradient of the conditional log likelihood, by forward and backward passes over
    all documents in step."""
    lens = np.diff(first_line)
    order = np.argsort(-lens, kind="stable")
    begin, lens = first_line[:-1][order], lens[order]
    lives = [int(np.searchsorted(-lens, -t, "left")) for t in range(int(lens[0]) if len(lens) else 0)]
    gold = np.eye(2)[labels]
    lse = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    score = feats @ emit.T
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    for t, live in enumerate(lives):
        at = begin[:live] + t
        alpha[at] = score[at] + (lse(alpha[at - 1][:, :, None] + pair, 1) if t else 0)
    for t in range(len(lives) - 2, -1, -1):
        at = begin[: lives[t + 1]] + t
        beta[at] = lse(pair + (score[at + 1] + beta[at + 1])[:, None, :], 2)
    p = np.exp(alpha + beta - lse(alpha + beta, 1)[:, None])
    g_emit = (gold - p).T @ feats
    later = np.ones(len(feats), bool)
    later[first_line[:-1][np.diff(first_line) > 0]] = False
    at = np.flatnonzero(later)
    joint = alpha[at - 1][:, :, None] + pair + (score[at] + beta[at])[:, None, :]
    joint = np.exp(joint - lse(joint.reshape(len(at), 4), 1)[:, None, None])
    g_pair = np.einsum("na,nb->ab", gold[at - 1], gold[at]) - joint.sum(0)
    return np.append(g_emit, g_pair)


def ascend(slope, n_lines: int, n_features: int, steps: int = 120, l2: float = 1e-3) -> LineCrf:
    """Follows slope(emit, pair), the gradient over all n_lines (Adam)."""
    emit, pair = np.zeros((2, n_features)), np.zeros((2, 2))
    m, v = np.zeros(emit.size + 4), np.zeros(emit.size + 4)
    for it in range(1, steps + 1):
        g = slope(emit, pair) / max(1, n_lines) - l2 * np.append(emit, pair)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.3 * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.999**it)) + 1e-8)
        emit, pair = emit + step[:-4].reshape(emit.shape), pair + step[-4:].reshape(2, 2)
    return LineCrf(emit, pair)


def train(feats: np.ndarray, first_line: np.ndarray, labels: np.ndarray, steps: int = 120, l2: float = 1e-3) -> LineCrf:
    """Maximises the conditional log likelihood of lines at hand."""
    return ascend(lambda emit, pair: gradient(emit, pair, feats, first_line, labels), len(feats), feats.shape[1], steps, l2)


def _together(labels: list[int], blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, first lines and line labels of documents (1 is content)."""
    feats = np.frombuffer(b"".join(blobs), np.float32).reshape(-1, N_FEATURES)
    lens = np.array([len(b) // (4 * N_FEATURES) for b in blobs], np.int64)
    return feats, np.concatenate([np.zeros(1, np.int64), np.cumsum(lens)]), np.repeat(1 - np.array(labels, np.int64), lens)


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", max_labelled=2_000, driver_lines=DRIVER_LINES) -> LineCrf:
    """A field fitted on documents with label 1 (content) or 0 (boilerplate)."""
    from .toxicity import _labelled

    rows = _labelled(docs, labels, id_col, text_col, label_col, max_labelled)

    def lines(batches):
        for batch in batches:
            for k, _, data, offsets in tx.text_slices(batch.column(1)):
                _, feats, _, first = analyse(data, offsets)
                out = [feats[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, len(out)), pa.array(out, pa.binary())], ["y", "f"])

    sample = written(rows.mapInArrow(lines, "y int, f binary")).where(F.octet_length("f") > 0)
    size = sample.agg(F.sum(F.octet_length("f")).alias("bytes"), F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    if size.bytes is None or size.lo == size.hi:
        return LineCrf(np.stack([np.eye(N_FEATURES)[0], np.zeros(N_FEATURES)]), np.zeros((2, 2)))
    n = size.bytes // (4 * N_FEATURES)
    if n <= driver_lines:
        got = sample.collect()
        return train(*_together([r.y for r in got], [bytes(r.f) for r in got]))

    def slope(emit, pair):
        def run(batches):
            total = np.zeros(emit.size + 4)
            for batch in batches:
                total += gradient(emit, pair, *_together(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["g"])

        return np.sum([r.g for r in sample.mapInArrow(run, "g array<double>").collect()], 0)

    return ascend(slope, n, N_FEATURES)


def judge(docs: DataFrame, model: LineCrf, id_col="doc_id", text_col="text", min_content: float = 0.5, with_spans: bool = False) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, content_share) of every row; with `with_spans` also
    line_labels, an array of 0 (content) and 1 (boilerplate) by line."""
    shared = docs.sparkSession.sparkContext.broadcast((model.emit, model.pair))
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double" + ", line_labels array<tinyint>" * with_spans

    def run(batches):
        crf = LineCrf(*shared.value)
        for batch in batches:
            parts, shares, spans = [np.zeros((0, 5), np.int64)], [np.zeros(0)], []
            for _, _, data, offsets in tx.text_slices(batch.column(1)):
                base, feats, line_words, first = analyse(data, offsets)
                labels = crf.decode(feats, first)
                good = tx.per_document(np.where(labels == 0, line_words, 0), first)
                parts.append(base)
                shares.append(good / np.maximum(base[:, 0], 1))
                if with_spans:
                    spans += [labels[a:b].tolist() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            base, share = np.concatenate(parts), np.concatenate(shares)
            failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > REPEAT_PERCENT * base[:, 0])
            cols = [batch.column(0), *(pa.array(base[:, k]) for k in range(5)), pa.array(failed), pa.array(~failed & (share >= min_content)), pa.array(share)]
            if with_spans:
                cols.append(pa.array(spans, pa.list_(pa.int8())))
            yield pa.RecordBatch.from_arrays(cols, [f.split(" ")[0] for f in schema.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
