"""SentencePiece encoding and decoding with an Aho-Corasick driven Viterbi.

An automaton over all pieces reads a text once; at each position its output links
name every piece that ends there, and each relaxes the best score of the position
from the best score of where the piece starts.  The result is the segmentation
with the largest sum of the model's piece scores; of equal sums the one whose last
piece is longest.  Characters that no piece covers cost less than the worst piece
and are written as byte pieces (or the unknown piece, if the model has no bytes).

White space (U+0020) is escaped as U+2581 and a leading one is added when the
model says so.  No piece has an escape after another character, or anything after a
line's end, so a text falls into runs (escapes, then other characters up to a
line's end) whose best segmentations are independent; each distinct run is encoded
once per worker cache.  A model whose pieces break that rule is refused.

Null text: null ids on encoding, null text on decoding; empty text: no ids.
Extra columns are ignored by `encode`; repeated rows give repeated rows.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from . import text as tx

ESCAPE = "▁"


class Model:
    """Pieces, scores and kinds read from a SentencePiece model file."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models with identity normalisation are supported")
        self.prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        normal = [(p.piece, i, p.score) for i, p in enumerate(proto.pieces) if p.type in (1, 4)]
        if any(ESCAPE in p.lstrip(ESCAPE) for p, _, _ in normal):
            raise ValueError("a piece has white space after another character")
        if any("\n" in p[:-1] for p, _, _ in normal):
            raise ValueError("a piece goes on after a line's end")
        self.low = min(s for _, _, s in normal) - 10.0
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.automaton = ahocorasick.Automaton()
        for piece, i, score in normal:
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()

    def encode(self, run: str) -> list[int]:
        """Ids of the best segmentation of escaped text."""
        n = len(run)
        best, back, ids = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        at, low = 0, self.low
        for end, (size, score, i) in self.automaton.iter(run):
            end += 1
            while at < end - 1:  # positions that no piece ends at
                at += 1
                best[at], back[at], ids[at] = best[at - 1] + low, at - 1, -1
            if at < end:  # the first piece that ends here
                at = end
                best[end], back[end], ids[end] = best[end - 1] + low, end - 1, -1
            total = best[end - size] + score
            if total > best[end] or (total == best[end] and end - size < back[end]):
                best[end], back[end], ids[end] = total, end - size, i
        while at < n:
            at += 1
            best[at], back[at], ids[at] = best[at - 1] + low, at - 1, -1
        out, at, unknown = [], n, False
        while at:
            if ids[at] >= 0:
                out.append(ids[at])
                unknown = False
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(run[back[at] : at].encode()))
            elif not unknown:  # a run of unknown characters is one unknown piece
                out.append(self.unknown)
                unknown = True
            at = back[at]
        return out[::-1]

    def decoder(self) -> tuple[tx.Ragged, np.ndarray]:
        """UTF-8 of each id as rows of a Ragged."""
        reverse = {i: b for b, i in self.bytes.items()}
        parts = [bytes([reverse[i]]) if i in reverse else p.replace(ESCAPE, " ").encode() for i, p in enumerate(self.pieces)]
        parts[self.unknown] = " ⁇ ".encode()
        table = tx.Ragged(np.uint8)
        table.append(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts], np.int64))
        return table


def _run_ids(model: Model):
    def compute(store, words):
        store = store or tx.Ragged(np.int32)
        got = [model.encode(w.replace(" ", ESCAPE)) for w in words]
        return store, store.append(np.array([i for g in got for i in g], np.int32), np.fromiter(map(len, got), np.int64, len(got)))

    return compute


def _slice_ids(model: Model, cache: tx.WordCache, data: np.ndarray, offsets: np.ndarray):
    """Ids of a slice's texts end to end, and where each begins."""
    if model.prefix:  # a space before every text that isn't empty
        some = np.diff(offsets) > 0
        where = offsets[:-1][some]
        data = np.insert(data, where, 32)
        offsets = offsets + np.concatenate([np.zeros(1, np.int64), np.cumsum(some)])
    space = data == 32
    opens = np.zeros(len(data), bool)  # a run opens at a space after something else, after a line's end, and at each text
    opens[1:] = (space[1:] & ~space[:-1]) | (data[:-1] == 10)
    opens[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(opens)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    store, rows = cache.look_up(data, starts, ends)
    ids, lens = store.gather(rows)
    begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(lens)])
    return ids, begin[np.searchsorted(starts, offsets)]


def _schema(docs: DataFrame, id_col: str, rest: str) -> str:
    return f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {rest}"


def encode(docs: DataFrame, model_file: str, id_col="doc_id", text_col="text") -> DataFrame:
    """(id_col, ids array<int>) of every row."""

    def run(batches):
        model = Model(model_file)
        cache = tx.WordCache(_run_ids(model))
        for batch in batches:
            parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            column = batch.column(1)
            for _, _, data, offsets in tx.text_slices(column):
                ids, begin = _slice_ids(model, cache, data, offsets)
                parts.append(ids)
                sizes.append(np.diff(begin))
            at = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(parts)))
            if column.null_count:
                lists = pa.compute.if_else(column.is_null(), pa.nulls(len(column), lists.type), lists)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, _schema(docs, id_col, "ids array<int>"))


def decode(encoded: DataFrame, model_file: str, id_col="doc_id", ids_col="ids") -> DataFrame:
    """(id_col, text) of every row of ids; ids outside the vocabulary are an error."""

    def run(batches):
        model = Model(model_file)
        table = model.decoder()
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                if not ids.is_valid:
                    texts.append(None)
                    continue
                raw = table.gather(ids.values.to_numpy(zero_copy_only=False))[0].tobytes() if len(ids.values) else b""
                texts.append((raw[1:] if model.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, _schema(encoded, id_col, "text string"))


def round_trip(docs: DataFrame, model_file: str, id_col="doc_id", text_col="text") -> DataFrame:
    """(id_col, n_ids, ids_crc32, n_bytes_decoded, same): every text encoded, its
    ids decoded again and compared with the text, all in one pass, so that neither
    ids nor texts are shuffled.  same is null for a null text."""

    def run(batches):
        model = Model(model_file)
        cache = tx.WordCache(_run_ids(model))
        table = model.decoder()
        for batch in batches:
            rows = []
            for _, _, data, offsets in tx.text_slices(batch.column(1)):
                ids, begin = _slice_ids(model, cache, data, offsets)
                raw, lens = table.gather(ids)
                ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lens)])[begin]
                for k in range(len(offsets) - 1):
                    back = raw[ends[k] : ends[k + 1]]
                    if model.prefix and len(back) and back[0] == 32:
                        back = back[1:]
                    own = ids[begin[k] : begin[k + 1]]
                    rows.append((len(own), zlib.crc32(own.astype("<u4").tobytes()), len(back), np.array_equal(back, data[offsets[k] : offsets[k + 1]])))
            null = batch.column(1).is_null().to_pylist()
            cols = [pa.array([None if z else r[c] for r, z in zip(rows, null)], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [id_col, "n_ids", "ids_crc32", "n_bytes_decoded", "same"])

    return docs.select(id_col, text_col).mapInArrow(run, _schema(docs, id_col, "n_ids long, ids_crc32 long, n_bytes_decoded long, same boolean"))
