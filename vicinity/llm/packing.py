"""Vector bin packing of examples into training sequences.

Every sequence has three limits: tokens, segments (pieces of examples) and
loss-bearing tokens.  Within a task, examples are placed by the dot-product
heuristic: of the pieces that fit the open sequence, the one whose demand has the
largest dot product with what is left of the limits comes next.  If none fits,
the largest is cut to fill the gap, so sequences end up full.  Longer examples are
first cut into whole sequences.

Tasks pack what they read, with no shuffle; only a task's last open sequence is
short, and it is split into sequences whose lengths are powers of two, which
aren't padded.  A pool of `pool` pieces is held at a time, so memory is bounded by
the pool and the longest single text.

An example is its ids with `end_id` at the end; with a prompt column, the
prompt's ids come first and bear no loss.  Null or empty text: only `end_id`.
Repeated ids or rows are packed as rows of their own; extra columns are ignored;
an empty table gives no pieces.
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import text as tx
from .shared import tidy
from .tokens import WordIds, document_ids


@dataclass
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


class Packer:
    """Places pieces (key, start, length) of examples; see the module's text."""

    def __init__(self, limits: Limits, first_sequence: int, pool: int = 4096):
        self.lim, self.sequence, self.pool = limits, first_sequence, pool
        self.key: list = []  # waiting pieces, column by column
        self.start: list[int] = []
        self.size: list[int] = []
        self.prompt: list[int] = []
        self.out: list[tuple] = []  # (key, start, length, sequence, offset)

    def add(self, key, size: int, prompt: int = 0) -> None:
        at = 0
        lim = self.lim
        if lim.loss >= lim.tokens:
            while size - at >= lim.tokens:
                self.out.append((key, at, lim.tokens, self.sequence, 0))
                self.sequence += 1
                at += lim.tokens
        if at < size:
            self.key.append(key)
            self.start.append(at)
            self.size.append(size - at)
            self.prompt.append(max(0, prompt - at))
        if len(self.key) >= self.pool:
            self.pack(keep=True)

    def _longest(self, size, prompt, tokens: int, loss: int):
        """How much of a piece fits: its prompt first, then loss-bearing tokens."""
        return np.minimum(np.minimum(size, tokens), np.minimum(prompt, size) + loss)

    def pack(self, keep: bool) -> None:
        """Fills sequences; with keep, stops when a quarter of the pool is left."""
        lim = self.lim
        size, prompt = np.array(self.size, np.int64), np.array(self.prompt, np.int64)
        start = np.array(self.start, np.int64)
        live = np.ones(len(size), bool)
        left = len(size)
        floor = self.pool // 4 if keep else 0
        while left > floor:
            tokens, segments, loss, placed = lim.tokens, lim.segments, lim.loss, []
            while tokens and segments and left:
                bears = np.maximum(size - prompt, 0)
                fits = live & (size <= tokens) & (bears <= loss)
                if fits.any():
                    score = size * (tokens / lim.tokens**2) + bears * (loss / lim.loss**2) + segments / lim.segments**2
                    k = int(np.argmax(np.where(fits, score, -1.0)))
                    take = int(size[k])
                else:
                    k = int(np.argmax(np.where(live, size, -1)))
                    take = int(self._longest(size[k], prompt[k], tokens, loss))
                    if not take:
                        break
                placed.append((self.key[k], int(start[k]), take))
                tokens -= take
                segments -= 1
                loss -= max(0, take - int(min(prompt[k], take)))
                start[k] += take
                size[k] -= take
                prompt[k] = max(0, prompt[k] - take)
                if not size[k]:
                    live[k] = False
                    left -= 1
            self._close(placed, final=not left and not keep)
        rest = np.flatnonzero(live).tolist()
        self.key = [self.key[k] for k in rest]
        self.start, self.size, self.prompt = start[rest].tolist(), size[rest].tolist(), prompt[rest].tolist()

    def _close(self, placed: list[tuple], final: bool) -> None:
        total = sum(p[2] for p in placed)
        rooms = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1] if final else [total]
        placed = placed[::-1]
        for room in rooms:
            offset = 0
            while offset < room:
                key, start, length = placed.pop()
                take = min(length, room - offset)
                self.out.append((key, start, take, self.sequence, offset))
                offset += take
                if take < length:
                    placed.append((key, start + take, length - take))
            self.sequence += 1


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, limits: Limits = Limits(), id_col="doc_id", text_col="text", prompt_col: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32 (of the piece's ids as
    unsigned little-endian 32-bit numbers), doc_tokens, sequence_id, offset, and with
    `with_ids` the ids themselves."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    columns = [id_col, text_col] + [prompt_col] * bool(prompt_col)

    def run(batches):
        cache = tx.WordCache(WordIds(tokenizer))
        packer = Packer(limits, TaskContext.get().partitionId() << 33)
        held: dict[int, np.ndarray] = {}
        names: dict[int, object] = {}
        todo: dict[int, int] = {}
        n = 0

        def emit():
            if not packer.out:
                return None
            rows, packer.out = packer.out, []
            ids = [held[k][s : s + m] for k, s, m, _, _ in rows]
            sizes = [len(held[k]) for k, *_ in rows]
            cols = [pa.array([names[k] for k, *_ in rows], like), *(pa.array([r[c] for r in rows], pa.int64()) for c in (1, 2))]
            cols += [pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()), pa.array(sizes, pa.int64()), *(pa.array([r[c] for r in rows], pa.int64()) for c in (3, 4))]
            if with_ids:
                cols.append(pa.array([i.tolist() for i in ids], pa.list_(pa.int32())))
            for k, _, m, _, _ in rows:
                todo[k] -= m
                if not todo[k]:
                    del held[k], names[k], todo[k]
            return pa.RecordBatch.from_arrays(cols, [f.split(" ")[0] for f in schema.split(", ")])

        like = None
        for batch in batches:
            like = batch.column(0).type
            keys = batch.column(0).to_pylist()
            for a, b, data, offsets in tx.text_slices(batch.column(1), tx.SMALL_SLICE):
                ids, begin = document_ids(cache, data, offsets)
                if prompt_col:
                    asked = [document_ids(cache, d, o) for _, _, d, o in tx.text_slices(batch.column(2).slice(a, b - a), 1 << 62)]
                for i in range(b - a):
                    own = [ids[begin[i] : begin[i + 1]], np.array([end_id], np.int32)]
                    if prompt_col:
                        own.insert(0, asked[0][0][asked[0][1][i] : asked[0][1][i + 1]])
                    held[n], names[n] = np.concatenate(own), keys[a + i]
                    todo[n] = len(held[n])
                    packer.add(n, len(held[n]), len(own[0]) if prompt_col else 0)
                    n += 1
                got = emit()
                if got is not None:
                    yield got
        packer.pack(keep=False)
        got = emit()
        if got is not None:
            yield got

    return docs.select(*columns).mapInArrow(tidy(run), schema)
