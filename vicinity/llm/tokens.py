"""Token ids of whole texts, by distinct words.

A public tokenizer file is loaded in the worker; its ids for a text are the ids
of the text's white-space words end to end, because its pre-tokenizer never joins
across white space.  Each distinct word of a slice is encoded once.  Words of
ASCII and Latin letters take a shorter way to the same model: they are lowered
and cut here, and encoded many at a time.  All other words go through the
tokenizer as it is.
"""
from __future__ import annotations

import json
import os
import re

import numpy as np

from . import text as tx

_SIMPLE = re.compile(r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-įĴ-ķĹ-ňŊ-ŷ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-ſ]+|[0-9]|[^\sa-z0-9\xdf-ſ]+")


class WordIds:
    """Computes ids of words for a WordCache; the store is a Ragged of ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.quick = None
        if _words_lowered(spec):
            plain = dict(spec, normalizer=None, added_tokens=[])
            self.quick = Tokenizer.from_str(json.dumps(plain))
            self.quick.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            suffix = spec["model"]["end_of_word_suffix"]
            self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.ends[[i for piece, i in spec["model"]["vocab"].items() if piece.endswith(suffix)]] = True

    def __call__(self, store, words):
        store = store or tx.Ragged(np.int32)
        simple, other = [], []
        for k, w in enumerate(words):
            (simple if self.quick and _SIMPLE.fullmatch(w) and "<|" not in w else other).append(k)
        rows = np.zeros(len(words), np.int64)
        for a in range(0, len(simple), 4000):
            part = simple[a : a + 4000]
            pieces = [_PIECES.findall(words[k].lower()) for k in part]
            got = self.quick.encode_batch_fast([" ".join(" ".join(p) for p in pieces[b : b + 200]) for b in range(0, len(pieces), 200)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.int32) for e in got])
            closes = np.flatnonzero(self.ends[ids]) + 1  # one past the last id of each piece
            last = closes[np.cumsum([len(p) for p in pieces]) - 1]
            rows[part] = store.append(ids, np.diff(last, prepend=0))
        for a in range(0, len(other), 4000):
            part = other[a : a + 4000]
            got = [e.ids for e in self.whole.encode_batch_fast([words[k] for k in part], add_special_tokens=False)]
            rows[part] = store.append(np.array([i for g in got for i in g], np.int32), np.array([len(g) for g in got], np.int64))
        return store, rows


def _words_lowered(spec: dict) -> bool:
    """Whether the file is of the kind whose words may be cut here: lowered, split
    by the usual pattern, byte-level pieces with word ends."""
    split = json.dumps(spec.get("pre_tokenizer") or {})
    return bool(spec["model"].get("end_of_word_suffix")) and "Lowercase" in json.dumps(spec.get("normalizer") or {}) and "'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in split


def document_ids(cache: tx.WordCache, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the documents of a slice end to end, and where each begins."""
    starts, ends, first = tx.spans(~tx.WHITE[data], offsets)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    store, rows = cache.look_up(data, starts, ends)
    ids, lens = store.gather(rows)
    begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(lens)])
    return ids, begin[first]
