"""Operator 12, token counts: batches of texts go through a public tokenizer in Arrow functions that return lengths only.

A byte-level BPE splits a text by its pattern before any merge, and a token never crosses such a split.  Where white space follows a
character that isn't white space, the pattern always splits: a *safe boundary*.  A batch of texts becomes the stretches between
its safe boundaries, batches hold at most CHUNK bytes, and a longer text is cut at one of them.  Each different stretch of
a batch is encoded once, in calls of at most CALL bytes; a text's count is the sum of its stretches' lengths.  A worker keeps the lengths of
up to a million stretches by their 64-bit hashes.  So memory is bounded by the batch, however long a text is, and frequent words
are encoded once.  A stretch without white space stays whole.

Other tokenizers (word_bpe_49k.json, sentencepiece models) may look across such places: they get whole texts, in calls of at most CALL bytes
or of one text.

The vocabulary file is read by the driver (its size is checked) and sent out once; workers need no path.  There is no shuffle.

Edge cases: null and empty texts have no bytes and no tokens; a special token's string inside a text is that token, as the library has it by default;
null, equal and repeated ids are rows like others; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

LIMIT, CALL = 512, 1 << 18
#: A vocabulary file above this isn't sent out.
MOST_BYTES = 64 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_SURE = np.ones(128, bool)
_SURE[[*range(0x21), 0x7F]] = False


def safe_boundaries(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where white space follows what surely is none: an ASCII sign, or a character whose lead byte no white space has."""
    at = np.flatnonzero(_WHITE[data])
    at = at[at > 0]
    last, lead2, lead3 = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    one = (last < 0x80) & _SURE[last & 0x7F]
    two = (last >= 0x80) & (last < 0xC0) & (lead2 >= 0xC3) & (lead2 < 0xE0) & (at > 1)
    three = (last >= 0x80) & (last < 0xC0) & (lead2 >= 0x80) & (lead2 < 0xC0) & ((lead3 == 0xE0) | (lead3 >= 0xE4) & (lead3 < 0xF0)) & (at > 2)
    return at[one | two | three]


def calls(sizes: np.ndarray, limit: int = CALL) -> Iterator[tuple[int, int]]:
    """Ranges of items of at most `limit` bytes together, or of one item."""
    return c.chunks(np.append(0, np.cumsum(sizes)), limit)


def encoder(data: bytes, kind: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """(texts to their numbers of tokens, whether texts may be cut at safe boundaries)."""
    if kind == ".model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)], False
    import json

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    from tokenizers import Tokenizer

    told = json.loads(data)
    split = told.get("pre_tokenizer") or {}
    free = told.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    free = free and not any(t.get("lstrip") or t.get("rstrip") or any(x.isspace() for x in t["content"]) for t in told.get("added_tokens", []))
    model = Tokenizer.from_str(data.decode())
    model.no_truncation()
    model.no_padding()
    return lambda texts: list(map(len, model.encode_batch_fast(texts, add_special_tokens=False))), free


def stretches(data: np.ndarray, offsets: np.ndarray, limit: int = c.CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each stretch, offsets of the stretches) of batches of at most about `limit` bytes."""
    for lo, hi in c.chunks(offsets, limit):
        at, end = int(offsets[lo]), int(offsets[hi])
        inner = offsets[lo + 1 : hi]
        while at < end:
            to = min(at + limit, end) if hi - lo == 1 else end
            while to < end:  # a long text: the next safe boundary from here on
                found = safe_boundaries(data[to - 4 : min(to + limit, end)])
                found = found[found >= 4]
                if len(found):
                    to += int(found[0]) - 4
                    break
                to = min(to + limit, end)
            mark = np.zeros(to - at + 1, bool)
            mark[safe_boundaries(data[at:to])] = True
            mark[[0, to - at]] = True
            mark[inner[(inner > at) & (inner < to)] - at] = True
            cuts = np.flatnonzero(mark) + at
            yield lo + np.repeat(np.arange(hi - lo), np.diff(np.searchsorted(cuts[:-1], offsets[lo : hi + 1]))) if hi - lo > 1 else np.full(len(cuts) - 1, lo), cuts
            at = to


class Known:
    """Lengths of the stretches that a worker has met, by their 64-bit hashes: at most `most` of them, then it begins anew."""

    def __init__(self, most: int = 1 << 20, few: int = 1 << 16):
        self.most, self.few = most, few
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The length of each, -1 if not known."""
        out = np.full(len(keys), -1, np.int64)
        for known, values in self.levels:
            at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
            if len(known):
                out = np.where(known[at] == keys, values[at], out)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys: new ones."""
        (old, old_values), (last, last_values) = self.levels
        last, last_values = np.concatenate([last, keys]), np.concatenate([last_values, values])
        if len(last) > self.few:
            old, old_values = (old, old_values) if len(old) + len(last) <= self.most else (last[:0], last_values[:0])
            order = np.argsort(old := np.concatenate([old, last]), kind="stable")
            old, old_values, last, last_values = old[order], np.concatenate([old_values, last_values])[order], last[:0], last_values[:0]
        order = np.argsort(last, kind="stable")
        self.levels = [(old, old_values), (last[order], last_values[order])]


def counted(data: np.ndarray, offsets: np.ndarray, lengths: Callable[[list[str]], list[int]], free: bool, limit: int = c.CHUNK, known: Known | None = None) -> np.ndarray:
    """Tokens of each text."""
    known = known or Known()
    out = np.zeros(len(offsets) - 1, np.int64)
    text = lambda at: pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
    if not free:
        for lo, hi in c.chunks(offsets, CALL):
            out[lo:hi] = lengths(text(offsets[lo : hi + 1]).to_pylist())
        return out
    for row, cuts in stretches(data, offsets, limit):
        coded = text(cuts).dictionary_encode()
        words, ends = c.utf8(coded.dictionary)
        keys = c.byte_hashes(words, ends[:-1], ends[1:])
        each = known(keys)
        new = np.flatnonzero(each < 0)
        if len(new):
            found = coded.dictionary.take(pa.array(new))
            each[new] = np.concatenate([lengths(found[lo:hi].to_pylist()) for lo, hi in calls(np.diff(ends)[new])])
            known.add(keys[new], each[new])
        out += np.bincount(row, each[coded.indices.to_numpy()], len(out)).astype(np.int64)
    return out


#: The encoder of this worker, by its file's md5.
_READY: dict = {}


def _ready(data: bytes, suffix: str):
    name = hashlib.md5(data).hexdigest()
    if name not in _READY:
        _READY.clear()
        _READY[name] = (*encoder(data, suffix), Known())
    return _READY[name]


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Columns key, n_bytes, n_tokens, over_limit.  vocabulary: path of a .json (tokenizers) or .model (sentencepiece) file on the driver."""
    path = Path(vocabulary)
    if path.suffix not in (".json", ".model"):
        raise ValueError(f"{path.name}: a .json or .model file is expected")
    if path.stat().st_size > MOST_BYTES:
        raise ValueError(f"{path.name} has more than {MOST_BYTES} bytes")
    sent, suffix = docs.sparkSession.sparkContext.broadcast(path.read_bytes()), path.suffix

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, free, known = _ready(sent.value, suffix)
        for batch in batches:
            data, offsets = c.utf8(batch.column(1))
            tokens = counted(data, offsets, lengths, free, known=known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], names=["key", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return c.map_arrow(docs.select(F.col(key), F.col(text)), count, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(c.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
