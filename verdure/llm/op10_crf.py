"""Operator 10, quality classifier: a linear-chain conditional random field over lines.

Each line has word-shape features; its potential also sees the lines before and after it.  The chain labels lines
good or bad; forward-backward gives each line's marginal, and a document's quality is the mean of its lines'
marginals weighted by their length, calibrated on the labelled sample (a logistic curve).

Lines take their document's label for learning.  The fit uses at most SAMPLE_DOCS labelled documents of at most
SAMPLE_LINES lines (those with the smallest hashes of their ids), gathered on the driver; scoring is one pass
over the texts without a shuffle.

Edge cases: null and empty texts, and texts without a word, score the share of label 1 in the sample; null ids are never in the sample; without labels of both
kinds every row scores the share of label 1 (0.5 without any label); repeated rows are scored each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

SAMPLE_DOCS, SAMPLE_LINES, THRESHOLD = 4000, 400, 0.3
FEATURES = 14

_ALNUM, _UPPER, _DIGIT, _STOP, _CALL = (np.zeros(256, bool) for _ in range(5))
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_STOP[list(b".,;:)'\"-")] = True
_CALL[list(b"!?")] = True


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length, row) of each line that holds a word."""
    w = c.Words(data, offsets)
    if not len(w.start):
        return np.zeros((0, FEATURES)), np.zeros(0), np.zeros(0, np.int64)
    breaks = np.flatnonzero(w.buf == 10)
    block = np.searchsorted(breaks, w.start)  # lines by line ends alone
    new = np.ones(len(w.start), bool)
    new[1:] = (block[1:] != block[:-1]) | (w.row[1:] != w.row[:-1])
    line = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(line)))
    size, head, tail, h = w.end - w.start, w.buf[w.start], w.buf[w.end - 1], w.hashes()
    second = w.buf[np.minimum(w.start + 1, w.end - 1)]
    again = [np.zeros(len(h), bool) for _ in range(2)]
    for lag in (1, 2):
        again[lag - 1][lag:] = (h[lag:] == h[:-lag]) & (line[lag:] == line[:-lag])
    share = lambda x: np.add.reduceat(x.astype(np.float64), first) / n
    text = np.add.reduceat(h * (np.arange(len(h), dtype=np.uint64) - first.astype(np.uint64)[line] * np.uint64(1) + np.uint64(1)), first)
    row = w.row[first]
    order = np.lexsort((np.arange(len(row)), text, row))
    seen = np.zeros(len(row))
    seen[order[1:]] = (text[order[1:]] == text[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    length = np.add.reduceat(size, first).astype(np.float64)
    out = np.stack([
        np.log1p(n) / 3, length / n / 8, share(~_ALNUM[tail] & ~_STOP[tail] & ~_CALL[tail]), share(_CALL[tail]), share(_STOP[tail]), share(_UPPER[head]),
        share(_UPPER[second] & (size > 1)), share(_DIGIT[head]), share(~_ALNUM[head] & (size == 1)), share(again[0]), share(again[1]), share(size > 20), seen,
        (_STOP | _CALL)[tail[np.append(first[1:], len(line)) - 1]].astype(float),
    ], 1)
    return out, length, row


def with_neighbours(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The features of the line before, of the line and of the line after, and 1; zeros beyond a text's ends."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    same = row[1:] == row[:-1]
    before[1:][same], after[:-1][same] = x[:-1][same], x[1:][same]
    return np.concatenate([before, x, after, np.ones((len(x), 1))], 1)


def marginals(score: np.ndarray, row: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line, the expected moves, and each chain's log partition sum. score: good over bad; move: 2 x 2 log weights."""
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    size = np.diff(np.append(first, len(row)))
    order = np.argsort(-size, kind="stable")
    begin, size = first[order], size[order]
    active = np.searchsorted(-size, -np.arange(size[0]), "left")
    e = np.exp(move - move.max())
    local = np.stack([1 / (1 + np.exp(np.clip(score, -30, 30))), 1 / (1 + np.exp(-np.clip(score, -30, 30)))], 1)
    alpha, scale = np.empty((len(score), 2)), np.empty(len(score))
    a = np.ones((len(begin), 2))
    for t, n in enumerate(active):
        at = begin[:n] + t
        a = (a[:n] @ e if t else a) * local[at]
        s = a.sum(1)
        a = a / s[:, None]
        alpha[at], scale[at] = a, s
    good, moves = np.empty(len(score)), np.zeros((2, 2))
    beta = np.ones((active[-1], 2))
    for t in range(len(active) - 1, -1, -1):
        n, at = active[t], begin[: active[t]] + t
        if t < len(active) - 1:
            m = active[t + 1]
            nxt = begin[:m] + t + 1
            x = beta * local[nxt] / scale[nxt, None]
            moves += (alpha[at[:m]].T @ x) * e
            beta = np.ones((n, 2))
            beta[:m] = x @ e.T
        g = alpha[at] * beta
        good[at] = g[:, 1] / g.sum(1)
    return good, moves, scale


def fit(x: np.ndarray, row: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(weights, move, a, b): a logistic start by Newton's method, then the chain's likelihood by Adam; a and b calibrate. label: of each line's document."""
    every = with_neighbours(x, row)
    y = label[row]
    n_docs = len(np.unique(row))
    w = np.zeros(every.shape[1])
    weight = 1 / np.sqrt(np.bincount(row, minlength=row.max() + 1))[row]  # a long text doesn't count as its many lines
    for _ in range(8):
        p = 1 / (1 + np.exp(-np.clip(every @ w, -30, 30)))
        h = (every * (weight * p * (1 - p))[:, None]).T @ every + np.eye(len(w)) * 0.5
        w += np.linalg.solve(h, every.T @ (weight * (y - p)) - 0.5 * w)
    move = np.zeros((2, 2))
    same = row[1:] == row[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][same].astype(int), y[1:][same].astype(int)), 1)
    theta, m, v = np.concatenate([w, move.ravel()]), 0.0, 0.0
    for step in range(1, 41):
        good, moves, _ = marginals(every @ theta[:-4], row, theta[-4:].reshape(2, 2))
        grad = np.concatenate([every.T @ (y - good), (seen - moves).ravel()]) / n_docs - np.append(1e-3 * np.ones(len(w)), 2e-2 * np.ones(4)) * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w, move = theta[:-4], theta[-4:].reshape(2, 2)
    some, docs = np.unique(row, return_inverse=True)
    quality = doc_quality(marginals(every @ w, row, move)[0], length, docs, len(some))
    z, t, ab = _logit(quality), label[some], np.array([1.0, 0.0])
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(ab[0] * z + ab[1], -30, 30)))
        d = np.stack([z, np.ones(len(z))], 1)
        ab = ab + np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + np.eye(2) * 0.1, d.T @ (t - p) - 0.1 * (ab - [1, 0]))
    return w, move, float(max(ab[0], 1e-3)), float(ab[1])


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def doc_quality(good: np.ndarray, length: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, good * length, n) / np.maximum(np.bincount(row, length, n), 1e-9)


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> dict:
    """The model, from a bounded sample: SAMPLE_DOCS documents, the lines of those with at most SAMPLE_LINES."""
    labelled = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).filter(F.col("_label").isin(0, 1) & F.col("_key").isNotNull() & (c.fold("_key") != 0)).groupBy("_key").agg(F.min("_label").alias("_label"))
    lines = F.size(F.split(F.col(text), "\n"))
    chosen = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(F.col(key).cast("string")).alias("_order")).filter(F.col("_text").isNotNull() & (lines <= SAMPLE_LINES) & (F.length("_text") <= 100 * SAMPLE_LINES))
    ids = chosen.select("_key", "_order").join(labelled, "_key").orderBy("_order", "_key").limit(SAMPLE_DOCS)  # ids alone are sorted
    sample = chosen.drop("_order").join(F.broadcast(ids.select("_key", "_label").dropDuplicates(["_key"])), "_key").select("_key", "_text", "_label")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = c.utf8(batch.column(1))
            if len(offsets) > 1:
                x, length, row = line_features(data, offsets)
                bounds = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(bounds * (FEATURES + 1)), pa.array(np.concatenate([x, length[:, None]], 1).astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), flat], names=["id", "label", "lines"])

    got = c.map_arrow(sample, features, "id string, label int, lines array<float>").toArrow().sort_by("id")
    label = got.column("label").to_numpy().astype(float) if got.num_rows else np.zeros(0)
    prior = float(label.mean()) if len(label) else 0.5
    flat = got.column("lines").combine_chunks()
    rows = np.repeat(np.arange(got.num_rows), flat.value_lengths().to_numpy() // (FEATURES + 1)) if got.num_rows else np.zeros(0, int)
    if len(label) < 2 or label.min() == label.max() or not len(rows):
        return {"prior": prior}
    x = flat.flatten().to_numpy().reshape(-1, FEATURES + 1).astype(float)
    w, move, a, b = fit(x[:, :-1], rows, x[:, -1], label)
    return {"prior": prior, "w": w, "move": move, "a": a, "b": b}


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """docs with `score` and `predicted` added."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, key, text, label))
    column = docs.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            data, offsets = c.utf8(batch.column(column))
            out = np.full(batch.num_rows, m["prior"])
            if "w" in m:
                for lo, hi in c.chunks(offsets):
                    x, length, row = line_features(data, offsets[lo : hi + 1])
                    if len(row):
                        quality = doc_quality(marginals(with_neighbours(x, row) @ m["w"], row, m["move"])[0], length, row, hi - lo)
                        full = np.unique(row)
                        out[lo + full] = 1 / (1 + np.exp(-np.clip(m["a"] * _logit(quality[full]) + m["b"], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out), pa.array((out >= threshold).astype(np.int32))], names=[*batch.schema.names, "_score", "_predicted"])

    names = [f"_c{i}" for i in range(len(docs.columns))]  # so that columns of any name pass through
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    out = c.map_arrow(docs.toDF(*names), score, f"{schema}, _score double, _predicted int")
    kept = [F.col(n).alias(o) for n, o in zip(names, docs.columns, strict=True) if o not in ("score", "predicted")]
    return out.select(*kept, F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_scores(docs, c.table(spark, sf_dir, "labels"))
    return out.select("doc_id", (c.fold("doc_id") == 0).alias("held_out"), "score", "predicted")
