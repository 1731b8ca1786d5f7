"""Operator 1, LM scoring: a hidden Markov model of words.

Words the corpus uses often have a symbol of their own; less frequent ones share symbols by
their last two bytes, and all beyond the `known` most frequent words, the unknown word too,
share one.  Within a shared symbol a word has its share of the add-half unigram estimate.  So P(word | state) = P(symbol | state) * q(word) / Q(symbol),
which sums to one over the training vocabulary and the unknown word.
Baum-Welch counts (expected emissions, transitions, starts) are made by tasks over
their own documents, added up by Spark and turned into a model on the driver: that
table has a fixed size (`symbols` x `states`).  Every pass reads every training text, coded once as two bytes a token; passes end when the
log likelihood of a token grows by less than GAIN of itself, or after PASSES.  The scaled forward recursion, in double precision, then gives
each text's exact likelihood.

What is known of a word beyond the `known` most frequent ones comes from a shuffled join
with the counts of the whole corpus, so no table that is sent out grows with the corpus.

Edge cases: null text is empty (one token, the end); a null id is in the training part;
repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

STATES, SYMBOLS, KNOWN, SUFFIXES = 8, 60_000, 131_072, 64
#: Passes over all training texts at most, and the share by which the log likelihood of a token must grow for another.
PASSES, GAIN = 8, 0.001
#: Tokens a task holds at once for the recursions.
BATCH_TOKENS = 1_500_000
#: Texts of more tokens are gathered apart.
LONG = 4096


def _suffix(w: c.Words) -> np.ndarray:
    last = w.buf[w.end - 1].astype(np.uint64)
    prev = np.where(w.end - w.start > 1, w.buf[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)
    return (c.mix(last * np.uint64(256) + prev) % np.uint64(SUFFIXES)).astype(np.int32)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, suffix, n) of all texts; tasks add up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged():
            words, first, inverse = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
            return words, np.concatenate([x[1] for x in held])[first], np.bincount(inverse, np.concatenate([x[2] for x in held]), len(words)).astype(np.int64)

        def out(x):
            for i in range(0, len(x[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c.signed(x[0][i : i + 100_000])), pa.array(x[1][i : i + 100_000]), pa.array(x[2][i : i + 100_000])], names=["word", "suffix", "n"])

        for batch in batches:
            data, offsets = c.utf8(batch.column(0))
            for lo, hi in c.chunks(offsets):
                w = c.Words(data, offsets[lo : hi + 1], lower=True)
                words, first, n = np.unique(w.hashes(), return_index=True, return_counts=True)
                held.append((words, _suffix(w)[first], n))
                if sum(len(x[0]) for x in held) > 4_000_000:
                    held = [merged()]
                    if len(held[0][0]) > 2_000_000:
                        yield from out(held.pop())
        if held:
            yield from out(merged())

    return c.map_arrow(docs.select(text), count, "word long, suffix int, n long").groupBy("word").agg(F.max("suffix").alias("suffix"), F.sum("n").alias("n"))


class Vocabulary:
    """Fixed-size part of the corpus statistics, sent to every task."""

    def __init__(self, counts: DataFrame, texts: int):
        octave = F.floor(F.log2("n") * 8).cast("int")
        by = sorted(((r.octave, r.words, r.total) for r in counts.groupBy(octave.alias("octave")).agg(F.count("*").alias("words"), F.sum("n").alias("total")).collect()), reverse=True)
        self.total, self.distinct = sum(t for *_, t in by) + texts, sum(w for _, w, _ in by) + (texts > 0)
        self.space = self.total + 0.5 * (self.distinct + 1)

        def least(most: int) -> int:
            words, low = 0, 10_000
            for o, w, _ in by:
                words += w
                if words > most:
                    break
                low = o
            return low

        self.known_from, symbols_from = least(KNOWN), least(SYMBOLS)
        got = counts.filter(octave >= self.known_from).select("word", "suffix", "n", octave.alias("octave")).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
        self.words = got.column("word").to_numpy().view(np.uint64)
        self.n = got.column("n").to_numpy()
        self.heads = int((got.column("octave").to_numpy() >= symbols_from).sum())
        self.size = self.heads + SUFFIXES + 2  # the last two: all other words, end of text
        q = np.zeros(self.size)
        q[: self.heads] = (self.n[: self.heads] + 0.5) / self.space
        suffix = got.column("suffix").to_numpy()
        q[self.heads : -2] = np.bincount(suffix[self.heads :], self.n[self.heads :] + 0.5, SUFFIXES) / self.space
        q[-2] = (sum(t + 0.5 * w for o, w, t in by if o < self.known_from) + 0.5) / self.space
        q[-1] = (texts + 0.5 * (texts > 0)) / self.space
        self.q = q / q.sum()
        self.texts = texts

    def symbols(self, w: c.Words, lookup: c.Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, known id or -1, hash) of each word."""
        h = w.hashes()
        known = lookup(h)
        sym = np.where(known < self.heads, known, self.heads + _suffix(w))
        return np.where(known < 0, self.size - 2, sym).astype(np.int32), known, h


class Model:
    def __init__(self, q: np.ndarray, states: int, seed: int = 1):
        noise = np.random.default_rng(seed).normal(0, 0.5, (len(q), states))
        self.emit = q[:, None] * np.exp(noise)
        self.emit /= self.emit.sum(0)
        self.move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
        self.begin = np.full(states, 1 / states)

    def update(self, q: np.ndarray, emit: np.ndarray, move: np.ndarray, begin: np.ndarray) -> None:
        """Expected counts, with a little of the whole corpus in every state."""
        self.emit = emit + 500.0 * q[:, None]
        self.emit /= self.emit.sum(0)
        self.emit[-2] = np.maximum(self.emit[-2], q[-2])  # training texts hold no unknown word: no state makes it rarer than the corpus does
        self.emit /= self.emit.sum(0)
        self.move = move + 1.0
        self.move /= self.move.sum(1, keepdims=True)
        self.begin = (begin + 1.0) / (begin + 1.0).sum()


def forward(model: tuple, flat: np.ndarray, first: np.ndarray, size: np.ndarray, back: bool = False):
    """Natural log likelihood of each sequence flat[first : first + size]; with `back` also the expected counts.

    Sequences advance together, longest first, a step at a time."""
    emit, move, begin = model
    k = emit.shape[1]
    order = np.argsort(-size, kind="stable")
    begins, sizes = first[order], size[order]
    steps = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(steps), "left")  # sequences longer than t
    where = np.concatenate([[0], np.cumsum(active)])
    loglik, ones, kind = np.zeros(len(order)), np.ones(k, emit.dtype), emit.dtype
    if back:
        alpha, scale, ids = np.empty((where[-1], k), kind), np.empty(where[-1], kind), np.empty(where[-1], np.int32)
    a = np.broadcast_to(begin, (len(order), k))
    for t in range(steps):
        n = active[t]
        sym = flat[begins[:n] + t].astype(np.int32)
        a = (a[:n] @ move if t else a[:n]) * emit[sym]
        s = a @ ones
        a /= s[:, None]
        loglik[:n] += np.log(s)
        if back:
            p = where[t]
            alpha[p : p + n], scale[p : p + n], ids[p : p + n] = a, s, sym
    out = np.empty(len(order))
    out[order] = loglik
    if not back:
        return out
    moves = np.zeros((k, k))
    beta = np.ones((active[-1], k), kind)
    for t in range(steps - 1, -1, -1):
        p, n = where[t], active[t]
        if t < steps - 1:
            m, p1 = active[t + 1], where[t + 1]
            e = beta * (emit[ids[p1 : p1 + m]] / scale[p1 : p1 + m, None])
            moves += alpha[p : p + m].T @ e
            beta = np.ones((n, k), kind)
            beta[:m] = e @ move.T
        alpha[p : p + n] *= beta
    gamma = alpha
    counts = np.stack([np.bincount(ids, gamma[:, j], len(emit)) for j in range(k)], 1)
    return out, counts, moves * move, gamma[: active[0]].sum(0)


def _gathered(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, lookup: c.Lookup, text: int = 0):
    """Symbols with an end after each text, in pieces of about BATCH_TOKENS: (flat, first, size, row batches)."""
    flat, sizes, held, tokens = [], [], [], 0

    def piece():
        size = np.concatenate(sizes)
        return np.concatenate(flat), np.concatenate([[0], np.cumsum(size)[:-1]]), size, list(held)

    for batch in batches:
        data, offsets = c.utf8(batch.column(text))
        for lo, hi in c.chunks(offsets):
            w = c.Words(data, offsets[lo : hi + 1], lower=True)
            sym, known, h = vocabulary.symbols(w, lookup)
            out = np.full(len(sym) + hi - lo, vocabulary.size - 1, np.int32)
            out[np.arange(len(sym)) + w.row] = sym
            flat.append(out)
            sizes.append(w.count + 1)
            held.append((batch.slice(lo, hi - lo), w.count, w.row, sym, known, h))
            tokens += len(out)
            if tokens >= BATCH_TOKENS:
                yield piece()
                flat, sizes, held, tokens = [], [], [], 0
    if flat:
        yield piece()


def coded(texts: DataFrame, vocabulary) -> DataFrame:
    """`symbols` of each text, the end included, two bytes each."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        lookup = c.Lookup(v.words)
        for batch in batches:
            data, offsets = c.utf8(batch.column(0))
            for lo, hi in c.chunks(offsets):
                w = c.Words(data, offsets[lo : hi + 1], lower=True)
                sym, *_ = v.symbols(w, lookup)
                out = np.full(len(sym) + hi - lo, v.size - 1, np.uint16)
                out[np.arange(len(sym)) + w.row] = sym
                ends = np.append(0, np.cumsum(w.count + 1)) * 2
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out.tobytes())])], names=["symbols"])

    return c.map_arrow(texts, code, "symbols binary")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(symbols, size of each text) in pieces of about BATCH_TOKENS; long and short texts apart, as texts of a piece advance together."""
    held, tokens = ([], []), [0, 0]
    for batch in batches:
        column = batch.column(0)
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, np.int32)[column.offset :][: len(column) + 1].astype(np.int64) // 2 if len(column) else np.zeros(1, np.int64)
        flat = np.frombuffer(data, np.uint16) if data is not None else np.zeros(0, np.uint16)
        sizes = np.diff(ends)
        for k, some in enumerate((sizes <= LONG, sizes > LONG)):
            if some.any():
                held[k].append((flat[ends[0] : ends[-1]][np.repeat(some, sizes)], sizes[some]))
                tokens[k] += len(held[k][-1][0])
            if tokens[k] >= BATCH_TOKENS:
                yield tuple(np.concatenate(x) for x in zip(*held[k], strict=True))
                held[k].clear()
                tokens[k] = 0
    for k in (0, 1):
        if held[k]:
            yield tuple(np.concatenate(x) for x in zip(*held[k], strict=True))


def expected_counts(codes: DataFrame, size: int, model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One Baum-Welch pass: a row for each symbol with a count per state, the transitions, the starts, and the log likelihood of a token under the model before."""
    k, context = model.emit.shape[1], codes.sparkSession.sparkContext
    sent = context.broadcast((model.emit.astype(np.float32), model.move.astype(np.float32), model.begin.astype(np.float32)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.zeros((size + k + 2, k))
        for flat, sizes in _pieces(batches):
            loglik, emit, move, begin = forward(sent.value, flat, np.append(0, np.cumsum(sizes)[:-1]), sizes, back=True)
            every[:size] += emit
            every[size : size + k] += move
            every[size + k] += begin
            every[size + k + 1, :2] += loglik.sum(), sizes.sum()
        some = np.flatnonzero(np.abs(every).sum(1) > 1e-9)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(every[some, j]) for j in range(k))], names=["symbol", *(f"s{j}" for j in range(k))])

    schema = "symbol int, " + ", ".join(f"s{j} double" for j in range(k))
    got = c.map_arrow(codes, count, schema).groupBy("symbol").agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(k))).toArrow()
    every = np.zeros((size + k + 2, k))
    every[got.column("symbol").to_numpy()] = np.stack([got.column(f"s{j}").to_numpy() for j in range(k)], 1) if got.num_rows else 0
    sent.unpersist()
    return every[:size], every[size : size + k], every[-2], every[-1, 0] / max(1.0, every[-1, 1])


def fit(train: DataFrame, text: str = "text", states: int = STATES) -> tuple[DataFrame, Vocabulary, Model, list[float]]:
    """(word counts, vocabulary, model, the log likelihood of a training token before each pass)."""
    counts = c.checkpointed(word_counts(train, text))
    v = Vocabulary(counts, train.count())
    vocabulary, model, seen = train.sparkSession.sparkContext.broadcast(v), Model(v.q, states), []
    codes = c.checkpointed(coded(train.select(text), vocabulary)) if v.total else None
    for _ in range(PASSES if v.total else 0):
        *expected, loglik = expected_counts(codes, v.size, model)
        model.update(v.q, *expected)
        seen.append(loglik)
        if len(seen) > 1 and seen[-1] - seen[-2] < GAIN * abs(seen[-1]):
            break
    vocabulary.unpersist()
    return counts, v, model, seen


def hmm_score(docs: DataFrame, key: str = "doc_id", text: str = "text", states: int = STATES, fitted: tuple | None = None) -> DataFrame:
    """Columns key, held_out, n_tokens, n_known, train_tokens, base_score, score: the last two log10 probabilities under the
    add-half unigram model and the hidden Markov model, both learnt from the rows that are not held out, unless `fitted` is given."""
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.col(key).alias("key"), (c.fold(key) == 1).alias("held_out"), F.col(text).alias("text"))
    counts, v, model, _ = fitted or fit(docs.filter(~F.col("held_out")).select("text"), states=states)
    vocabulary, sent = context.broadcast(v), context.broadcast((model.emit, model.move, model.begin))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        q = np.log10((np.append(v.n, 0) + 0.5) / v.space)  # the last for -1: not known here
        within = np.log10(np.maximum(v.q, 1e-300))  # symbols without a word are not met
        end = np.log10((v.texts + 0.5) / v.space)
        for flat, first, size, held in _gathered(batches, v, c.Lookup(v.words), 2):
            loglik = forward(sent.value, flat, first, size) / np.log(10)
            at = 0
            for rows, count, row, sym, known, h in held:
                n = len(count)
                here, rest = known >= 0, np.flatnonzero(known < 0)
                base = np.bincount(row[here], q[known[here]], n) + end
                shared = sym >= v.heads
                inner = np.bincount(row[shared], np.where(known[shared] >= 0, q[known[shared]], 0) - within[sym[shared]], n)
                digest = np.zeros(n, np.uint64)
                full = np.flatnonzero(count)
                if len(full):
                    place = np.arange(len(h), dtype=np.uint64) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count).astype(np.uint64)
                    digest[full] = np.add.reduceat(c.mix(h + place * np.uint64(0x9E3779B97F4A7C15)), np.concatenate([[0], np.cumsum(count)[:-1]])[full])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[rest], minlength=n))]).astype(np.int32)), pa.array(c.signed(h[rest])))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(c.signed(digest)), pa.array(count + 1), pa.array(np.bincount(row[here], minlength=n) + (v.texts > 0)), pa.array(base), pa.array(loglik[at : at + n] + inner), lists], names=["key", "held_out", "digest", "n_tokens", "n_known", "base", "score", "rest"])
                at += n

    kind = docs.schema["key"].dataType.simpleString()
    scored = c.checkpointed(c.map_arrow(docs, score, f"key {kind}, held_out boolean, digest long, n_tokens long, n_known long, base double, score double, rest array<long>"))
    # Rows alike in key and words are scored alike: they are counted, and what the join adds for all of them is divided.
    each = scored.groupBy("key", "held_out", "digest", "n_tokens", "n_known").agg(F.count("*").alias("copies"), F.max("base").alias("base"), F.max("score").alias("score"), F.sum(F.size("rest")).alias("n_rest"))
    known = counts.filter(F.floor(F.log2("n") * 8) < v.known_from).select("word", F.log10((F.col("n") + 0.5) / v.space).alias("q"))
    found = scored.select("key", "digest", F.explode("rest").alias("word")).join(known, "word").groupBy("key", "digest").agg(F.count("*").alias("more"), F.sum("q").alias("q"))
    none = float(np.log10(0.5 / v.space))
    e, f = each.alias("e"), found.alias("f")
    joined = e.join(f, F.col("e.key").eqNullSafe(F.col("f.key")) & (F.col("e.digest") == F.col("f.digest")), "left")
    more, q = F.coalesce("f.more", F.lit(0)) / F.col("copies"), F.coalesce("f.q", F.lit(0.0)) / F.col("copies")
    unknown = F.col("n_rest") / F.col("copies") - more
    return joined.select(
        F.col("e.key").alias(key), F.col("e.held_out"), F.col("e.n_tokens"), (F.col("e.n_known") + more.cast("long")).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("e.base") + q + unknown * none).alias("base_score"),
        (F.col("e.score") + q + unknown * none).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def op1_hmm_score(spark, sf_dir: str) -> DataFrame:
    return hmm_score(c.table(spark, sf_dir, "documents"))
