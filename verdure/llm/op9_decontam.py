"""Operator 9, benchmark decontamination: a BM25 inverted index of the test items, searched by every training passage.

A passage is 3m words of a document, one from every m-th word on, m the words of the longest item: an item that lies in a text lies
whole in a passage, also with as many words put in.  An item's score for a passage is the BM25 sum of the item's words that the passage has, as a share of
the item's own sum, so one threshold (THETA) serves all items and "retrieve all above threshold" needs no top-k.
Search is block-max WAND, a batch of passages at a time: of each item's words the commonest whose shares add up to less
than COMMON (below THETA) are left out of the essential postings; essential postings are kept in blocks of items with the largest share of
each word in the block.  Blocks whose bound can't reach THETA for any of their items are skipped, the items of the others are
bounded one by one, and those left are scored in full.
A retrieved item is verified by overlap: the passage holds OVERLAP of its question (all but the last sentence) and of its answer (the last sentence), or of the
five-word shingles of the whole item.  A part's overlap is the share of its five-word shingles or, if that is more, of its words less the edits that turn
it into some piece of the passage, so a changed word costs a word and not five shingles.  A part of under five words is one shingle; of two to four words it is
aligned together with the words next to it in the item, five in all.  An item of one sentence is halved.

Document frequencies, the mean and the largest length are those of the whole benchmark, counted by Spark.  Words are compared in lower case (A-Z) without ASCII punctuation
at their ends.  The index goes out in shards of at most SHARD items (about 1.5 kB an item of 50 words), a pass over the documents for each.

Edge cases: null and empty texts match nothing; null or empty items are not indexed; repeated items are matched each, repeated rows give
repeated matches; an empty benchmark or table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common as c

THETA, COMMON, OVERLAP, SHINGLE = 0.5, 0.3, 0.8, 5
K1, B, BLOCK, SHARD = 1.2, 0.75, 16, 100_000
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def clean_words(data: np.ndarray, offsets: np.ndarray) -> tuple[c.Words, np.ndarray]:
    """Words without the punctuation at their ends, however long it is; one of nothing else keeps its first sign."""
    w = c.Words(data, offsets, lower=True)
    if len(w.start):
        body = np.append(np.flatnonzero(~_PUNCT[w.buf]), len(w.buf))
        first, after = np.searchsorted(body, w.start), np.searchsorted(body, w.end)
        some = first < after
        w.end = np.where(some, body[np.maximum(after - 1, 0)] + 1, w.start + 1)
        w.start = np.where(some, body[first], w.start)
    return w, w.hashes()


def shingles(h: np.ndarray) -> np.ndarray:
    return np.unique(c.grams(h, min(SHINGLE, len(h)))) if len(h) else np.zeros(0, np.uint64)


def aligned(part: np.ndarray, words: np.ndarray) -> float:
    """1 less the word edits, as a share of the part, between the part and the piece of words that is nearest to it; 0 if under OVERLAP of its words are there at all."""
    if not len(part) or np.isin(part, words).mean() < OVERLAP:
        return 0.0
    step = np.arange(len(words) + 1)
    d = np.zeros(len(words) + 1, np.int64)
    for i, x in enumerate(part, 1):
        cur = np.empty_like(d)
        cur[0] = i
        cur[1:] = np.minimum(d[:-1] + (words != x), d[1:] + 1)
        d = np.minimum.accumulate(cur - step) + step
    return 1.0 - float(d.min()) / len(part)


def split_item(text: str) -> tuple[str, str]:
    """(question, answer)."""
    body = text.rstrip(" .!?\t\r\n")
    cut = max(body.rfind(x) for x in (". ", "! ", "? ", "\n"))
    if cut < 0 or not body[:cut].strip():
        words = text.split()
        return " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])
    return text[: cut + 1], text[cut + 1 :]


def hashed(texts: list[str]) -> list[np.ndarray]:
    raw = [t.encode() for t in texts]
    w, h = clean_words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    return [h[w.first[i] : w.first[i + 1]] for i in range(len(raw))]


class Index:
    def __init__(self, items: list[tuple], n_items: int, mean: float, longest: int, frequency: dict[int, int]):
        """items: (id, text), texts with a word; the others are of the whole benchmark: its items, their mean and largest length, the items that have a word."""
        self.ids = [i for i, _ in items]
        words = hashed([t for _, t in items])
        self.words, self.first = np.concatenate(words), np.cumsum([0, *(len(h) for h in words)])
        self.cut = np.array([len(h) for h in hashed([split_item(t)[0] for _, t in items])])
        self.longest = longest
        n = len(items)
        terms, tfs = zip(*(np.unique(h, return_counts=True) for h in words), strict=True)
        self.terms, term = np.unique(np.concatenate(terms), return_inverse=True)
        item = np.repeat(np.arange(n), [len(t) for t in terms])
        df = np.array([frequency[x] for x in c.signed(self.terms).tolist()])
        length = np.array([len(h) for h in words])[item]
        tf = np.concatenate(tfs)
        share = np.log1p((n_items - df[term] + 0.5) / (df[term] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        share /= np.bincount(item, share, n)[item]
        by_item = np.lexsort((term, item))
        self.of_item = np.searchsorted(item[by_item], np.arange(n + 1))
        self.item_terms, self.item_shares = term[by_item], share[by_item]
        # Common words first: what they can add is known without looking them up.
        order = np.lexsort((-df[term], item))
        running = np.cumsum(share[order])
        running -= np.repeat(running[self.of_item[:-1]] - share[order][self.of_item[:-1]], np.diff(self.of_item))
        left_out = order[running < COMMON]
        self.bonus = np.bincount(item[left_out], share[left_out], n)
        essential = np.setdiff1d(np.arange(len(term)), left_out)
        essential = essential[np.lexsort((item[essential], term[essential]))]
        self.p_term, self.p_item, self.p_share = term[essential], item[essential], share[essential]
        self.p_first = np.searchsorted(self.p_term, np.arange(len(self.terms) + 1))
        block = self.p_item // BLOCK
        new = np.append(True, (self.p_term[1:] != self.p_term[:-1]) | (block[1:] != block[:-1]))[: len(block)]
        at = np.flatnonzero(new)
        self.b_term, self.b_block = self.p_term[at], block[at]
        self.b_most = np.maximum.reduceat(self.p_share, at) if len(at) else np.zeros(0)
        self.b_postings = np.append(at, len(block))
        self.b_first = np.searchsorted(self.b_term, np.arange(len(self.terms) + 1))
        self.b_bonus = np.maximum.reduceat(self.bonus, np.arange(0, n, BLOCK))
        self.n = n

    def parts(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, those of the question, those of the answer) of an item."""
        words = self.words[self.first[i] : self.first[i + 1]]
        return words, words[: self.cut[i]], words[self.cut[i] :]

    def lookup(self) -> c.Lookup:
        return c.Lookup(self.terms)


def _expand(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of `which` the numbers first[w] .. first[w + 1]: (place in which, number)."""
    n = first[which + 1] - first[which]
    place = np.repeat(np.arange(len(which)), n)
    return place, np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[which], n)


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some, inverse = np.unique(key, return_inverse=True)
    return some, np.bincount(inverse, value, len(some))


def search(index: Index, lookup: c.Lookup, w: c.Words, h: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item, score, question overlap, answer overlap) of each verified item of each row, at its best passage."""
    term = lookup(h)
    at = np.flatnonzero(term >= 0)
    at = at[index.b_first[term[at]] < index.b_first[term[at] + 1]]
    m = index.longest
    place = at - w.first[w.row[at]]
    last = np.maximum(0, -(-w.count // m) - 3)  # of a row's passages, from 0
    base = np.concatenate([[0], np.cumsum(last + 1)])
    part = place // m  # it is in the passages part, part - 1 and part - 2, as far as there are such
    pairs = [np.zeros(0, np.int64)]
    for k in range(3):
        here = np.flatnonzero((part >= k) & (part - k <= last[w.row[at]]))
        pairs.append((base[w.row[at[here]]] + part[here] - k) * np.int64(len(index.terms)) + term[at[here]])
    pairs = np.unique(np.concatenate(pairs))
    passage, term1 = pairs // len(index.terms), pairs % len(index.terms)
    # Blocks.
    one, posted = _expand(index.b_first, term1)
    blocks = len(index.b_bonus)
    key = passage[one] * np.int64(blocks) + index.b_block[posted]
    some, bound = _summed(key, index.b_most[posted])
    alive = some[bound + index.b_bonus[some % blocks] >= THETA - 1e-6]
    if not len(alive):
        return
    keep = np.isin(key, alive)
    # Items of the blocks left.
    one, posted = one[keep], posted[keep]
    two, entry = _expand(index.b_postings, posted)
    some, bound = _summed(passage[one[two]] * np.int64(index.n) + index.p_item[entry], index.p_share[entry])
    some = some[bound + index.bonus[some % index.n] >= THETA - 1e-6]
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for p, i in zip((some // index.n).tolist(), (some % index.n).tolist(), strict=True):
        row = int(np.searchsorted(base, p, "right")) - 1
        start = w.first[row] + (p - base[row]) * m
        words = h[start : min(start + 3 * m, w.first[row + 1])]
        a, b = index.of_item[i], index.of_item[i + 1]
        has = np.isin(index.terms[index.item_terms[a:b]], words)
        score = float(index.item_shares[a:b][has].sum())
        if score < THETA:
            continue
        grams = [c.grams(words, k) for k in range(1, SHINGLE + 1)]  # a part's shingles are all of one length
        every, *halves = index.parts(i)
        *overlaps, whole = (float(max(np.isin(x, g).mean() for g in grams)) if len(x) else 1.0 for x in map(shingles, (*halves, every)))
        if min(overlaps) < OVERLAP and whole < OVERLAP:
            for k, part in enumerate(halves):
                if 1 < len(part) < SHINGLE:
                    part = every[-SHINGLE:] if k else every[:SHINGLE]  # noqa: PLW2901
                if overlaps[k] < OVERLAP:
                    overlaps[k] = max(overlaps[k], aligned(part, words))
                if overlaps[k] < OVERLAP:
                    break
        if min(overlaps) >= OVERLAP or whole >= OVERLAP:
            best[row, i] = max(best.get((row, i), (0.0, 0.0, 0.0)), (score, *overlaps))
    for (row, i), found in best.items():
        yield row, i, *found


def _indexes(benchmark: DataFrame, item: str, item_text: str) -> Iterator[Index]:
    """The indexes of the shards, one at a time."""
    rows = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).orderBy("item", "text")
    rows = c.checkpointed(rows.select(F.monotonically_increasing_id().alias("row"), "item", "text"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = hashed([x or "" for x in batch.column(1).to_pylist()])
            own = [np.unique(h) for h in words]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in own])), pa.array(c.signed(np.concatenate(own))), pa.array(np.repeat([len(h) for h in words], [len(x) for x in own]).astype(np.int32))], names=["row", "term", "n"])

    each = c.checkpointed(c.map_arrow(rows.select("row", "text"), terms, "row long, term long, n int"))
    sizes = each.groupBy("row").agg(F.max("n").alias("n")).agg(F.count("*").alias("items"), F.sum("n").alias("words"), F.max("n").alias("longest")).first()
    frequency = each.groupBy("term").agg(F.count("*").alias("df"))
    known = each.join(frequency, "term").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df"))
    held, df = [], {}
    for r in rows.join(known, "row").orderBy("row").toLocalIterator():
        held.append((r.item, r.text))
        df |= r.df
        if len(held) == SHARD:
            yield Index(held, sizes["items"], sizes["words"] / sizes["items"], sizes["longest"], df)
            held, df = [], {}
    if held:
        yield Index(held, sizes["items"], sizes["words"] / sizes["items"], sizes["longest"], df)


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Columns key, item, score, question_overlap, answer_overlap: a row for each document and test item in it."""
    spark = docs.sparkSession
    docs, out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")), None
    kinds = docs.schema["key"].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"key {kinds[0]}, item {kinds[1]}, score double, question_overlap double, answer_overlap double"
    of_item = to_arrow_type(benchmark.schema[item].dataType)

    def matches(sent) -> DataFrame:
        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix, lookup = sent.value, None
            for batch in batches:
                lookup = lookup or ix.lookup()
                data, offsets = c.utf8(batch.column(1))
                for lo, hi in c.chunks(offsets):
                    found = list(search(ix, lookup, *clean_words(data, offsets[lo : hi + 1])))
                    if found:
                        rows, items, *numbers = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + np.array(rows))), pa.array([ix.ids[i] for i in items], of_item), *(pa.array(x, pa.float64()) for x in numbers)], names=["key", "item", "score", "question_overlap", "answer_overlap"])

        return c.map_arrow(docs, match, schema)

    for index in _indexes(benchmark, item, item_text):
        found = matches(spark.sparkContext.broadcast(index))
        out = found if out is None else out.unionAll(found)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.toDF(key, item, "score", "question_overlap", "answer_overlap")


def leak_free(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no test item: a filter of each row by its own text, without a shuffle."""
    columns, at = docs.columns, docs.columns.index(text)
    out = docs.toDF(*(f"_c{i}" for i in range(len(columns))))  # columns of any name pass through

    def free(sent):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix, lookup = sent.value, None
            for batch in batches:
                lookup, clean = lookup or ix.lookup(), np.ones(batch.num_rows, bool)
                data, offsets = c.utf8(batch.column(at))
                for lo, hi in c.chunks(offsets):
                    for row, *_ in search(ix, lookup, *clean_words(data, offsets[lo : hi + 1])):
                        clean[lo + row] = False
                yield batch.filter(pa.array(clean))

        return keep

    for index in _indexes(benchmark, item, item_text):
        out = c.map_arrow(out, free(docs.sparkSession.sparkContext.broadcast(index)), out.schema)
    return out.toDF(*columns)


def op9_benchmark_leaks(spark, sf_dir: str) -> DataFrame:
    return leaks(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))
