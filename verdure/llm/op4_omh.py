"""Operator 4, near duplicates: order MinHash, verified by banded alignment.

Shingles are labelled with their occurrence number in the text.  Each sketch takes the `picked` shingles with the least hashes
and keeps them in the order of the text, so that equal sketches speak for equal order: texts with the same shingles shuffled don't meet.
There are two FAMILIES of sketches.  Shingles of five words find texts of shingle similarity 0.8: two miss each other with probability
(1 - 0.8**4)**8 = 0.015.  Isolated changes lower that similarity far more than the edit similarity, so sketches of word pairs serve the accepted relation:
of n words with a share s changed one by one, pairs have the similarity J = (1-s)**2 / (2 - (1-s)**2), and two texts miss each other with probability (1 - J**3)**28: 0.05 at s = 0.2,
0.004 at 0.15.  Texts of at most SHORT words also meet in prefixes of their grams (see short_keys), which
loses no pair: among them the accepted relation is complete.
A candidate pair is near if its word edit distance, found in a band that widens up to what is allowed, is at most (1 - SIMILARITY) of the longer text.

Copies of one word sequence are one class from the start; they are known by a digest of 128 bits of their words, not by id.  Each text is first compared with the least digest of all its buckets of the first family, then with
the least digest of each other bucket where the two aren't linked to one text already, so a group of thousands gives a few pairs for each of its texts.  Classes are joined (least label, to a fixed point).  Only texts of one bucket that are in different
classes still are compared with each other: a grid of blocks counts their words in BINS bins (an edit changes a bin by one) and aligns the pairs that the counts
don't part.  A pair is looked at in the least bucket that it shares.  What comes out of a cell is a forest, at most a link for each of its texts, not pairs; texts that the cell's links have joined
aren't compared again.  Pairs within a class can't change it, so no link between classes is left out.  Nothing is capped.

Edge cases: null and empty texts, and texts without a word, are classes of their own; a text shorter than a shingle is one shingle; rows of one id are one document if they
have the same words, else the id is listed once for each; a null id is listed with the class of its words, a class without other ids has the null id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import common as c

SIMILARITY = 0.8
#: (words of a shingle, shingles picked for a sketch, sketches)
FAMILIES = ((5, 4, 8), (2, 3, 28))
SKETCHES = sum(n for *_, n in FAMILIES)
#: Sketches of the first family.
FIRST = "(sketch & 2 = 0)"
#: Words are counted in so many bins, to 255 each: texts whose counts differ by more than may are not compared.
BINS = 512
#: Members of a bucket are counted against each other in blocks of about so many.
BLOCK = 2048
#: Pairs of a cell that are compared at once.
WAITING = 512
#: Ids of 16 bytes that are broadcast at most.
BROADCAST = 1_000_000
#: Texts of at most so many words are found without loss.
SHORT = 64


def labelled_shingles(w: c.Words, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash with occurrence number, row, first of each row) in the order of the text."""
    at = np.flatnonzero(c.inside(w, size))
    x, row = c.grams(h, size)[at], w.row[at]
    short = np.flatnonzero((w.count > 0) & (w.count < size))
    if len(short):
        own = np.array([c.grams(h[w.first[r] : w.first[r + 1]], int(w.count[r]), 1)[0] for r in short], np.uint64)
        order = np.argsort(np.concatenate([row, short]), kind="stable")
        x, row = np.concatenate([x, own])[order], np.concatenate([row, short])[order]
    both = c.mix(x + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(both, kind="stable")
    same = np.append(False, both[order][1:] == both[order][:-1])[: len(order)]
    if same.any():
        run = np.arange(len(order)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        occurrence = np.empty(len(order), np.uint64)
        occurrence[order] = run
        x = c.mix(x + occurrence * np.uint64(0xD6E8FEB86659FD93))
    return x, row, np.searchsorted(row, np.arange(len(w.count) + 1))


def digests(w: c.Words, h: np.ndarray) -> pa.Array:
    """16 bytes for each row's word sequence; zeros without a word."""
    out = np.zeros((len(w.count), 2), np.uint64)
    full = np.flatnonzero(w.count)
    if len(full):
        place = (np.arange(len(h)) - w.first[w.row]).astype(np.uint64)
        for i, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            out[full, i] = np.add.reduceat(c.mix(h + (place + np.uint64(1)) * np.uint64(salt)), w.first[:-1][full])
    return pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer((np.arange(len(out) + 1) * 16).astype(np.int32)), pa.py_buffer(out.tobytes())])


def prefixes(similarity: float) -> dict[int, list[int]]:
    """{gram size: number of grams that a text of n words, n the place in the list, is met by}.

    A pair whose longer text has m words is near within d = (1 - similarity) * m edits, and an edit changes at most q of the m - q + 1 grams of q words, so
    t = m - q + 1 - q * d are shared.  Of two sets that share t the least |x| - t + 1 have one in common, in any order.  Of the sizes with t >= 1 the largest is taken for each m."""
    out = {q: [0] * (SHORT + 1) for q in (1, 2, 3)}
    for m in range(1, SHORT + 1):
        d = int((1 - similarity) * m + 1e-9)
        q = next(q for q in (3, 2, 1) if m - q + 1 - q * d >= 1 or q == 1)
        for n in range(max(1, m - d), m + 1) if d else ():
            out[q][n] = max(out[q][n], min(n - q + 1, n - m + q * d + 1))
    return out


def short_keys(w: c.Words, h: np.ndarray, least: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the grams by which texts of at most SHORT words meet, those of the least hashes."""
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    few = np.where(w.count <= SHORT, w.count, 0)
    for q, wanted in least.items():
        many = np.array(wanted)[few]
        if not many.any():
            continue
        x, row, _ = labelled_shingles(w, h, q)
        some = many[row] > 0
        x, row = c.mix(x[some] ^ np.uint64(0xA0761D6478BD642F * (SKETCHES + 1 + q) % 2**64)) | np.uint64(3), row[some]
        order = np.lexsort((x, row))
        x, row = x[order], row[order]
        mine = np.arange(len(row)) - np.searchsorted(row, np.arange(len(few)))[row] < many[row]
        rows.append(row[mine])
        keys.append(x[mine])
    return np.concatenate(rows), np.concatenate(keys)


def sketches(x: np.ndarray, row: np.ndarray, first: np.ndarray, picked: int, many: int, salt: int = 0) -> np.ndarray:
    """rows x `many` hashes of the `picked` least shingles in the order of the text; 0 without shingles."""
    n = np.diff(first)
    out = np.zeros((len(n), many), np.uint64)
    if not len(x):
        return out
    share = np.minimum(1.0, 4.0 * picked / np.maximum(n, 1))
    low = np.where(share < 1, (share * 2.0**64 * (1 - 2**-20)).astype(np.uint64), np.uint64(2**64 - 1))
    limit = low[row]
    for s in range(many):
        y = c.mix(x ^ np.uint64(0xA0761D6478BD642F * (salt + s + 1) % 2**64))
        some = np.flatnonzero(y <= limit)
        got = np.bincount(row[some], minlength=len(n))
        poor = np.flatnonzero(got < np.minimum(n, picked))
        if len(poor):  # too few under the limit: those rows are looked at in full
            some = np.union1d(some, np.concatenate([np.arange(first[r], first[r + 1]) for r in poor]))
        order = np.lexsort((some, y[some], row[some]))
        r = row[some[order]]
        rank = np.arange(len(r)) - np.searchsorted(r, np.arange(len(n)))[r]
        chosen = np.sort(some[order[rank < picked]])
        r = row[chosen]
        place = np.arange(len(r)) - np.searchsorted(r, np.arange(len(n)))[r]
        held = np.zeros((len(n), picked), np.uint64)
        held[r, place] = x[chosen]
        key = np.full(len(n), np.uint64(salt + s + 1), np.uint64)
        for i in range(picked):
            key = c.mix(key * np.uint64(0x9E3779B97F4A7C15) + held[:, i])
        out[:, s] = np.where(n > 0, key | np.uint64(1), 0)
    return out


def all_sketches(w: c.Words, h: np.ndarray) -> np.ndarray:
    """rows x SKETCHES, those of each of FAMILIES in turn."""
    out, salt = [], 0
    for size, picked, many in FAMILIES:
        keys = sketches(*labelled_shingles(w, h, size), picked, many, salt)
        out.append(np.where(keys > 0, keys | np.uint64(2), 0) if salt else keys & ~np.uint64(2))  # FIRST tells the first family by this bit
        salt += many
    return np.concatenate(out, 1)


def _unshared(a: np.ndarray, b: np.ndarray) -> int:
    """Words of the one that the other lacks, whatever their order: no more than the edit distance."""
    x = np.sort(np.concatenate([a << np.uint64(1), (b << np.uint64(1)) | np.uint64(1)]))
    word = x >> np.uint64(1)
    cut = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    of_b = np.add.reduceat((x & np.uint64(1)).astype(np.int64), cut)
    of_a = np.diff(np.append(cut, len(x))) - of_b
    return int(max(np.maximum(of_a - of_b, 0).sum(), np.maximum(of_b - of_a, 0).sum()))


def edit_distances(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Word edit distance of each pair; if it is above the pair's `most`, a number above `most` and not above the distance. Bands widen until they hold the distance."""
    out = most + 1
    la, lb = (np.array([len(y) for y in x]) for x in (a, b))
    far = np.abs(la - lb) > most
    out[far] = np.abs(la - lb)[far]
    left = np.flatnonzero(~far)
    band = 4
    while len(left):
        if band == 16:  # what is left is far more often than not: most of it shares too few words
            least = np.array([_unshared(a[i], b[i]) for i in left])
            far = least > most[left]
            out[left[far]] = least[far]
            left = left[~far]
            if not len(left):
                break
        left = left[np.argsort(np.maximum(la[left], lb[left]), kind="stable")]
        undecided, at = [], 0
        while at < len(left):
            size = max(1, int(400_000 // (max(la[left[at]], lb[left[at]]) + 2 * band + 1)))
            some = left[at : at + min(size, 512)]
            longest = max(la[some].max(), lb[some].max())
            some = some[: max(1, int(1_000_000 // (longest + 2 * band + 1)))]
            at += len(some)
            d = _banded([a[i] for i in some], [b[i] for i in some], band)
            done = (d <= band) | (band >= most[some])
            out[some[done]] = np.minimum(d[done], most[some[done]] + 1)
            undecided.append(some[~done])
        left = np.concatenate(undecided)
        band *= 4
    return out


def _banded(a: list[np.ndarray], b: list[np.ndarray], t: int) -> np.ndarray:
    """Distances by dynamic programming over the diagonals -t .. t, all pairs in step; those that leave the band come out too large."""
    n, width = len(a), 2 * t + 1
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    x, y = np.zeros((n, la.max() + 1), np.uint64), np.full((n, max(la.max(), lb.max()) + 2 * t + 2), np.uint64(1), np.uint64)
    for i in range(n):
        x[i, : la[i]] = a[i]
        y[i, t : t + lb[i]] = b[i]
    step = np.arange(width, dtype=np.int32)
    d = np.where(step >= t, step - t, 1 << 28).astype(np.int32)[None].repeat(n, 0)
    out = np.full(n, 1 << 28)
    end = lb - la + t
    ok = (end >= 0) & (end < width)
    for i in range(la.max() + 1):
        now = np.flatnonzero((la == i) & ok)
        out[now] = d[now, end[now]]
        if i == la.max():
            break
        cur = d + (y[:, i : i + width] != x[:, i : i + 1])
        cur[:, :-1] = np.minimum(cur[:, :-1], d[:, 1:] + 1)
        d = np.minimum.accumulate(cur - step, axis=1) + step
    return out


def _distances(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The near ones of pairs: (a, b). Only their own texts are shuffled: up to BROADCAST ids are told to all tasks, more are joined."""
    ids = pairs.select(F.col("a").alias("id")).distinct().unionAll(pairs.select(F.col("b").alias("id")).distinct()).distinct()
    texts = texts.join(F.broadcast(ids) if 2 * pairs.count() <= BROADCAST else ids, "id", "left_semi")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (da, oa), (db, ob) = c.utf8(batch.column(2)), c.utf8(batch.column(3))
            for lo, hi in c.chunks(oa + ob, 8 << 20):
                lists = []
                for data, offsets in ((da, oa), (db, ob)):
                    w = c.Words(data, offsets[lo : hi + 1])
                    h = w.hashes() | np.uint64(2)
                    lists.append([h[w.first[i] : w.first[i + 1]] for i in range(hi - lo)])
                most = np.array([int((1 - similarity) * max(len(x), len(y)) + 1e-9) for x, y in zip(*lists, strict=True)])
                d = edit_distances(*lists, most)
                yield pa.RecordBatch.from_arrays(batch.slice(lo, hi - lo).columns[:2], names=["a", "b"]).filter(pa.array(d <= most))

    kind = pairs.schema["a"].dataType.simpleString()
    return c.map_arrow(both, check, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(id, label): the least id of each id's connected component. links: (a, b). Labels are taken from neighbours, then from the label's own label."""
    edges = c.checkpointed(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = c.checkpointed(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    while True:
        near = edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        better = labels.join(near, labels.id == near.a).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = c.checkpointed(better.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        if not new.filter("label != old").limit(1).count():
            return new.select("id", "label")
        labels = new.select("id", "label")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links."""
    if not links.limit(1).count():
        return labels
    return components(labels.filter("id != label").select(F.col("label").alias("a"), F.col("id").alias("b")).unionAll(links))


def _torn_links(buckets: DataFrame, labels: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): near texts of one bucket with different labels; of a block's cell a forest, no link between two that its other links join already."""
    inside = buckets.join(labels, buckets.rep == labels.id, "left").select("sketch", "rep", F.coalesce("label", "rep").alias("label"))
    torn = inside.groupBy("sketch").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.ceil(F.count("*") / BLOCK).alias("blocks")).filter("x != y").select("sketch", "blocks")
    inside = c.checkpointed(inside.join(torn, "sketch").distinct())
    members = inside.groupBy("rep").agg(F.max("label").alias("label"), F.collect_set("sketch").alias("keys"))
    members = c.checkpointed(members.join(texts.select(F.col("id").alias("rep"), "text"), "rep"))
    own, other = F.pmod(F.xxhash64("rep"), "blocks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    cells = inside.select("sketch", "rep", own.alias("own"), other.alias("other")).withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("other")
    kind = buckets.schema["rep"].dataType.simpleString()

    def compare(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("rep").combine_chunks()
        sketch, across = cell["sketch"][0].as_py(), cell["x"][0] != cell["y"][0]
        block, label = cell["own"].to_numpy(), cell["label"].combine_chunks().dictionary_encode().indices.to_numpy().copy()
        words, bags = [], []
        data, offsets = c.utf8(cell["text"].combine_chunks())
        for lo, hi in c.chunks(offsets):
            w = c.Words(data, offsets[lo : hi + 1])
            h = w.hashes() | np.uint64(2)
            words += [h[w.first[i] : w.first[i + 1]] for i in range(hi - lo)]
            bags.append(np.minimum(np.bincount(w.row * BINS + ((h >> np.uint64(2)) % np.uint64(BINS)).astype(np.int64), minlength=(hi - lo) * BINS), 255).astype(np.uint8).reshape(hi - lo, BINS))
        bag, n = np.concatenate(bags), np.array([len(x) for x in words])
        total = bag.sum(1, dtype=np.int64)
        lists = cell["keys"].to_pylist()
        keys = np.full((len(n), max(map(len, lists))), sketch, np.int64)
        for i, x in enumerate(lists):
            keys[i, : len(x)] = x
        links, waiting = [], []

        def settle() -> None:
            """Compare the pairs that wait; near ones become links and one label."""
            a, b = np.concatenate([np.full(len(j), i) for i, j in waiting]), np.concatenate([j for _, j in waiting])
            most = np.array([int((1 - similarity) * max(x, y) + 1e-9) for x, y in zip(n[a], n[b], strict=True)])
            d = edit_distances([words[i] for i in a], [words[i] for i in b], most)
            for i, j in zip(a[d <= most], b[d <= most], strict=True):
                if label[i] != label[j]:
                    links.append((i, j))
                    label[label == label[j]] = label[i]
            waiting.clear()

        for i in range(len(n) - 1):
            most = np.maximum(n[i], n[i + 1 :])
            fits = (label[i + 1 :] != label[i]) & (np.minimum(n[i], n[i + 1 :]) >= most * similarity - 1e-9)
            if across:
                fits &= block[i + 1 :] != block[i]
            j = np.flatnonzero(fits) + i + 1
            lesser = keys[i][keys[i] < sketch]
            if len(j) and len(lesser):  # they have met in a lesser bucket
                j = j[~np.isin(keys[j], lesser).any(1)]
            if len(j):
                apart = np.abs(bag[j].astype(np.int16) - bag[i]).sum(1, dtype=np.int64) + np.abs(total[j] - total[i])
                j = j[apart <= 2 * (most[j - i - 1] * (1 - similarity) + 1e-9)]
            for k in range(0, len(j), WAITING):
                some = j[k : k + WAITING]
                some = some[label[some] != label[i]]
                if len(some):
                    waiting.append((i, some))
                if sum(len(x) for _, x in waiting) >= WAITING:
                    settle()
        if waiting:
            settle()
        rep, at = cell["rep"].combine_chunks(), np.array(links, np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([rep.take(pa.array(at[:, k])) for k in (0, 1)], names=["a", "b"])

    return cells.join(members, "rep").groupBy("sketch", "x", "y").applyInArrow(compare, f"a {kind}, b {kind}")


def digested(docs: DataFrame, text: str = "text", name: str = "node") -> DataFrame:
    """docs with a binary column `name`: the digest of the text's words."""
    at = docs.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = c.utf8(batch.column(at))
            for lo, hi in c.chunks(offsets):
                w = c.Words(data, offsets[lo : hi + 1])
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, digests(w, w.hashes())], names=[*batch.schema.names, name])

    return c.map_arrow(docs, add, StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def _row(key: str, node: str) -> Column:
    """One key for id and words, null ids included."""
    return F.concat(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")), F.lit(":"), F.hex(node))


def _classes(docs: DataFrame, key: str, text: str, similarity: float) -> DataFrame:
    """(id, node, class_id, class_node, copy_of): of each row the least id of its class, the digest of that id's words, and the least id of its own words."""
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    least = prefixes(similarity)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = c.utf8(batch.column(1))
            for lo, hi in c.chunks(offsets):
                w = c.Words(data, offsets[lo : hi + 1])
                h = w.hashes()
                s = all_sketches(w, h)
                also, more = short_keys(w, h, least)
                n = SKETCHES + np.bincount(also, minlength=hi - lo)
                row = np.concatenate([np.repeat(np.arange(hi - lo), SKETCHES), also])
                keys = np.concatenate([s.ravel(), more])[np.argsort(row, kind="stable")]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(c.signed(keys)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), digests(w, h), pa.array(w.count.astype(np.int64)), lists], names=["id", "node", "n", "keys"])

    rows = c.checkpointed(c.map_arrow(docs, sketch, f"id {kind}, node binary, n long, keys array<long>"))
    worded = rows.filter("n > 0")
    copies = c.checkpointed(worded.groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    every = copies.select(F.col("node").alias("rep"), "n", F.explode(F.array_distinct("keys")).alias("sketch"))
    lead = c.checkpointed(every.groupBy("sketch").agg(F.min(F.struct("rep", "n")).alias("lead"), F.count("*").alias("size")).filter("size > 1").select("sketch", "lead"))
    buckets = c.checkpointed(every.join(lead, "sketch", "left_semi"))  # those of two texts or more
    alike = lambda x, y: F.least(x, y) >= F.greatest(x, y) * F.lit(similarity) - 1e-9  # noqa: E731  else more words differ than may
    star = buckets.join(lead, "sketch").filter((F.col("rep") != F.col("lead.rep")) & alike(F.col("n"), F.col("lead.n"))).select(F.col("lead.rep").alias("a"), F.col("rep").alias("b"), "sketch")
    pairs = c.checkpointed(star.filter(FIRST).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    met = buckets.select(F.col("rep").alias("met")).distinct()
    met = copies.join(met, F.col("node") == F.col("met"), "left_semi").select(F.col("node").alias("met"), "least")
    # Of texts that share a sketch; copies stay away by their ids, so that a much copied text isn't one task's.
    own = digested(docs).withColumn("_row", _row("id", "node")).join(met.select(_row("least", "met").alias("_row")), "_row", "left_semi")
    texts = c.checkpointed(own.dropDuplicates(["_row"]).select(F.col("node").alias("id"), "text"))
    links = c.checkpointed(_distances(pairs, texts, similarity))
    # The other leads, unless both texts are linked to one already, by a step or two; then all that share a bucket across classes.
    one = links.select(F.col("b").alias("id"), F.col("a").alias("to"))
    known = c.checkpointed(one.join(one.select(F.col("id").alias("to"), F.col("to").alias("on")), "to", "left").select("id", F.coalesce("on", "to").alias("to")))
    of = lambda x: known.select(F.col("id").alias(x), F.col("to").alias(f"to_{x}"))
    apart = star.select("a", "b").distinct().join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("to_a", "a") != F.coalesce("to_b", "b")).select("a", "b")
    apart = c.checkpointed(apart.join(pairs, ["a", "b"], "left_anti"))
    labels = components(links.unionAll(_distances(apart, texts, similarity)))
    labels = _joined(labels, c.checkpointed(_torn_links(buckets.select("rep", "sketch"), labels, texts, similarity).distinct()))
    classes = copies.select("node", "least").join(labels, copies.node == labels.id, "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    first = classes.groupBy("label").agg(F.min(F.struct(F.isnull("least").alias("null"), "least", "node")).alias("first"))
    classes = classes.join(first, "label").select("node", F.col("first.least").alias("class_id"), F.col("first.node").alias("class_node"), F.col("least").alias("copy_of"))
    out = worded.select("id", "node").join(classes, "node").select("id", "node", "class_id", "class_node", "copy_of")
    return out.unionAll(rows.filter("n = 0").select("id", "node", F.col("id").alias("class_id"), F.col("node").alias("class_node"), F.col("id").alias("copy_of")))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Columns key, class_id (the least id of the class), copy_of (the least id with the same words)."""
    return _classes(docs, key, text, similarity).select(F.col("id").alias(key), "class_id", "copy_of")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Of each class of near copies the row with the least id (null is the last of ids), known by id and words; of rows alike in both, one. Columns of any name pass through."""
    columns = docs.columns
    rows = _classes(docs, key, text, similarity)
    least = rows.filter(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node"))).select(_row("id", "node").alias("_row")).distinct()
    docs = digested(docs.toDF(*(f"_c{i}" for i in range(len(columns)))), f"_c{columns.index(text)}")
    docs = docs.withColumn("_row", _row(f"_c{columns.index(key)}", "node")).drop("node")
    return docs.join(least, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row").toDF(*columns)


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_classes(c.table(spark, sf_dir, "documents"))
