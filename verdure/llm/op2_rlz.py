"""Operator 2, substring dedup: relative Lempel-Ziv parsing against all documents with smaller ids.

The reference holds every window of LENGTH words once, where it first starts: at the smallest id, and there at the first place.  Its blocks are the
stretches of a document whose windows start there first, so each window has one place (source, source_at) in one block.  A document is parsed greedily from left to
right: the factor at a position is the longest stretch that goes on word by word in a block; where no window is known, the parse steps over a word.
As a window lies in one block only, no other block can hold a longer factor of LENGTH words or more, and the next window either continues the factor or ends it.
Windows that begin in a factor and cross its end (at most LENGTH - 1 of them) are looked up as well, so a copy is found wherever the parse happened to cut.  Words
in factors and in such border windows are removed, and no others.  A text that repeats all words of one with a smaller id is one factor of it.

The index is built by Spark in two levels.  Anchors, the least of ANCHORS neighbouring hashes of GRAM words, are in every
window (GRAM + ANCHORS - 1 = LENGTH) and, chosen by content alone, the same ones in every copy; anchors of two or more documents are found by one aggregation.
Only windows with a shared anchor are looked up.  Up to MAPPED shared anchors go out as a bitmap, which lets few others through; more of them are joined with
the documents' anchors by a shuffle.  Windows are aggregated to their first place and joined with it; a hot passage is one row a task after the
partial aggregation, and a skewed join is split at run time.  What is found is sorted by document and merged into runs before it is gathered, so a document's row grows with its
runs, not with its words.  Whole copies (by digests) are left out of all that: up to WHOLE of them by a broadcast join, more by a shuffled one.
These two bounds choose joins, never results.

Windows are compared by 64 + 32 bits of hash.  Edge cases: null text is empty; rows without an id are neither changed nor references; rows of one id are
no references of each other; empty texts have no windows; a text under LENGTH words is unchanged; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

LENGTH, GRAM = 13, 5
ANCHORS = LENGTH - GRAM + 1
#: Bits of a map of shared anchors, or of documents with copied windows: 16 MB.
BITS = 1 << 27
#: Shared anchors that are told to all tasks by a bitmap, an eighth of its bits; more are joined.
MAPPED = BITS // 8
#: Whole copies that are broadcast (16 bytes each); more are joined by a shuffle.
WHOLE = 1_000_000


def anchors(words: c.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of all windows that lie in one row, the anchor hash of each)."""
    g = c.grams(h, GRAM)
    n = len(h) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = g[:n].copy()
    for i in range(1, ANCHORS):
        np.minimum(least, g[i : i + n], out=least)
    at = np.flatnonzero(c.inside(words, LENGTH))
    return at, least[at]


def digests(words: c.Words, h: np.ndarray, salt: int = 0) -> np.ndarray:
    """64 bits for each row's words."""
    out = np.zeros(len(words.count), np.uint64)
    full = np.flatnonzero(words.count)
    if len(full):
        place = (np.arange(len(h)) - words.first[words.row] + 1).astype(np.uint64)
        out[full] = np.add.reduceat(c.mix(h + place * np.uint64(0x9E3779B97F4A7C15 + 2 * salt)), words.first[:-1][full])
    return out


def row_ids(digest: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """64 bits for each row: of its words and of the hash of its id."""
    return c.signed(c.mix(digest + c.mix(hashes.astype(np.int64).view(np.uint64))))


def in_map(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    bit = ids % BITS
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs (key, text, hash) with `id` for hash: a number for each different row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = c.utf8(batch.column(1))
            for lo, hi in c.chunks(offsets):
                w, rows = c.Words(data, offsets[lo : hi + 1]), batch.slice(lo, hi - lo)
                ids = row_ids(digests(w, w.hashes()), rows.column(2).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(ids)], names=["key", "text", "id"])

    return c.map_arrow(docs, add, f"key {docs.schema['key'].dataType.simpleString()}, text string, id long")


def _whole_copies(docs: DataFrame) -> DataFrame:
    """(id, whole): texts of LENGTH words or more that a document with a smaller id repeats in full, and the smallest such id."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = c.utf8(batch.column(1))
            for lo, hi in c.chunks(offsets):
                w, rows = c.Words(data, offsets[lo : hi + 1]), batch.slice(lo, hi - lo)
                h = w.hashes()
                d = digests(w, h)
                ids = row_ids(d, rows.column(2).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(c.signed(d)), pa.array(c.signed(digests(w, h, 1))), pa.array(ids), pa.array(w.count.astype(np.int64))], names=["key", "d1", "d2", "id", "n"])

    kind = docs.schema["key"].dataType.simpleString()
    rows = c.checkpointed(c.map_arrow(docs, emit, f"key {kind}, d1 long, d2 long, id long, n long").filter(F.col("n") >= LENGTH).drop("n"))
    first = rows.groupBy("d1", "d2").agg(F.min("key").alias("whole"), F.max("key").alias("last")).filter("whole != last").drop("last")
    return c.checkpointed(rows.join(first, ["d1", "d2"]).filter("whole < key").select("id", "whole").distinct())


def _anchored(docs: DataFrame) -> DataFrame:
    """(anchor, key, id): the anchors of each document, neighbouring equal ones once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = c.utf8(batch.column(1))
            for lo, hi in c.chunks(offsets):
                w = c.Words(data, offsets[lo : hi + 1])
                at, anchor = anchors(w, w.hashes())
                new = np.append(True, (anchor[1:] != anchor[:-1]) | (w.row[at[1:]] != w.row[at[:-1]]))[: len(at)]
                rows = pa.array(lo + w.row[at[new]])
                yield pa.RecordBatch.from_arrays([pa.array(c.signed(anchor[new])), batch.column(0).take(rows), batch.column(2).take(rows)], names=["anchor", "key", "id"])

    return c.map_arrow(docs, emit, f"anchor long, key {docs.schema['key'].dataType.simpleString()}, id long")


def _bitmap(numbers: DataFrame) -> np.ndarray:
    """A bit for each of one column of numbers. Gathered in parts of 32768 bits: at most BITS in all, however many numbers there are."""
    bit = F.pmod(F.col(numbers.columns[0]), F.lit(BITS)) + 1  # the parts count from 1
    out = np.zeros(BITS // 8, np.uint8)
    parts = numbers.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
    for r in parts.toLocalIterator():
        out[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _windows(docs: DataFrame, bitmap) -> DataFrame:
    """(gram, proof, key, id, at): the windows whose anchor is in the bitmap, or in the fourth column of docs."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = c.utf8(batch.column(1))
            for lo, hi in c.chunks(offsets):
                w = c.Words(data, offsets[lo : hi + 1])
                h = w.hashes()
                at, anchor = anchors(w, h)
                if bitmap is not None:
                    at = at[in_map(bitmap.value, c.signed(anchor))]
                else:
                    lists = batch.column(3).slice(lo, hi - lo)
                    row = np.repeat(np.arange(hi - lo, dtype=np.uint64), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                    own = c.mix(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) + c.mix(row))
                    at = at[np.isin(c.mix(anchor + c.mix(w.row[at].astype(np.uint64))), own)]
                one, two = c.grams(h, LENGTH, 1)[at], c.grams(h, LENGTH, 2)[at]
                place, rows = (at - w.first[w.row[at]]).astype(np.int32), pa.array(lo + w.row[at])
                yield pa.RecordBatch.from_arrays([pa.array(c.signed(one)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)), batch.column(0).take(rows), batch.column(2).take(rows), pa.array(place)], names=["gram", "proof", "key", "id", "at"])

    return c.map_arrow(docs, emit, f"gram long, proof int, key {docs.schema['key'].dataType.simpleString()}, id long, at int")


def _copied(docs: DataFrame) -> DataFrame:
    """(id, at, source, source_id, source_at): windows that a document with a smaller id has, and where they are in the reference."""
    anchored = _anchored(docs)
    shared = c.checkpointed(anchored.groupBy("anchor").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a != b").select("anchor"))
    if shared.count() <= MAPPED:
        windows = _windows(docs, docs.sparkSession.sparkContext.broadcast(_bitmap(shared)))
    else:
        own = anchored.join(shared, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("anchors"))
        windows = _windows(docs.join(own, "id").select("key", "text", "id", "anchors"), None)
    first = windows.groupBy("gram", "proof").agg(F.min(F.struct("key", "id", "at")).alias("first"), F.max("key").alias("last")).filter("first.key != last").drop("last")
    return windows.join(first, ["gram", "proof"]).filter("first.key < key").select("id", "at", F.col("first.key").alias("source"), F.col("first.id").alias("source_id"), F.col("first.at").alias("source_at"))


def _runs(copied: DataFrame) -> DataFrame:
    """(id, at, n, source, source_at): the windows of a document that follow each other there and in one block; n of them."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch.cast(held.schema)]).combine_chunks()
            if not table.num_rows:
                continue
            doc, at, sid, sat = (table[n].to_numpy() for n in ("id", "at", "source_id", "source_at"))
            n = table["n"].to_numpy()
            same = (doc[1:] == doc[:-1]) & (at[1:] <= at[:-1] + n[:-1] - 1)  # a repeated row's window again
            if same.any():
                table = table.filter(pa.array(np.append(True, ~same)))
                doc, at, sid, sat, n = (table[x].to_numpy() for x in ("id", "at", "source_id", "source_at", "n"))
            go = (doc[1:] == doc[:-1]) & (at[1:] == at[:-1] + n[:-1]) & (sid[1:] == sid[:-1]) & (sat[1:] == sat[:-1] + n[:-1])
            begin = np.flatnonzero(np.append(True, ~go))
            out = table.take(pa.array(begin)).set_column(table.schema.get_field_index("n"), "n", pa.array(np.add.reduceat(n, begin).astype(np.int32)))
            yield from out.slice(0, out.num_rows - 1).select(names).to_batches()
            held = out.slice(out.num_rows - 1).combine_chunks().to_batches()[0]
        if held is not None:
            yield pa.RecordBatch.from_arrays([held.column(held.schema.get_field_index(x)) for x in names], names=names)

    names = ["id", "at", "n", "source", "source_at"]
    dealt = copied.withColumn("n", F.lit(1)).repartition("id").sortWithinPartitions("id", "at")
    return c.map_arrow(dealt, merge, f"id long, at int, n int, source {copied.schema['source'].dataType.simpleString()}, source_at int")


def greedy(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The parse of one document with the runs of windows (from `at`, n of them, rising): (which run a factor is cut from, the factor's first word) and (low, high): the
    words of the windows that begin in a factor, cross its end and are known themselves."""
    which, begin, low, high, position = [], [], [], [], 0
    for i, (a, k) in enumerate(zip(at.tolist(), n.tolist(), strict=True)):
        if a < position:  # its first windows begin in the factor before, at most LENGTH - 1 words ahead of the end
            low.append(a)
            high.append(min(a + k, position) - 1 + LENGTH)
        if a + k > position:  # it has a window at the position or later
            which.append(i)
            begin.append(max(a, position))
            position = a + k - 1 + LENGTH
    return tuple(np.array(x, np.int64) for x in (which, begin, low, high))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """Columns key, n_words, n_removed, kept_sha256, factors (array of start, length, source and source_at, in words) and, with `texts`, kept."""
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(key).alias("hash"))
    known = docs.filter(F.col("key").isNotNull())
    whole = _whole_copies(known)
    sent = F.broadcast(whole) if whole.count() <= WHOLE else whole
    fresh = _numbered(known).join(sent.select("id"), "id", "left_anti").select("key", "text", "id")
    runs = c.checkpointed(_runs(_copied(fresh)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "n", "source", "source_at"))).alias("runs")))
    touched = context.broadcast(_bitmap(runs.select("id")))
    kind = docs.schema["key"].dataType.simpleString()

    def part(hit: bool):
        """The rows that may have copied windows, or the others."""

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = c.utf8(batch.column(1))
                for lo, hi in c.chunks(offsets):
                    w, rows = c.Words(data, offsets[lo : hi + 1]), batch.slice(lo, hi - lo)
                    ids = row_ids(digests(w, w.hashes()), rows.column(2).to_numpy(zero_copy_only=False))
                    out = pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(ids)], names=["key", "text", "id"])
                    yield out.filter(pa.array(in_map(touched.value, ids) == hit))

        return c.map_arrow(docs, emit, f"key {kind}, text string, id long").join(sent, "id", "left")

    found = F.when(F.col("key").isNotNull() & F.col("whole").isNull(), F.col("runs"))  # a row without an id may have another's number
    wide = lambda df: df.select("key", "text", F.when(F.col("key").isNotNull(), F.col("whole")).alias("whole"), *(found[x].alias(x) for x in ("at", "n", "source", "source_at")))
    none = F.lit(None).cast(runs.schema["runs"].dataType)
    marked = wide(part(True).join(runs, "id", "left")).unionAll(wide(part(False).withColumn("runs", none)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = c.utf8(batch.column(1))
            for lo, hi in c.chunks(offsets):
                part = batch.slice(lo, hi - lo)
                w = c.Words(data, offsets[lo : hi + 1])
                gone = np.zeros(len(w.start) + 1, np.int32)
                runs, copy = part.column(3).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), part.column(2).is_valid().to_numpy(zero_copy_only=False)
                at, n, source_at = (part.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4, 6))
                first = np.append(0, np.cumsum(runs))
                picked, starts, sizes, places, of = [], [], [], [], np.zeros(hi - lo + 1, np.int32)
                for r in np.flatnonzero((runs > 0) | copy).tolist():
                    base, a = w.first[r], first[r]
                    if copy[r]:
                        starts.append(np.zeros(1, np.int64))
                        sizes.append(w.count[r : r + 1])
                        places.append(np.zeros(1, np.int64))
                        gone[base] += 1
                        gone[base + w.count[r]] -= 1
                        of[r + 1] = 1
                        continue
                    mine = slice(a, first[r + 1])
                    which, begin, low, high = greedy(at[mine], n[mine])
                    end = at[mine][which] + n[mine][which] - 1 + LENGTH
                    # Removed are the factors' words and those of the windows looked up at factors' ends, nothing else.
                    np.add.at(gone, base + np.concatenate([begin, low]), 1)
                    np.add.at(gone, base + np.concatenate([end, high]), -1)
                    picked.append(a + which)
                    starts.append(begin)
                    sizes.append(end - begin)
                    places.append(source_at[mine][which] + begin - at[mine][which])
                    of[r + 1] = len(which)
                kept = np.cumsum(gone[:-1]) == 0
                whole = np.flatnonzero(copy)
                join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
                # Sources: of the runs by place, of whole copies by row, in the order of the rows.
                runs_of = np.repeat(np.arange(hi - lo), np.where(copy, 0, of[1:]))
                order = np.argsort(np.concatenate([runs_of, whole]), kind="stable")
                sources = pa.concat_arrays([part.column(5).flatten().take(pa.array(join(picked))), part.column(2).take(pa.array(whole))]).take(pa.array(order))
                columns = [pa.array(join(starts).astype(np.int32)), pa.array(join(sizes).astype(np.int32)), sources, pa.array(join(places).astype(np.int32))]
                factors = pa.ListArray.from_arrays(pa.array(np.cumsum(of).astype(np.int32)), pa.StructArray.from_arrays(columns, names=["start", "length", "source", "source_at"]))
                start, end = w.start[kept], w.end[kept]
                length = end - start + 1  # with a space
                total = np.concatenate([[0], np.cumsum(length)])
                index = np.arange(total[-1]) + np.repeat(start - total[:-1], length)
                out = np.where(index == np.repeat(end, length), 32, w.buf[np.minimum(index, max(0, len(w.buf) - 1))]).astype(np.uint8) if len(index) else np.zeros(0, np.uint8)
                bounds = total[np.searchsorted(w.row[kept], np.arange(hi - lo + 1))]
                raw = out.tobytes()
                pieces = [raw[a : max(a, b - 1)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                removed = np.bincount(w.row[~kept], minlength=hi - lo)
                columns = [part.column(0), pa.array(w.count), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in pieces]), factors]
                names = ["key", "n_words", "n_removed", "kept_sha256", "factors"]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array([x.decode("utf-8", "replace") for x in pieces])] if texts else [])], names=[*names, *(["kept"] if texts else [])])

    out = c.map_arrow(marked, cut, f"key {kind}, n_words long, n_removed long, kept_sha256 string, factors array<struct<start:int,length:int,source:{kind},source_at:int>>" + ", kept string" * texts)
    return out.withColumnRenamed("key", key)


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS line, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT line, doc_id, words, unnest(range(1, len(words) - 11)) AS since FROM d WHERE len(words) >= 13),
w AS (SELECT line, doc_id, since, sha256(array_to_string(words[since : since + 12], ' ')) AS seq FROM s),
f AS (SELECT seq, min(doc_id) AS first FROM w GROUP BY 1),
gone AS (SELECT DISTINCT line, since + k AS place FROM w JOIN f USING (seq), range(13) r(k) WHERE first < doc_id),
x AS (SELECT line, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM d),
kept AS (SELECT line, string_agg(word, ' ' ORDER BY place) AS words, count(*) AS n FROM x ANTI JOIN gone USING (line, place) GROUP BY 1)
SELECT doc_id, len(d.words)::BIGINT AS n_words, (len(d.words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (line)
"""


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicated(c.table(spark, sf_dir, "documents"), texts=False).drop("factors")
