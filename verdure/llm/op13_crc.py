"""Operator 13, target-distribution importance resampling over hashed word runs, their hashes by a position-table CRC.

crc32 is linear over XOR: a byte's share depends on its value and its distance from the end alone, and what is left depends on the length.
Shares of all bytes at 128 distances are a table; a feature's crc is the XOR of its bytes' shares
(bitwise_xor.reduceat over feature spans) and its length's constant.  Longer spans fold in blocks of 128 bytes: the state so far moves on by
128 zero bytes (four tables of 256), then takes in the next block.

Features (runs of 1 to 3 words) fall into buckets.  A first pass counts buckets in each task, Spark sums them; 10,000 log ratios of target to corpus
make the gains, sent out as a broadcast of fixed size.  A second pass adds up each document's gains.  Gumbel noise by the id's
sha256 makes the highest scores a weighted sample without replacement.  Ranks come from ranges of the score: only the ranges' counts are summed in one
place, so no task holds all rows and no row is dropped.

A text longer than CHUNK bytes is handled in parts that share two words, so memory is bounded by the part, or by its longest word.

Edge cases: null and empty texts have no features, weight 0 and no rank; a null id is hashed as an empty one; of rows with equal score and id any order may hold, each has a
rank of its own; an empty target leaves gains of a uniform one; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

BUCKETS, RUN, PERCENT, LEAST_WORDS, SEED = 10_000, 3, 5, 20, 42
NEAR, CHUNK = 128, 1 << 19

_SPACE = np.ones(256, bool)
_SPACE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_RAW_SPACE = _SPACE.copy()  # before A-Z are lower-cased
_RAW_SPACE[65:91] = False


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SHARES[d * 256 + b]: byte b with d bytes behind it.  LENGTHS[n]: the initial state after n bytes.  MOVES[j, v]: byte j of a state after NEAR zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    move = lambda state: (state >> np.uint32(8)) ^ one[state & np.uint32(255)]  # noqa: E731  a zero byte
    shares, lengths = [one], [np.array([0xFFFFFFFF], np.uint32)]
    moves = np.arange(256, dtype=np.uint32)[None, :] << np.uint32([[0], [8], [16], [24]])
    for _ in range(NEAR):
        shares.append(move(shares[-1]))
        lengths.append(move(lengths[-1]))
        moves = move(moves)
    return np.concatenate(shares[:NEAR]), np.concatenate(lengths), moves


SHARES, LENGTHS, MOVES = _tables()


def _block(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XOR of the shares of each span's bytes, spans of 1 to NEAR bytes."""
    at, first = c.spread(start, end - start)
    away = np.repeat(end - 1, end - start) - at
    return np.bitwise_xor.reduceat(SHARES[(away << 8) + buf[at]], first[:-1])


def crc32(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each span; spans aren't empty."""
    out = np.zeros(len(start), np.uint32)
    size = end - start
    short, long = np.flatnonzero(size <= NEAR), np.flatnonzero(size > NEAR)
    if len(short):
        out[short] = LENGTHS[size[short]] ^ _block(buf, start[short], end[short])
    if len(long):
        at = start[long] + (size[long] - 1) % NEAR + 1  # the first block takes what NEAR leaves
        state, to = LENGTHS[at - start[long]] ^ _block(buf, start[long], at), end[long]
        while True:
            more = np.flatnonzero(at < to)
            if not len(more):
                break
            s, a = state[more], at[more]
            moved = MOVES[0, s & 255] ^ MOVES[1, (s >> np.uint32(8)) & 255] ^ MOVES[2, (s >> np.uint32(16)) & 255] ^ MOVES[3, s >> np.uint32(24)]
            state[more] = moved ^ _block(buf, a, a + NEAR)
            at[more] = a + NEAR
        out[long] = state
    return out ^ np.uint32(0xFFFFFFFF)


def features(data: np.ndarray, offsets: np.ndarray, run: int = RUN, buckets: int = BUCKETS, limit: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each word, row of each feature, its bucket) of one part of the texts after the other."""
    for lo, offs, _, stop in c.parts(data, offsets, _RAW_SPACE, run - 1, limit):
        words = c.Words(data, offs, lower=True, space=_SPACE)
        size = words.end - words.start
        owned = words.start < stop - offs[0]
        joined = np.append(0, np.cumsum(size + 1))  # where each word starts when all are joined by one space
        text = np.full(joined[-1], 0x20, np.uint8)
        at, _ = c.spread(joined[:-1], size)
        text[at] = words.buf[words.solid]
        rows, found = [], []
        for n in range(1, run + 1):
            first = np.flatnonzero(owned[: len(size) - n + 1] & c.inside(words, n)) if len(size) >= n else np.zeros(0, np.int64)
            if len(first):
                found.append(crc32(text, joined[first], joined[first + n] - 1) % np.uint32(buckets))
                rows.append(words.row[first])
        if rows:
            yield lo + words.row[owned], lo + np.concatenate(rows), np.concatenate(found).astype(np.int64)


def bucket_counts(docs: DataFrame, text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """Columns bucket, n.  A task sends a row for each bucket it has met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in features(*c.utf8(batch.column(0)), run, buckets):
                total += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    return c.map_arrow(docs.select(text), count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Columns bucket, gain: a thousand times the log ratio of the target's share to the corpus's, one added to each count.  corpus, target: bucket_counts()."""
    none = F.lit(0).cast("long")
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), none.alias("s"), none.alias("t"))
    both = every.unionByName(corpus.select("bucket", F.col("n").alias("s"), none.alias("t"))).unionByName(target.select("bucket", none.alias("s"), F.col("n").alias("t")))
    every = Window.partitionBy()  # of `buckets` rows
    each = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).withColumns({"all_s": F.sum("s").over(every), "all_t": F.sum("t").over(every)})
    s, t, all_s, all_t = (F.col(x).cast("double") for x in ("s", "t", "all_s", "all_t"))
    ratio = ((t + 1) * (all_s + buckets)) / ((s + 1) * (all_t + buckets))
    return each.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def noise(key: str, seed: int = SEED) -> Column:
    """A thousand times Gumbel noise by the id, whole."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weights(docs: DataFrame, gain: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """Columns key, n_words, n_features, weight.  gain: gains(), of fixed size, collected and sent out."""
    table = np.zeros(buckets, np.int64)
    for r in gain.collect():
        table[r.bucket] = r.gain
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = c.utf8(batch.column(1))
            words, n, total = (np.zeros(len(offsets) - 1, np.int64) for _ in range(3))
            for owned, rows, found in features(data, offsets, run, buckets):
                words += np.bincount(owned, minlength=len(words))
                n += np.bincount(rows, minlength=len(n))
                total += np.bincount(rows, sent.value[found], len(total)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, n, total))], names=["key", "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    return c.map_arrow(docs.select(F.col(key), F.col(text)), weigh, f"key {kind}, n_words long, n_features long, weight long").withColumnRenamed("key", key)


def drawn(scored: DataFrame, key: str, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """scored (key, n_words, score, ...) with rank: 1, 2, 3 ... of the highest scores, equal ones by the smaller key, for `percent` of the rows with `least` words; null for others.

    Rows are dealt out in ranges of score and key; the ranges' counts, summed up, give each range its first rank."""
    scored = c.checkpointed(scored.withColumn("_row", F.monotonically_increasing_id()))  # the range partition reads it twice
    order = (F.desc("score"), F.asc_nulls_last(key), F.asc("_row"))
    enough = F.col("n_words") >= least
    dealt = c.checkpointed(scored.filter(enough).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select(F.col("_range").alias("_r"), (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"), F.floor(F.sum("_n").over(Window.partitionBy()) * percent / 100).alias("_take"))
    place = F.col("_start") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranked = dealt.join(F.broadcast(starts), F.col("_range") == F.col("_r")).withColumn("_at", place)  # starts: a row for each range
    ranked = ranked.withColumn("rank", F.when(F.col("_at") <= F.col("_take"), F.col("_at")).cast("long"))
    others = scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    columns = [x for x in scored.columns if x != "_row"] + ["rank"]
    return ranked.select(*columns).unionByName(others.select(*columns))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """Columns key, n_words, n_features, weight, score, rank.  target: texts in a column of the same name."""
    gain = gains(bucket_counts(docs, text, run, buckets), bucket_counts(target, text, run, buckets), buckets)
    out = weights(docs, gain, key, text, run, buckets).withColumn("score", F.col("weight") + noise(key, seed))
    return drawn(out, key, percent, least)


def op13_importance_sample(spark, sf_dir: str) -> DataFrame:
    out = resampled(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: Bytes of a text are those of its hex form; the CRC's table is made by its rule.  A feature's crc is a fold over its bytes.
OP13_SQL = r"""
WITH bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM range(256) r(i)),
tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM bits),
src AS (SELECT false AS target, doc_id, text FROM documents UNION ALL SELECT true, NULL, text FROM benchmark),
w AS (SELECT row_number() OVER () AS doc, target, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM src),
d AS MATERIALIZED (SELECT * FROM w),
e AS MATERIALIZED (SELECT doc, target, array_to_string(d.w[i : i + n - 1], ' ') AS feature FROM d, range(1, 4) r(n), range(1, len(d.w) - n + 2) t(i)),
u AS MATERIALIZED (SELECT DISTINCT feature FROM e),
h AS (SELECT feature, hex(encode(feature)) AS x FROM u),
k AS MATERIALIZED (SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, (len(x) // 2)::BIGINT), lambda j: ('0x' || x[2 * j + 1 : 2 * j + 2])::BIGINT)),
  lambda crc, b: xor(crc >> 8, tab[xor(crc & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM h, tab),
c AS (SELECT bucket, count(*) FILTER (WHERE NOT target) AS s, count(*) FILTER (WHERE target) AS t FROM e JOIN k USING (feature) GROUP BY bucket),
n AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM c),
g AS (SELECT bucket, floor(1000::DOUBLE * ln(((t + 1) * (all_s + 10000)) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM c, n),
f AS (SELECT doc, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM e JOIN k USING (feature) JOIN g USING (bucket) WHERE NOT target GROUP BY doc),
z AS (SELECT doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN f USING (doc) WHERE NOT target),
o AS (SELECT *, weight + floor(-1000::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM z),
r AS (SELECT *, n_words >= 20 AS enough, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS n FROM o)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN enough AND place <= 5 * n // 100 THEN place END::BIGINT AS rank FROM r
"""
