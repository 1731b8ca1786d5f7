"""Operator 11, phrase collocations from a weighted de Bruijn graph.

Texts are split into pieces and words.  A node is a run of three words, an edge a run of four: it leads from its first three words to
its last three and weighs as often as it occurs.  A task counts the edges of its texts and the ends of its pieces (their last
three words, or all of a shorter piece) batch by batch, so a frequent edge is one row a batch, and Spark adds them up by node: one shuffle of
edges.  Two passes before that add up words and pairs, then runs of three words whose
pairs are left, in 2**27 buckets by their hash. What lies in a bucket below the least count is in no candidate: pieces are cut at such pairs, a node that
isn't followed by another one ends there (an open end: it counts for its pair, not for its last word, which the next run counts), and rare words that stand alone are left out. That changes no
count of a candidate or of its parts, and spares the shuffle all that can't matter; what shares a bucket only costs time.
The buckets go out as bitmaps of 16 MB, however large the corpus. All shorter counts follow without another look at the text: a node occurs as often as its edges leave it plus as often as a
piece ends with it; a pair as often as nodes begin with it plus pieces end with it; a word likewise.

Edges that occur often enough (only they and their parts can be candidates, as no part is rarer than its whole) make the graph that is
compacted: where a node has one such edge in and one out, both belong to one path.  Pointer doubling finds each edge's place in its path in
log2(length) rounds, a cycle begins at its least edge, and a path becomes rows of at most ROW edges: words, weights, node counts.
The four-word candidates, the counts of their three-word parts and what they contain come from these rows; the other parts' counts
are joined from the frequent counts.  Then a candidate's lowest-scoring cut, what longer candidates cover, and each lang's best by a
top-k that every task applies before the shuffle.

Long texts are handled in parts that share three words.  Counts are exact; products are decimals of 38 digits.

Edge cases: null and empty texts have no pieces; null lang is `und`, also beside rows that say `und`; repeated rows count as often as they occur; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

LEAST, COVER, SCALE, TOP, ROW, CHUNK = 30, 80, 2_000_000, 2000, 256, 2 << 20
BITS, SLICE = 27, 15

_ENDS, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SPACE[[0x20, 0x09]] = True
_SPACE |= _ENDS


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first of each different key, how many there are)."""
    _, first, n = np.unique(keys, return_index=True, return_counts=True)
    return first, n


class Part:
    """The words of a part of some texts: where pieces begin, what the part owns, and the buckets of words, pairs and runs of three.  group: a small number for each text, salt: a hash for each group.
    kept: bitmaps of frequent buckets of words and pairs, and of runs of three; without one all are kept."""

    def __init__(self, data: np.ndarray, lo: int, offs: np.ndarray, since: int, stop: int, group: np.ndarray, salt: np.ndarray, kept: list[np.ndarray]):
        self.words = words = c.Words(data, offs, lower=True, space=_SPACE)
        self.n = n = len(words.start)
        if not n:
            return
        passed = np.append(0, np.cumsum(_ENDS[words.buf]))
        self.new = np.ones(n, bool)
        self.new[1:] = (passed[words.start[1:]] != passed[words.start[:-1]]) | (words.row[1:] != words.row[:-1])
        self.owned = (words.start >= since - offs[0]) & (words.start < stop - offs[0])
        self.group = group[lo + words.row]
        hashes = words.hashes()
        self.alone = buckets(c.mix(hashes + salt[self.group]))
        pairs = c.mix(hashes[:-1] * c._M3 + hashes[1:] + salt[self.group[:-1]])
        self.pairs = buckets(pairs)
        if kept:
            self.new[1:] |= ~among(kept[0], self.pairs)
        self.three = np.zeros(n, bool)  # a run of three begins here
        self.three[: n - 2] = ~self.new[1 : n - 1] & ~self.new[2:]
        self.triples = buckets(c.mix(pairs[:-1] * c._M3 + hashes[2:]))
        if len(kept) > 1:
            self.three[: n - 2] &= among(kept[1], self.triples)

    def words_and_pairs(self) -> np.ndarray:
        """The buckets of the words it owns and of the pairs that begin with one."""
        return np.concatenate([self.alone[self.owned], self.pairs[self.owned[:-1] & ~self.new[1:]]])

    def runs_of_three(self) -> np.ndarray:
        return self.triples[(self.owned & self.three)[: len(self.triples)]]


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int32)


def among(bitmap: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (bitmap[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1


def of_parts(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, salt: np.ndarray, kept: list[np.ndarray], limit: int) -> Iterator[Part]:
    for lo, offs, since, stop in c.parts(data, offsets, _SPACE, 3, limit, behind=True):
        part = Part(data, lo, offs, since, stop, group, salt, kept)
        if part.n:
            yield part


def grams(parts: Iterator[Part], kept: list[np.ndarray]) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, head, tail, words in head, open, count) of each part: edges; ends, without a tail; and without a head all words."""
    for part in parts:
        words, n, new, of, three = part.words, part.n, part.new, part.group, part.three
        begin = np.append(np.flatnonzero(new), n)
        left = np.minimum(begin[np.searchsorted(begin, np.arange(n), "right")] - np.arange(n), 4)  # words from here to the end of the piece
        size = words.end - words.start
        joined = np.append(0, np.cumsum(size + 1))
        text = np.full(joined[-1], 0x20, np.uint8)
        at, _ = c.spread(joined[:-1], size)
        text[at] = words.buf[words.solid]
        word = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.append(0, np.cumsum(size))), pa.py_buffer(text[at])]).dictionary_encode()
        one = np.unique(of.astype(np.uint64) << np.uint64(32) | word.indices.to_numpy().astype(np.uint64), return_inverse=True)[1].astype(np.uint64)
        next_three, last_three = np.append(three[1:], False), np.append(False, three[:-1])
        alone = new & (left == 1)
        if kept:
            alone &= among(kept[0], part.alone)
        emitted = ((4, three & next_three, False), (3, three & ~next_three & (left == 3), False), (3, three & ~next_three & (left > 3), True), (2, ~three & ~(last_three & ~new) & (left == 2), False), (2, ~three & ~(last_three & ~new) & (left > 2), True), (1, alone, False))
        for k, which, is_open in emitted:
            here = np.flatnonzero(which & part.owned)
            if not len(here):
                continue
            key = one[here]
            for j in range(1, k):  # exact: a number for each different run so far, then the next word
                key = np.unique(key, return_inverse=True)[1].astype(np.uint64) << np.uint64(32) | one[here + j]
            first, count = _counted(key)
            i, m = here[first], min(k, 3)
            tail = c.strings(text, joined[i + 3], joined[i + 4] - 1) if k == 4 else pa.nulls(len(i), pa.string())
            yield of[i], c.strings(text, joined[i], joined[i + m] - 1), tail, np.full(len(i), m, np.int8), np.full(len(i), is_open), count
        first, count = _counted(of[part.owned])
        yield of[part.owned][first], pa.array([""] * len(first)), pa.nulls(len(first), pa.string()), np.zeros(len(first), np.int8), np.zeros(len(first), bool), count


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text))


def _parts(batch: pa.RecordBatch, kept: list[np.ndarray], limit: int) -> tuple[pa.Array, Iterator[Part]]:
    langs = batch.column(0).dictionary_encode()
    names, ends = c.utf8(langs.dictionary)
    return langs.dictionary, of_parts(*c.utf8(batch.column(1)), langs.indices.to_numpy(), c.byte_hashes(names, ends[:-1], ends[1:]), kept, limit)


def frequent_buckets(docs: DataFrame, what, kept: list[np.ndarray], text: str = "text", lang: str = "lang", least: int = LEAST, limit: int = CHUNK) -> np.ndarray:
    """A bitmap of the buckets (what: of a Part) that occur `least` times or more: 2**BITS bits, put together from slices that tasks pack."""
    sent = docs.sparkSession.sparkContext.broadcast(kept)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, sent.value, limit)[1]:
                met, n = np.unique(what(part), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n)], names=["bucket", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                bits = np.zeros(1 << SLICE, np.uint8)
                bits[x.values.to_numpy()] = 1
                out.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["slice", "bits"])

    met = c.map_arrow(_texts(docs, text, lang), count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    slices = met.groupBy(F.shiftright("bucket", SLICE).alias("slice")).agg(F.collect_list(F.col("bucket").bitwiseAND((1 << SLICE) - 1)).alias("at"))  # at most 2**SLICE
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in c.map_arrow(slices, pack, "slice int, bits binary").collect():
        out[r.slice << (SLICE - 3) : (r.slice + 1) << (SLICE - 3)] = np.frombuffer(r.bits, np.uint8)
    return out


def edges(docs: DataFrame, text: str = "text", lang: str = "lang", kept: list[np.ndarray] | None = None, limit: int = CHUNK) -> DataFrame:
    """Columns lang, head, size, tail, open, w: edges (three words, the fourth); ends, without a tail; and, with an empty head of size 0, all words.  Added up."""
    sent = docs.sparkSession.sparkContext.broadcast(kept or [])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, parts = _parts(batch, sent.value, limit)
            for group, head, tail, size, is_open, n in grams(parts, sent.value):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(group)), head, pa.array(size), tail, pa.array(is_open), pa.array(n)], names=["lang", "head", "size", "tail", "open", "w"])

    met = c.map_arrow(_texts(docs, text, lang), count, "lang string, head string, size byte, tail string, open boolean, w long")
    return met.groupBy("lang", "head", "size", "tail", "open").agg(F.sum("w").alias("w"))


def counts(edge: DataFrame, least: int = LEAST) -> DataFrame:
    """Columns lang, k, phrase, f of all phrases of 1 to 4 words with f >= least, and for each lang a row k = 0 with the number of its words.  edge: edges()."""
    is_edge, none = F.col("tail").isNotNull(), F.lit(0).cast("long")
    four = edge.filter(is_edge & (F.col("w") >= least)).select("lang", F.lit(4).alias("k"), F.concat_ws(" ", "head", "tail").alias("phrase"), F.col("w").alias("f"))
    total = lambda where, name: F.sum(F.when(where, F.col("w")).otherwise(none)).alias(name)
    node = edge.groupBy("lang", "head", "size").agg(F.sum("w").alias("f"), total(~is_edge, "ends"), total(~is_edge & ~F.col("open"), "closed"))
    node = c.checkpointed(node.select("lang", "size", F.col("head").alias("phrase"), "f", F.when(F.col("size") == 3, F.col("ends")).otherwise(F.col("closed")).alias("ends"), "closed"))

    def shorter(of: DataFrame, k: int, short: DataFrame) -> DataFrame:
        """Counts of k words from those of k + 1: by their first k words, and at ends by their last k; short: ends of k words. ends: what counts for the last words, closed: what counts for those of the next step too."""
        part = lambda phrase, f, ends: F.struct(phrase.alias("phrase"), f.alias("f"), ends.alias("ends"), ends.alias("closed"))
        both = F.array(part(F.substring_index("phrase", " ", k), F.col("f"), none), part(F.substring_index("phrase", " ", -k), F.col("ends"), F.col("closed")))
        rows = of.select("lang", F.explode(F.filter(both, lambda x: x["f"] > 0)).alias("x")).select("lang", "x.*")
        return rows.unionByName(short).groupBy("lang", "phrase").agg(F.sum("f").alias("f"), F.sum("ends").alias("ends"), F.sum("closed").alias("closed"))

    sized = lambda k: node.filter(F.col("size") == k).drop("size")
    three = sized(3)
    two = shorter(three, 2, sized(2))
    one = shorter(two, 1, sized(1))
    of = lambda x, k: x.select("lang", F.lit(k).alias("k"), "phrase", "f")
    all_ = of(sized(0), 0)
    return four.unionByName(of(three, 3)).unionByName(of(two, 2)).unionByName(of(one, 1)).filter(F.col("f") >= least).unionByName(all_)


def paths(count: DataFrame, row: int = ROW) -> DataFrame:
    """Columns lang, words, w, f, last: the unary paths of the graph of frequent edges, in rows of at most `row` edges.  words: from the first edge's to the last's; w: of each edge;
    f: of the node that each edge leaves; last: the node that the last edge reaches."""
    spark = count.sparkSession
    four = count.filter("k = 4").select("lang", "phrase", F.col("f").alias("w"), F.substring_index("phrase", " ", 3).alias("src"), F.substring_index("phrase", " ", -3).alias("dst"))
    node = count.filter("k = 3").select("lang", F.col("phrase").alias("src"), F.col("f"))
    out = four.groupBy("lang", "src").agg(F.count("*").alias("outs"))
    into = four.groupBy("lang", F.col("dst").alias("src")).agg(F.count("*").alias("ins"), F.max("phrase").alias("before"))
    unary = out.filter("outs = 1").join(into.filter("ins = 1"), ["lang", "src"]).select("lang", "src", "before")
    first = four.join(node, ["lang", "src"]).join(unary, ["lang", "src"], "left")  # every node of a frequent edge is frequent
    first = c.checkpointed(first.select("lang", "phrase", "w", "f", "dst", F.coalesce("before", "phrase").alias("ptr"), F.col("before").isNotNull().cast("long").alias("dist")))
    # ptr: the edge `dist` places before, or the first one; least, back: the least edge on the way there and its place
    state, open_before = first.select("lang", "phrase", "ptr", "dist", F.col("phrase").alias("least"), F.lit(0).cast("long").alias("back")), -1
    while True:
        to = state.select("lang", F.col("phrase").alias("ptr"), *(F.col(x).alias(f"_{x}") for x in ("ptr", "dist", "least", "back")))
        lower, on = F.col("_least") < F.col("least"), F.col("_dist") > 0  # on: ptr isn't a first edge
        state = c.checkpointed(state.join(to, ["lang", "ptr"]).select(
            "lang", "phrase", F.col("_ptr").alias("ptr"), (F.col("dist") + F.col("_dist")).alias("dist"), F.least("least", "_least").alias("least"),
            F.when(lower, F.col("dist") + F.col("_back")).otherwise(F.col("back")).alias("back"), on.alias("on"), (on & lower).alias("lower"),
        ))
        open_, lowered = state.agg(F.count_if("on"), F.count_if("lower")).first()
        if not open_ or open_ == open_before and not lowered:  # fewer of a path's edges are open each round, so what stays goes round
            break
        open_before, state = open_, state.drop("on", "lower")
    place = F.when(F.col("on"), F.struct(F.col("least").alias("head"), F.col("back").alias("at"))).otherwise(F.struct(F.col("ptr").alias("head"), F.col("dist").alias("at")))
    placed = first.join(state.select("lang", "phrase", place.alias("p")), ["lang", "phrase"])
    each = F.sort_array(F.collect_list(F.struct(F.col("p.at").alias("at"), "phrase", "w", "f", "dst")))
    rows = placed.groupBy("lang", F.col("p.head").alias("head"), F.floor(F.col("p.at") / row).alias("part")).agg(each.alias("e"))
    words = F.concat(F.slice(F.split(F.get("e.phrase", F.lit(0)), " "), 1, 3), F.transform("e.phrase", lambda x: F.substring_index(x, " ", -1)))
    return rows.select("lang", words.alias("words"), F.col("e.w").alias("w"), F.col("e.f").alias("f"), F.element_at("e.dst", -1).alias("last"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, cover: int = COVER, top: int = TOP, limit: int = CHUNK) -> DataFrame:
    """Columns lang, rank, phrase, a, l, r, n, score: each lang's `top` phrases of 2 to 4 words with a count of `least`, that no longer one covers for `cover` per cent."""
    kept: list[np.ndarray] = []
    for what in (Part.words_and_pairs, Part.runs_of_three):
        kept = [*kept, frequent_buckets(docs, what, kept, text, lang, least, limit)]
    count = c.checkpointed(counts(c.checkpointed(edges(docs, text, lang, kept, limit)), least))
    path = c.checkpointed(paths(count))
    # every fact of a candidate is a row (slot, f): 0 its count, 2k-1 and 2k the parts of the cut after k words, 7 a longer candidate's count
    known = lambda slot, f: F.struct(F.lit(slot).alias("slot"), f.alias("f"), F.lit(None).cast("string").alias("part"))
    asked = lambda slot, part: F.struct(F.lit(slot).alias("slot"), F.lit(None).cast("long").alias("f"), part.alias("part"))
    i = F.col("i")
    words = lambda at, n: F.array_join(F.slice("words", (at + 1).cast("int"), n), " ")
    after = F.get("f", i + 1)
    edge = path.select("*", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i")).select(
        "lang", words(i, 4).alias("phrase"), F.get("w", i).alias("a"),
        F.array(asked(1, words(i, 1)), F.when(after.isNotNull(), known(2, after)).otherwise(asked(2, F.col("last"))), asked(3, words(i, 2)), asked(4, words(i + 2, 2)), known(5, F.get("f", i)), asked(6, words(i + 3, 1))).alias("facts"),
        F.array(*(words(i + j, n) for n, j in ((3, 0), (3, 1), (2, 0), (2, 1), (2, 2)))).alias("inside"),
    )
    some = count.filter("k IN (2, 3)").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    three, zero = F.col("k") == 3, F.lit(0)
    of_two = F.array(asked(1, words(zero, 1)), asked(2, words(zero + 1, 1)))
    of_three = F.array(asked(1, words(zero, 1)), asked(2, words(zero + 1, 2)), asked(3, words(zero, 2)), asked(4, words(zero + 2, 1)))
    shorter = some.select("lang", "phrase", "a", F.when(three, of_three).otherwise(of_two).alias("facts"), F.when(three, F.array(words(zero, 2), words(zero + 1, 2))).otherwise(F.array().cast("array<string>")).alias("inside"))
    every = edge.unionByName(shorter)
    own = every.select("lang", "phrase", F.explode(F.concat(F.array(known(0, F.col("a"))), "facts")).alias("x")).select("lang", "phrase", "x.*")
    longer = every.select("lang", F.explode("inside").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("f")).select("lang", "phrase", F.lit(7).alias("slot"), "f")
    found = own.filter("part IS NOT NULL").drop("f").join(count.filter("k > 0").select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    facts = own.filter("part IS NULL").drop("part").unionByName(found.drop("part")).unionByName(longer)
    one = facts.groupBy("lang", "phrase").agg(*(F.max(F.when(F.col("slot") == s, F.col("f"))).alias(f"s{s}") for s in range(8)))
    exact = lambda x: F.col(x).cast("decimal(20,0)")
    one = one.filter(F.col("s7").isNull() | (exact("s7") * 100 < exact("s0") * cover))
    cut = lambda k: F.struct(F.expr(f"CAST(s0 AS DECIMAL(20,0)) * {SCALE} DIV (CAST(s{2 * k - 1} AS DECIMAL(20,0)) + s{2 * k})").alias("score"), F.lit(k).alias("k"), F.col(f"s{2 * k - 1}").alias("l"), F.col(f"s{2 * k}").alias("r"))
    one = one.withColumn("cut", F.array_min(F.array(*(F.when(F.col(f"s{2 * k}").isNotNull(), cut(k)) for k in (1, 2, 3)))))
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("s0"), "phrase")
    one = one.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    n = count.filter("k = 0").select("lang", F.col("f").alias("n"))
    return one.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("s0").alias("a"), "cut.l", "cut.r", "n", "cut.score")


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(c.table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS MATERIALIZED (SELECT lang, w FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p) WHERE len(w) > 0),
f AS MATERIALIZED (SELECT lang, k, array_to_string(w.w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM w, range(1, 5) r(k), range(1, len(w.w) - k + 2) s(i) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
inside AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM c, range(2, 4) r(m), range(1, k - m + 2) s(i) WHERE m < k GROUP BY ALL),
cuts AS (SELECT c.lang, c.phrase, c.a, j, l.f AS l, r.f AS r, (2000000::HUGEINT * a // (l.f + r.f))::BIGINT AS score FROM c, range(1, 4) x(j)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1 : c.k], ' ') WHERE j < c.k),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM cuts),
kept AS (SELECT low.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low LEFT JOIN inside USING (lang, phrase) WHERE place = 1 AND (longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a))
SELECT lang, rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) WHERE rank <= 2000
"""
