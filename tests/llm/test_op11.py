"""Phrase collocations: counts from the graph, compacted paths and results against plain counting."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import DATA
from verdure.llm import common as c
from verdure.llm import op11_phrases as o

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [w for p in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)) if (w := re.findall("[^ \t]+", p))]


def counted(rows):
    """{(lang, words): count} of all phrases of 1 to 4 words."""
    return Counter((lang or "und", tuple(w[i : i + k])) for lang, text in rows for w in pieces(text) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))


def brute(rows, least, top=2000):
    f = counted(rows)
    n = Counter()
    for (lang, w), x in f.items():
        n[lang] += x * (len(w) == 1)
    cand = {k: x for k, x in f.items() if len(k[1]) > 1 and x >= least}
    gone = {(lang, w[i : i + m]) for (lang, w), x in cand.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if 100 * x >= 80 * f[lang, w[i : i + m]]}
    out = []
    for (lang, w), a in cand.items():
        if (lang, w) not in gone:
            score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    result = []
    for lang in n:
        best = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        result += [(x[0], i + 1, *x[1:]) for i, x in enumerate(best)]
    return sorted(result)


def added_up(rows):
    """Counts of all phrases from edges and ends."""
    f, words = Counter(), Counter()
    for group, head, tail, size, is_open, n in rows:
        for g, h, t, m, o_, x in zip(map(int, group), head.to_pylist(), tail.to_pylist(), map(int, size), is_open, map(int, n), strict=True):
            if not m:
                words[g] += x
                continue
            w = h.split(" ")
            assert len(w) == m
            if t is not None:  # an edge: itself, and the parts that begin with it
                f[g, (*w, t)] += x
            for k in range(1, m + 1):
                for i in range(1 if t is not None else m - k + 1):
                    f[g, tuple(w[i : i + k])] += x * (not (o_ and k == 1 and i == m - 1))
    return f, words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbc  \té.\n,"), max_size=60)), max_size=4), st.sampled_from([1, 9, 40, 1 << 20]))
def test_edges_and_ends_give_all_counts(texts, limit):
    data, offsets = c.utf8(pa.array(texts, pa.string()))
    parts = o.of_parts(data, offsets, np.arange(len(texts)), np.arange(len(texts), dtype=np.uint64), [], limit)
    f, words = added_up(o.grams(parts, []))
    assert f == Counter((i, k[1]) for i, t in enumerate(texts) for k, x in counted([("x", t)]).items() for _ in range(x))
    assert words == Counter(i for i, t in enumerate(texts) for p in pieces(t) for _ in p)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAb  é.c"), max_size=80), max_size=4), st.sampled_from([1, 9, 1 << 20]), st.integers(1, 5))
def test_what_is_left_out_changes_no_frequent_count(texts, limit, least):
    data, offsets = c.utf8(pa.array(texts, pa.string()))
    parts = lambda kept: o.of_parts(data, offsets, np.zeros(len(texts), int), np.zeros(1, np.uint64), kept, limit)
    kept = []
    for what in (o.Part.words_and_pairs, o.Part.runs_of_three):
        met, n = np.unique(np.concatenate([*(what(p) for p in parts(kept)), np.zeros(0, np.int32)]), return_counts=True)
        frequent = np.zeros(1 << (o.BITS - 3), np.uint8)
        np.bitwise_or.at(frequent, met[n >= least] >> 3, (1 << (met[n >= least] & 7)).astype(np.uint8))
        kept = [*kept, frequent]
    f, _ = added_up(o.grams(parts(kept), kept))
    want = {k[1]: x for k, x in counted([("x", t) for t in texts]).items() if x >= least}
    assert {k[1]: x for k, x in f.items() if x >= least} == want


def test_paths(spark):
    straight = [f"w{i}" for i in range(40)]
    texts = [" ".join(straight)] * 3 + ["b c a b c a b c a b c a b c a b c"] * 3 + ["p q r s t. x q r s u. p q r s t"] * 2
    docs = spark.createDataFrame([("l", t) for t in texts], "lang string, text string")
    for row in (256, 7):
        rows = o.paths(o.counts(o.edges(docs), 2), row).collect()
        found = sorted((*r.words[i : i + 4], r.w[i]) for r in rows for i in range(len(r.w)))
        assert found == sorted((*k[1], x) for k, x in counted([("l", t) for t in texts]).items() if len(k[1]) == 4 and x >= 2)  # every edge once
        assert max(len(r.w) for r in rows) == min(37, row)
        f = counted([("l", t) for t in texts])
        assert all(r.f[i] == f["l", tuple(r.words[i : i + 3])] for r in rows for i in range(len(r.w)))
    cycle = [r for r in rows if "a" in r.words]
    assert [(r.words, r.last) for r in cycle] == [(["a", "b", "c", "a", "b", "c"], "a b c")]  # it begins at its least edge


def test_results_against_plain_counting(spark):
    rows = [(x.lang, x.text) for x in c.table(spark, DATA, "documents").collect()] + [(None, "one two three four"), ("und", "One two three. four"), ("x", None), ("x", "")] * 5
    docs = spark.createDataFrame(rows, "lang string, text string")
    for least, top, limit in ((10, 2000, o.CHUNK), (30, 50, 3000)):
        assert sorted(map(tuple, o.collocations(docs, least=least, top=top, limit=limit).collect())) == brute(rows, least, top)


def test_query(spark):
    rows = [(x.lang, x.text) for x in c.table(spark, DATA, "documents").collect()]
    assert sorted(map(tuple, o.op11_phrase_collocations(spark, DATA).collect())) == brute(rows, 30)


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts of 10**15: 2,000,000 times one is beyond a long."""
    docs = spark.createDataFrame([("l", "a b. a c")] * 3, "lang string, text string")
    huge = 10**15
    real = o.counts
    monkeypatch.setattr(o, "counts", lambda e, n: real(e, n).withColumn("f", o.F.col("f") * huge))
    got = sorted(map(tuple, o.collocations(docs, least=3).collect()))
    assert got == [("l", 1, "a b", 3 * huge, 6 * huge, 3 * huge, 12 * huge, 2_000_000 * 3 // 9), ("l", 2, "a c", 3 * huge, 6 * huge, 3 * huge, 12 * huge, 2_000_000 * 3 // 9)]


@pytest.mark.parametrize("columns", ["lang string, text string, phrase string, f long"])
def test_edge_rows(spark, columns):
    docs = spark.createDataFrame([("l", "a b", "x", 1)] * 40 + [(None, None, None, None)], columns)
    assert list(map(tuple, o.collocations(docs).collect())) == [("l", 1, "a b", 40, 40, 40, 80, 1_000_000)]
    assert o.collocations(docs.limit(0)).count() == 0
