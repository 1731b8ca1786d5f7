"""Importance resampling: the CRC against zlib, features and draws against a plain computation."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import DATA
from verdure.llm import common as c
from verdure.llm import op13_crc as r

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(texts):
    """(buckets of the features, number of words) of each text."""
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        out.append(([zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)))
    return out


def brute(rows, target):
    """Set of (doc_id, n_features, weight, score, rank)."""
    docs = plain([t for _, t in rows])
    s, t = Counter(x for f, _ in docs for x in f), Counter(x for f, _ in plain(target) for x in f)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for (key, _), (f, n) in zip(rows, docs, strict=True):
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    long = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0]))
    for i, x in enumerate(long[: 5 * len(long) // 100]):
        x[4] = i + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


@pytest.mark.parametrize("sizes", [range(1, 300), [1000, 1, 127, 128, 129, 256, 4097]])
def test_crc_is_zlibs(sizes):
    rng = np.random.default_rng(3)
    spans = [rng.integers(0, 256, n).astype(np.uint8) for n in sizes]
    buf, end = np.concatenate(spans), np.cumsum([len(x) for x in spans])
    assert r.crc32(buf, end - [len(x) for x in spans], end).tolist() == [zlib.crc32(x.tobytes()) for x in spans]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aZ9 .-é漢\n_"), max_size=50)), max_size=4), st.sampled_from([1, 7, 1 << 19]))
def test_features_of_any_part_size(texts, limit):
    got, words = [[] for _ in texts], [0] * len(texts)
    for owned, rows, found in r.features(*c.utf8(pa.array(texts, pa.string())), limit=limit):
        for i in owned:
            words[i] += 1
        for i, b in zip(rows, found, strict=True):
            got[i].append(int(b))
    assert [(sorted(x), n) for x, n in zip(got, words, strict=True)] == [(sorted(x), n) for x, n in plain(texts)]


def test_query_against_brute_force(spark):
    rows = [(x.doc_id, x.text) for x in c.table(spark, DATA, "documents").select("doc_id", "text").collect()]
    target = [x.text for x in c.table(spark, DATA, "benchmark").collect()]
    assert sorted(map(tuple, r.op13_importance_sample(spark, DATA).collect()), key=str) == brute(rows, target)


def test_edge_rows(spark):
    long = " ".join(f"Word{i % 7}" for i in range(30))
    rows = [(i % 50 if i % 9 else None, long if i % 3 else f"{long} {'x' * 3000} {i}", "s") for i in range(120)] + [(1, None, "s"), (2, "", None), (3, "...", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    target = spark.createDataFrame([(1, "word1 word2"), (2, None)], "item_id long, text string")
    got = r.resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank").collect()
    want = brute([x[:2] for x in rows], ["word1 word2", None])
    assert sorted(str(x[:4]) for x in map(tuple, got)) == sorted(str(x[:4]) for x in want)
    assert sorted((x[4], x[3]) for x in got if x[4]) == sorted((x[4], x[3]) for x in want if x[4])
    assert r.resampled(docs.limit(0), target).count() == 0
    empty = r.resampled(docs, target.limit(0)).select("doc_id", "weight").collect()
    assert sorted(map(str, map(tuple, empty))) == sorted(str((x[0], x[2])) for x in brute([x[:2] for x in rows], []))
