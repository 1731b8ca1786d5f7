"""Operator 1: scores against a plain forward pass in double precision, and what the passes learn from."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from verdure.llm import common, op1_hmm

SPLIT = re.compile(r"[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("known", [op1_hmm.KNOWN, 300])
def test_scores_against_a_plain_forward_pass(spark, monkeypatch, known):
    monkeypatch.setattr(op1_hmm, "KNOWN", known)
    monkeypatch.setattr(op1_hmm, "SYMBOLS", 100)
    monkeypatch.setattr(op1_hmm, "LONG", 50)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()] + [(1000, None), (1001, ""), (1001, ""), (None, "One two"), (1002, "Unheard-of words, here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    train = docs.filter(common.fold("doc_id") != 1).select("text")
    counts, v, model, passes = fitted = op1_hmm.fit(train)
    assert 2 <= len(passes) <= op1_hmm.PASSES and passes[-1] > passes[0]
    total = {}
    for r in train.collect():
        for x in SPLIT.findall((r.text or "").translate(LOW)):
            total[x] = total.get(x, 0) + 1
    lookup = common.Lookup(v.words)

    def plain(text):
        words = SPLIT.findall((text or "").translate(LOW))
        raw = [x.encode() for x in words]
        w = common.Words(np.frombuffer(b" ".join(raw), np.uint8), np.array([0, len(b" ".join(raw))], np.int64))
        symbols = [*v.symbols(w, lookup)[0].tolist(), v.size - 1]
        a, out = None, 0.0
        for i, s in enumerate(symbols):
            a = (model.begin if a is None else a @ model.move) * model.emit[s]
            out += math.log10(a.sum())
            a = a / a.sum()
            if v.heads <= s < v.size - 1:  # the word's share of its symbol
                out += math.log10((total.get(words[i], 0) + 0.5) / v.space) - math.log10(v.q[s])
        return out

    want = sorted(((i if i is not None else -1), plain(t)) for i, t in rows)
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.score) for r in op1_hmm.hmm_score(docs, fitted=fitted).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-9)
    assert np.allclose(model.emit.sum(0), 1) and counts.count() == len(total)


def test_all_training_texts_are_read_in_each_pass(spark):
    docs = spark.createDataFrame([(" ".join(f"w{(i * j) % 17}" for j in range(1, 6 * i)),) for i in range(1, 30)], "text string")
    _, v, model, _ = op1_hmm.fit(docs)
    codes = op1_hmm.coded(docs, spark.sparkContext.broadcast(v))
    emit, move, begin, _ = op1_hmm.expected_counts(codes, v.size, model)
    tokens = sum(6 * i for i in range(1, 30))
    assert emit.sum() == pytest.approx(tokens, rel=1e-4) and move.sum() == pytest.approx(tokens - 29, rel=1e-4) and begin.sum() == pytest.approx(29, rel=1e-4)
