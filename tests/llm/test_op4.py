"""Operator 4: recall by its own relation, over all pairs, at each level of edit similarity."""

import numpy as np
import pytest

from verdure.llm import op4_omh

LEVELS = (0.80, 0.82, 0.85, 0.88, 0.90, 0.92, 0.95, 0.98)


def edited(rng, words, share):
    """words with round(share * len) edits at places of their own: mostly changed words, a few put in or left out."""
    out, many = list(words), round(share * len(words))
    for i in sorted(rng.choice(len(words), many, replace=False).tolist(), reverse=True):
        how = rng.integers(0, 10)
        out[i : i + 1] = [f"new{rng.integers(0, 10**6)}"] if how < 8 else [] if how == 8 else [out[i], f"new{rng.integers(0, 10**6)}"]
    return out


def test_recall_by_edit_similarity(spark):
    rng, docs, pairs = np.random.default_rng(3), [], []
    for level in LEVELS:
        for k in range(40):
            base = [f"v{x}" for x in rng.integers(0, 4000, int(rng.integers(80, 400)))]
            docs += [base, edited(rng, base, 1 - level)]
            pairs.append((level, len(docs) - 2, len(docs) - 1))
    got = {r.doc_id: r.class_id for r in op4_omh.near_classes(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()}
    number = {x: i + 2 for i, x in enumerate(sorted({x for w in docs for x in w}))}
    coded = [np.array([number[x] for x in w], np.uint64) for w in docs]
    most = [int(0.2 * max(len(docs[a]), len(docs[b])) + 1e-9) for _, a, b in pairs]
    true = op4_omh.edit_distances([coded[a] for _, a, _ in pairs], [coded[b] for *_, b in pairs], np.array(most)) <= np.array(most)
    found = np.array([got[a] == got[b] for _, a, b in pairs])
    levels = np.array([x for x, *_ in pairs])
    recall = {x: round(float(found[(levels == x) & true].mean()), 3) for x in LEVELS if ((levels == x) & true).any()}
    print("recall", recall)
    assert all(x >= 0.9 for x in recall.values()) and not (found & ~true).any()
    assert len({got[a] for _, a, _ in pairs}) == len(pairs)  # unrelated texts stay apart


@pytest.mark.parametrize("block", [3, op4_omh.BLOCK])
def test_torn_buckets_in_blocks(spark, monkeypatch, block):
    """Texts that share a long passage and little else: they meet in buckets, but only near ones are linked, whatever the blocks."""
    monkeypatch.setattr(op4_omh, "BLOCK", block)
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(100)]
    texts = []
    for _ in range(12):
        own = [f"o{x}" for x in rng.integers(0, 10**6, 60)]
        texts += [[*own, *passage], [*edited(rng, own, 0.1), *passage], [*passage, *own]]
    want = {}
    number = {x: i + 2 for i, x in enumerate(sorted({x for w in texts for x in w}))}
    coded = [np.array([number[x] for x in w], np.uint64) for w in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            most = int(0.2 * max(len(texts[i]), len(texts[j])) + 1e-9)
            if op4_omh.edit_distances([coded[i]], [coded[j]], np.array([most]))[0] <= most:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    want = dict(enumerate(label))
    got = {r.doc_id: r.class_id for r in op4_omh.near_classes(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == want


def test_links_of_a_torn_bucket_are_a_forest(spark):
    """Texts near to each other but to no common lead: what comes out grows with the texts, not with their pairs."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(120)]
    rows = [(bytes([i]) * 16, " ".join(edited(rng, base, 0.04))) for i in range(60)]
    texts = spark.createDataFrame(rows, "id binary, text string")
    buckets = texts.selectExpr("id AS rep", "7L AS sketch")
    labels = texts.selectExpr("id", "id AS label")
    got = op4_omh._torn_links(buckets, labels, texts, op4_omh.SIMILARITY).collect()
    assert len(got) == 59 and {x for r in got for x in (bytes(r.a), bytes(r.b))} == {i for i, _ in rows}
