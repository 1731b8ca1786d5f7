"""Operator 2: the parse against brute force, factors against the texts they point to, and both ways of each join."""

import hashlib
import re

import numpy as np
import pytest

from tests.conftest import DATA
from verdure.llm import op2_rlz

SPLIT = re.compile(r"[^\x20\x09-\x0d]+")
A, B = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
MADE = [
    (100_001, [*A[1:14], "zz", *A[:13]]), (100_002, A[:14]), (100_003, A), (100_004, B), (100_005, [*A[:40], *B[5:30], "x", *A[3:20]]), (100_006, A), (100_007, [*B[40:], *A[30:45], *B[:13]]),
    (100_008, A[20:32]), (100_009, []), (100_010, ["r"] * 200), (100_011, ["r"] * 90), (100_012, [*A, *A]), (100_003, [*B, "other", *A[:20]]),
]


def brute(docs):
    """{(id, words): (removed, kept)} by looking every window up."""
    first = {}
    for i, w in docs:
        for j in range(len(w) - 12) if i is not None else ():
            k = tuple(w[j : j + 13])
            first[k] = min(first.get(k, i), i)
    for i, w in docs:
        gone = [False] * len(w)
        for j in range(len(w) - 12) if i is not None else ():
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        yield (i, tuple(w)), (sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))


@pytest.fixture(scope="module")
def docs(spark):
    given = [(r.doc_id, SPLIT.findall(r.text or "")) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    return [*given, *MADE, (None, A), (None, B[:30]), (100_005, MADE[4][1])]


@pytest.mark.parametrize("bound", [None, 0])
def test_parse_against_brute_force(spark, docs, monkeypatch, bound):
    if bound is not None:
        monkeypatch.setattr(op2_rlz, "MAPPED", bound)
        monkeypatch.setattr(op2_rlz, "WHOLE", bound)
    want = dict(brute(docs))
    texts = {}
    for i, w in docs:
        texts.setdefault(i, []).append(w)
    frame = spark.createDataFrame([(i, "\n" + "  ".join(w) + " ") for i, w in docs], "doc_id long, text string")
    got = op2_rlz.deduplicated(frame).collect()
    assert len(got) == len(docs)
    left = {k: 0 for k in want}
    for r in got:
        mine = [w for w in texts[r.doc_id] if len(w) == r.n_words and want[r.doc_id, tuple(w)] == (r.n_removed, r.kept)]
        assert mine and r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest()
        left[r.doc_id, tuple(mine[0])] += 1
        end = 0
        for f in r.factors:
            assert f.length >= 13 and f.start >= end and f.source < r.doc_id
            end = f.start + f.length
            words = mine[0][f.start : end]
            assert any(s[f.source_at : f.source_at + f.length] == words for s in texts[f.source])
        covered = {x for f in r.factors for x in range(f.start, f.start + f.length)}
        assert len(covered) <= r.n_removed and (not covered) == (not r.n_removed)
    assert all(left.values())


def test_factors_go_on_in_one_block(spark):
    """A factor never joins two places of its source; a whole copy is one factor, however many copies there are."""
    docs = [(1, [*A[1:14], "zz", *A[:13]]), (2, A[:14]), (3, [*A, "end"]), (4, [*A, "end"]), (5, ["x", *A[:30], "y"])]
    got = {r.doc_id: [tuple(f) for f in r.factors] for r in op2_rlz.deduplicated(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"), texts=False).collect()}
    assert got == {1: [], 2: [(0, 13, 1, 14)], 3: [(0, 13, 1, 14)], 4: [(0, 61, 3, 0)], 5: [(1, 13, 1, 14), (14, 17, 3, 13)]}


def marked(at, n, size):
    """The words that one document's parse removes."""
    which, begin, low, high = op2_rlz.greedy(np.array(at), np.array(n))
    end = [at[i] + n[i] - 1 + op2_rlz.LENGTH for i in which]
    return {x for a, b in [*zip(begin, end, strict=True), *zip(low, high, strict=True)] for x in range(a, min(b, size))}, list(zip(begin.tolist(), end, strict=True)), list(zip(low.tolist(), high.tolist(), strict=True))


def test_factors_and_windows_across_their_ends():
    """Runs of known windows: 0-4 in one block, 6-9 in another, all of which begin in the first factor; 15-20 begin in it and behind it; 40 stands alone."""
    words, factors, border = marked([0, 6, 15, 40], [5, 4, 6, 1], 60)
    assert factors == [(0, 17), (17, 33), (40, 53)]
    assert border == [(6, 22), (15, 29)]
    assert words == {*range(33), *range(40, 53)}


def test_random_runs_against_plain_marks():
    """Factors don't overlap, are as long as their run goes on, and with the windows at their ends cover the words of all known windows."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        known = np.flatnonzero(rng.random(120) < rng.choice([0.05, 0.5, 0.95]))
        cut = np.flatnonzero(np.append(True, (np.diff(known) > 1) | (rng.random(max(0, len(known) - 1)) < 0.2))[: len(known)])
        at, n = known[cut], np.diff(np.append(cut, len(known)))
        words, factors, border = marked(at, n, 132)
        assert words == {x for k in known for x in range(k, k + 13)}
        assert all(a[1] <= b[0] for a, b in zip(factors, factors[1:], strict=False)) and all(b - a >= 13 for a, b in factors)
        assert all(any(f[0] <= a < f[1] < b for f in factors) for a, b in border if b > max((f[1] for f in factors if f[0] <= a), default=0))


@pytest.mark.parametrize(("off", "want"), [("", {1: 0, 2: 0, 3: 31}), ("factors", {1: 0, 2: 0, 3: 0}), ("border", {1: 0, 2: 0, 3: 21})])
def test_the_parse_decides(spark, monkeypatch, off, want):
    """Document 3 is one factor of document 1; the rest of it is found by windows that begin in the factor and go on in document 2."""
    parse, nothing = op2_rlz.greedy, np.zeros(0, np.int64)
    frame = spark.createDataFrame([(1, " ".join(A[:21])), (2, " ".join(A[10:31])), (3, " ".join(A[:31]))], "doc_id long, text string")
    if off:
        monkeypatch.setattr(op2_rlz, "greedy", lambda at, n: (nothing,) * 4 if off == "factors" else (*parse(at, n)[:2], nothing, nothing))
    assert {r.doc_id: r.n_removed for r in op2_rlz.deduplicated(frame, texts=False).select("doc_id", "n_removed").collect()} == want
