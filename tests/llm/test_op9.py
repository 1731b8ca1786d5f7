"""Operator 9 against brute force: every passage of every document with every test item, scored in plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tests.conftest import DATA
from verdure.llm import op9_decontam

SPLIT = re.compile(r"[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PUNCT = "".join(chr(x) for x in [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])


def words(text):
    return [x.strip(PUNCT) or x[0] for x in SPLIT.findall((text or "").translate(LOW))]


def test_all_punctuation_at_the_ends_goes():
    texts = ["((([[[{{{<<<word>>>}}}]]])))", "\'\'\'a-b...\' ?!?! -- x", "", "é.. «q»", "!" * 5000 + "w" + "?" * 3000]
    for t in texts:
        data = t.encode()
        w, _ = op9_decontam.clean_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert [w.buf[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)] == words(t)


def overlap(part, passage):
    if not part:
        return 1.0
    k = min(5, len(part))
    mine = {tuple(part[i : i + k]) for i in range(len(part) - k + 1)}
    return len(mine & {tuple(passage[i : i + k]) for i in range(len(passage) - k + 1)}) / len(mine)


def nearest(part, passage):
    if sum(x in set(passage) for x in part) / len(part) < 0.8:
        return 0.0
    row = [0] * (len(passage) + 1)
    for i, x in enumerate(part, 1):
        new = [i]
        for j, y in enumerate(passage, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return 1 - min(row) / len(part)


def brute(docs, items):
    items = [(i, t, words(t)) for i, t in items if SPLIT.search(t or "")]
    df, mean = Counter(x for *_, w in items for x in set(w)), sum(len(w) for *_, w in items) / len(items)
    m = max(len(w) for *_, w in items)
    shares = []
    for _, _, w in items:
        s = {x: math.log1p((len(items) - df[x] + 0.5) / (df[x] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, n in Counter(w).items()}
        shares.append({x: v / sum(s.values()) for x, v in s.items()})
    out = {}
    for d, text in docs:
        every = words(text)
        for p in range(max(0, -(-len(every) // m) - 3) + 1):
            passage = every[p * m : (p + 3) * m]
            has = set(passage)
            for (i, t, w), share in zip(items, shares, strict=True):
                score = sum(v for x, v in share.items() if x in has)
                if score < 0.5:
                    continue
                cut = len(words(op9_decontam.split_item(t)[0]))
                halves, whole = [w[:cut], w[cut:]], overlap(w, passage)
                found = [overlap(x, passage) for x in halves]
                if whole < 0.8:
                    for k, x in enumerate(halves):
                        x = (w[-5:] if k else w[:5]) if 1 < len(x) < 5 else x
                        if found[k] < 0.8:
                            found[k] = max(found[k], nearest(x, passage))
                if min(found) >= 0.8 or whole >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), score)
    return out


@pytest.mark.parametrize("shard", [7, op9_decontam.SHARD])
def test_leaks_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(op9_decontam, "SHARD", shard)
    read = lambda n, *of: [tuple(r) for r in spark.read.parquet(f"{DATA}/{n}.parquet").select(*of).collect()]
    docs, items = read("documents", "doc_id", "text")[:120], read("benchmark", "item_id", "text")
    rng = np.random.default_rng(1)
    for k, (_, t) in enumerate(items[:12]):  # edits, repeated items, long texts and parts of items
        w = t.split()
        for e in range(k):
            w[int(rng.integers(0, len(w)))] = f"edit{e}"
        docs.append((10_000 + k, " ".join([*docs[k][1].split()[:300], *w, *docs[k + 1][1].split()[:900]])))
        docs.append((20_000 + k, " ".join(w[: len(w) * 2 // 3])))
    items += [(900, items[3][1]), (901, "One sentence only without an end"), (902, None), (903, "   ")]
    docs += [(30_000, "one sentence ONLY without an end"), (30_001, None), (30_002, "")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    got = {(r.doc_id, r.item_id): r.score for r in op9_decontam.leaks(*frames).collect()}
    assert got.keys() == want.keys() and len(want) > 10 and all(got[k] == pytest.approx(want[k]) for k in want)
    leaking = {d for d, _ in want}
    clash = frames[0].withColumnRenamed("doc_id", "_c1")
    free = op9_decontam.leak_free(clash, frames[1])
    assert free.columns == clash.columns and sorted(r._c1 for r in free.collect()) == sorted(d for d, _ in docs if d not in leaking)
