"""Each stage of the pipeline against brute force on its own input, with nulls, repeated rows and clashing names."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from tests.conftest import DATA
from verdure.llm import common, op3_pii, op4_omh, op8_curriculum

from .test_op9 import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(80).collect()]
    base = given[5][1]
    more = [(1, base + " tail", "en", "s", 1), (1, "another text under id one " * 3, "en", "s", 1), (None, "no id but words " * 5, "en", None, 1), (None, "no id but words " * 5, "en", None, 1), (None, "a quite other text without id", None, "t", None), (7000, None, "en", "s", 0), (7001, "", "en", "s", 0), (7001, "", "en", "s", 0)]
    return given + more


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame(docs, SCHEMA)


def test_quality_stage(spark, frame, docs):
    from verdure.llm.op10_crf import quality_scores

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    want = Counter(tuple(r)[:5] for r in quality_scores(frame, labels).collect() if r.predicted == 1)
    assert rows_of(p.quality(spark, frame, DATA)) == want
    clash = frame.withColumn("score", F.lit(1)).withColumn("_c0", F.lit(2))
    assert p.quality(spark, clash, DATA).columns == clash.columns


def test_near_duplicates_stage(spark, frame, docs):
    words = [tuple(re.findall(r"[^\x20\x09-\x0d]+", r[1] or "")) for r in docs]
    number = {x: i + 2 for i, x in enumerate(sorted({x for w in words for x in w}))}
    coded = [np.array([number[x] for x in w], np.uint64) for w in words]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            a, b = len(words[i]), len(words[j])
            most = int(0.2 * max(a, b) + 1e-9)
            if a and b and label[i] != label[j] and abs(a - b) <= most and op4_omh.edit_distances([coded[i]], [coded[j]], np.array([most]))[0] <= most:
                x, y = sorted((label[i], label[j]))
                label = [x if k == y else k for k in label]
    want = set()
    for k in set(label):  # texts without a word are known by their ids
        mine = [i for i in range(len(docs)) if label[i] == k]
        least = min(mine, key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
        want.add((docs[least][0], words[least]))
    got = Counter((r.doc_id, tuple(re.findall(r"[^\x20\x09-\x0d]+", r.text or ""))) for r in p.near_duplicates(spark, frame, DATA).collect())
    # A class may be split by a pair that met in no sketch: none here.
    assert set(got) - {(1, w) for w in words} == want - {(1, w) for w in words} and max(got.values()) == 1
    clash = frame.withColumn("_id", F.lit(1)).withColumn("_row", F.lit(2)).withColumn("node", F.lit(3))
    out = p.near_duplicates(spark, clash, DATA)
    assert out.columns == clash.columns and out.count() == sum(got.values())


def test_leak_stage(spark, frame, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaking = {d for d, _ in brute([(i, r[1]) for i, r in enumerate(docs)], items)}
    assert rows_of(p.benchmark_leaks(spark, frame, DATA)) == Counter(r for i, r in enumerate(docs) if i not in leaking)
    assert p.benchmark_leaks(spark, frame.limit(0), DATA).count() == 0


def test_personal_data_stage(spark, frame, docs):
    model = op3_pii.fit(frame.withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "text")
    want = Counter()
    for r in op3_pii.personal_data(frame, model=model).select(*frame.columns, "spans").collect():
        text, at, out = r.text, 0, []
        for a, b, k in sorted((s.start, s.end, s.kind) for s in r.spans):
            if a >= at:
                out += [text[at:a], f"[{op3_pii.ORDER[k].upper()}]"]
            at = max(at, b)
        new = None if text is None else "".join(out) + text[at:]
        want[r.doc_id, new, r.lang, r.source, None if new is None else len(new)] += 1
    assert rows_of(p.personal_data(spark, frame, DATA)) == want


def test_mix_stage(spark, frame, docs):
    rows = p.mix(spark, frame, DATA).collect()
    mixed = op8_curriculum.curriculum(frame).collect()
    assert Counter((r.doc_id, r.source) for r in rows) == sum((Counter({(r.doc_id, r.source): len(r.positions)}) for r in mixed), Counter())
    size = {r[1]: len(re.findall(r"[^\x20\x09-\x0d]+", r[1] or "")) for r in docs}
    assert sum(size[r.text] for r in rows) == sum(r.taken for r in mixed)
    assert sorted(r.position for r in rows) == sorted(x for r in mixed for x in r.positions) and [r.position for r in rows] == sorted(r.position for r in rows)
    clash = frame.withColumn("_key", F.lit(1)).withColumn("position", F.lit("x"))
    assert op8_curriculum.training_order(clash, op8_curriculum.curriculum(clash)).columns == [*frame.columns, "_key", "position"]


def test_order_of_equal_ids_and_hot_null_ids(spark):
    """Rows of one id with different texts are taken as often as the mix says, each at its own places."""
    rows = [(1, "a b c", "s"), (1, "d e f g h i", "s"), *((None, f"w{i} x y z", "s") for i in range(50)), (2, "", "s"), (1, "a b c", "t"), (1, "a b c", "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = op8_curriculum.curriculum(frame)
    out = op8_curriculum.training_order(frame, mixed)
    taken = {(r.doc_id, r.size, r.source): 0 for r in mixed.collect()}
    for r in mixed.collect():
        taken[r.doc_id, r.size, r.source] += r.taken
    got = Counter()
    for r in out.collect():
        got[r.doc_id, len(r.text.split()), r.source] += len(r.text.split())
    assert {k: v for k, v in taken.items() if v} == dict(got)
    assert len({r.row_key for r in mixed.collect()}) >= 53


def test_run_writes_each_stage(spark):
    out = p.run(spark, DATA)
    assert out.columns == ["doc_id", "source", "text", "position"] and out.count() > 0
    common.checkpoint_dir(spark)
