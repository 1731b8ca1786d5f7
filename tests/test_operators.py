"""Boundaries and brute force for single operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdure.functions import names, vector
from verdure.operators import gate, knowledge, ood, raster, scoring
from verdure.sources import files


def test_softmax_sums_to_one_and_ranks_ties_by_index(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([0.0, 0.0, 0.0],)], "logits array<double>")
    rows = scoring.classify(df).collect()
    assert [r.class_id for r in rows] == [1, 0]
    assert all(abs(x) < 1e-9 for x in [r.s - 1 for r in df.select(vector.total(vector.softmax("logits")).alias("s")).collect()])


@pytest.mark.parametrize(("confidence", "level"), [(0.85, "high"), (0.8499, "moderate"), (0.6, "moderate"), (0.5999, "low")])
def test_advice_levels(spark, confidence, level):
    assert spark.range(1).select(scoring.advice_level(F.lit(confidence)).alias("x")).first().x == level


def test_band(spark):
    values = [None, float("nan"), float("inf"), 0.55, 0.985, 0.45, 0.30, 1.2]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(vector.band("v", 0.55, 0.985, 0.20).alias("x")).collect()]
    assert got == pytest.approx([0, 0, 0, 1, 1, 0.5, 0, 0])


def test_quality_order(spark):
    rows = [(None, 100, 9.0, 50.0, 100.0, 0.0, 0.0), (63, 100, 9.0, 50.0, 100.0, 0.0, 0.0), (64, 64, 2.9, 50.0, 100.0, 0.0, 0.0), (64, 64, 3.0, 11.9, 100.0, 0.0, 0.0), (64, 64, 3.0, 12.0, 17.9, 0.0, 0.0), (64, 64, 3.0, 12.0, 245.1, 0.0, 0.0), (64, 64, 3.0, 12.0, 18.0, 0.8, 0.8)]
    df = spark.createDataFrame(rows, "height int, width int, std double, sharpness double, mean double, dark double, bright double")
    assert [r.x for r in df.select(gate.quality_reason().alias("x")).collect()] == ["unreadable_or_not_rgb", "resolution_too_low", "blank_or_solid_colour", "too_blurry", "too_dark", "overexposed", None]


def test_deep_score_is_renormalised(spark):
    df = spark.createDataFrame([(0.5, None, None, 1.0), (None, None, None, None)], "ood_gate_prob double, maha_score double, energy_score double, msp double")
    assert [r.x for r in df.select(gate.deep_score().alias("x")).collect()] == [pytest.approx(0.6), None]


def test_unknown_class_is_an_error(spark):
    with pytest.raises(Exception, match="unknown class"):
        knowledge.with_advice(spark.createDataFrame([(10,)], "class_id int")).collect()


def test_knowledge_covers_all_classes(spark):
    assert knowledge.classes(spark).count() == 10
    assert [r.n for r in knowledge.classes(spark).groupBy("pathogen_type").agg(F.count("*").alias("n")).orderBy("n", "pathogen_type").collect()] == [1, 1, 1, 2, 5]


def test_p_values_and_auroc_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i % 2), float(v), bool(b)) for i, (v, b) in enumerate(zip(rng.integers(0, 20, 200), rng.random(200) < 0.4, strict=True))]
    df = spark.createDataFrame(rows, "g int, v double, inside boolean")
    for r in ood.p_values(df, "g", "v").collect():
        mine = [v for g, v, _ in rows if g == r.g]
        assert r.p == pytest.approx(sum(v >= r.v for v in mine) / len(mine))
    a, b = [v for _, v, x in rows if x], [v for _, v, x in rows if not x]
    got = ood.separation(df, "v", "inside").first()
    assert got.auroc == pytest.approx(np.mean([(x > y) + 0.5 * (x == y) for x in a for y in b]))
    assert got.fpr95 == pytest.approx(np.mean([y >= np.quantile(a, 0.05) for y in b]))


def test_ledoit_wolf_against_numpy(spark):
    x = np.random.default_rng(5).normal(size=(60, 4)) @ np.diag([1, 2, 3, 4.0])
    mu, precision, shrink = ood.ledoit_wolf(spark.createDataFrame([(list(map(float, r)),) for r in x], "v array<double>"), "v")
    c = x - x.mean(0)
    s = c.T @ c / len(x)
    m = np.trace(s) / 4
    noise = sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / len(x) ** 2
    want = min(1.0, noise / ((s - m * np.eye(4)) ** 2).sum())
    assert shrink == pytest.approx(want)
    assert precision == pytest.approx(np.linalg.inv((1 - want) * s + want * m * np.eye(4)))


@pytest.mark.parametrize("eight", [False, True])
def test_components_against_flood(eight):
    mask = np.random.default_rng(7).random((17, 23)) < 0.55
    got, seen = raster.label_array(mask, eight), {}
    for y, x in zip(*np.nonzero(mask), strict=True):
        if (y, x) in seen:
            continue
        first, todo = y * 23 + x + 1, [(y, x)]
        while todo:
            p = todo.pop()
            if p in seen or not (0 <= p[0] < 17 and 0 <= p[1] < 23) or not mask[p]:
                continue
            seen[p] = first
            todo += [(p[0] + dy, p[1] + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if eight or abs(dy) + abs(dx) == 1]
    assert all(got[p] == v for p, v in seen.items()) and (got[~mask] == 0).all()


def test_names(spark):
    df = spark.createDataFrame([("Tomato___Spider_mites Two-spotted_spider_mite",), ("Tomato___healthy",)], "n string")
    assert [r.x for r in df.select(names.pretty("n").alias("x")).collect()] == ["Spider mites (two-spotted)", "Healthy"]
    df = spark.createDataFrame([("a.JPG",), ("noext",), ("x.gif",)], "n string")
    assert [r.x for r in df.select(names.accepted(F.col("n")).alias("x")).collect()] == [True, True, False]


def test_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.png").write_bytes(b"abc")
    (tmp_path / "m" / "b.gif").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r.error for r in files.uploads(spark, str(tmp_path / "m")).collect()}
    assert got == {"a.png": None, "b.gif": "unsupported extension"}
    assert files.manifest(spark, str(tmp_path / "m")).filter("file = 'a.png'").first().sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_advice_join_is_broadcast(spark):
    plan = knowledge.with_advice(spark.range(10).withColumn("class_id", F.col("id").cast("int")))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_history_stream_resumes(spark, tmp_path):
    from verdure.streaming.events import history_stream

    def run():
        out = history_stream(spark, str(tmp_path / "in"), "*.parquet", "user long, n long", "user", ["n"], str(tmp_path / "out"), str(tmp_path / "checkpoint"), keep=3)
        return sorted(tuple(r) for r in out.collect())

    spark.createDataFrame([(1, n) for n in range(5)], "user long, n long").write.parquet(str(tmp_path / "in"))
    assert run() == [(1, 2), (1, 3), (1, 4)]
    assert run() == [(1, 2), (1, 3), (1, 4)]  # nothing new
    spark.createDataFrame([(1, 9), (2, 0)], "user long, n long").write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == [(1, 3), (1, 4), (1, 9), (2, 0)]


def test_history_stream_of_a_folder_of_part_files(spark, tmp_path):
    from tests.conftest import DATA
    from verdure.plans import catalogue

    spark.read.parquet(f"{DATA}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    want, got = (sorted(map(tuple, catalogue.queries()["history_stream"](spark, d).collect())) for d in (DATA, str(tmp_path)))
    assert got == want and want


def test_rmd_ledoit_wolf_takes_whole_vectors(spark):
    import numpy as np

    from tests.conftest import DATA
    from verdure.plans import catalogue

    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    x, y = np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])
    means = {k: x[y == k].mean(0) for k in sorted(set(y.tolist()))}

    def precision(v):
        v = v - v.mean(0)
        n, d = v.shape
        s = v.T @ v / n
        scale = np.trace(s) / d
        spread = ((s - scale * np.eye(d)) ** 2).sum()
        noise = min((((v * v).T @ (v * v)).sum() / n - (s * s).sum()) / n, spread)
        return np.linalg.inv((1 - noise / spread) * s + noise / spread * scale * np.eye(d))

    within, total = precision(x - np.array([means[k] for k in y.tolist()])), precision(x)
    form = lambda v, p: np.einsum("ij,jk,ik->i", v, p, v)
    each = np.array([form(x - m, within) for m in means.values()])
    want = {r.vec_id: (list(means)[k], d, e) for r, k, d, e in zip(rows, each.argmin(0).tolist(), each.min(0), each.min(0) - form(x - x.mean(0), total), strict=True)}
    for r in catalogue.queries()["rmd_ledoit_wolf"](spark, DATA).collect():
        k, d, e = want[r.vec_id]
        assert r.nearest == k and abs(r.distance - d) < 1e-4 and abs(r.rmd - e) < 1e-4
