"""Rank joins, positions, quantiles and the stored model, against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdure.operators import ood
from verdure.operators.feature_ood import FeatureOOD, FeatureOODModel


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(4)
    rows = [("a", float(v)) for v in rng.integers(0, 40, 700)] + [("a", 7.0)] * 900 + [("b", 1.5), ("b", None), (None, 3.0), (None, 2.0), ("c", 1.0)]
    reference = [("a", float(v)) for v in rng.integers(0, 40, 300)] + [("a", 7.0)] * 500 + [("b", 1.5), ("b", None), (None, 2.5), ("d", 0.0)]
    return rows, reference


def test_rank_join_with_a_hot_value(spark, values):
    rows, reference = values
    out = ood.placed(spark.createDataFrame(rows, "g string, v double"), "g", "v", spark.createDataFrame(reference, "h string, w double"), "h", "w")
    got = sorted((str(tuple(r)) for r in out.collect()))
    ref = lambda g: [w for h, w in reference if h == g and w is not None]
    want = sorted(str((g, v, None if v is None else sum(w < v for w in ref(g)), len(ref(g)))) for g, v in rows)
    assert got == want


def test_p_values_are_null_without_a_reference(spark, values):
    rows, reference = values
    out = ood.p_values(spark.createDataFrame(rows, "g string, v double"), "g", "v", spark.createDataFrame(reference, "h string, w double").filter("h = 'zzz'"), "h", "w")
    assert out.filter("p IS NOT NULL").count() == 0 and out.count() == len(rows)


def test_positions(spark, values):
    out = ood.positions(spark.createDataFrame(values[0], "g string, v double"), ["g"], ["v"]).collect()
    for g in {r.g for r in out}:
        mine = sorted((r.position, r.v) for r in out if r.g == g)
        assert [p for p, _ in mine] == list(range(len(mine)))
        assert [v for _, v in mine] == sorted((v for h, v in values[0] if h == g), key=lambda v: (v is not None, v))


def test_quantiles(spark, values):
    got = {(r.g, r.share): r.quantile for r in ood.quantiles(spark.createDataFrame(values[0], "g string, v double"), "g", "v", [0.0, 0.05, 0.33, 0.5, 0.999, 1.0]).collect()}
    for (g, q), x in got.items():
        assert x == pytest.approx(np.quantile([v for h, v in values[0] if h == g and v is not None], q))
    assert len(got) == 4 * 6


@pytest.mark.parametrize("kind", ["identity", "ledoit_wolf"])
def test_model_is_the_same_after_loading(spark, tmp_path, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 5)) @ rng.normal(size=(5, 5))
    rows = [(i, i % 3, list(map(float, v)), [float(i % 7), 1.0, -2.0]) for i, v in enumerate(x)] + [(120, 1, None, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, label int, features array<double>, logits array<double>")
    model = FeatureOOD(covariance=kind).fit(df)
    assert model.transform(df).filter("maha_score IS NOT NULL").count() == 0  # not calibrated
    model.calibrate(df)
    before = sorted(map(str, model.transform(df).select("id", "nearest", "rmd", "maha_score", "energy_score").collect()))
    model.save(str(tmp_path / "model"))
    loaded = FeatureOODModel.load(str(tmp_path / "model"))
    assert loaded.getOrDefault("covariance") == kind and loaded.uid == model.uid
    assert sorted(map(str, loaded.transform(df).select("id", "nearest", "rmd", "maha_score", "energy_score").collect())) == before
    precision = np.linalg.inv(ood.shrunk_covariance(df.filter("features IS NOT NULL"), "features")[1]) if kind == "ledoit_wolf" else np.eye(5)
    d0 = np.einsum("nd,dk,nk->n", x - x.mean(0), precision, x - x.mean(0))
    means = np.stack([x[np.arange(120) % 3 == c].mean(0) for c in range(3)])
    centred = spark.createDataFrame([(list(map(float, v - means[i % 3])),) for i, v in enumerate(x)], "v array<double>")
    within = np.linalg.inv(ood.shrunk_covariance(centred, "v")[1]) if kind == "ledoit_wolf" else np.eye(5)
    rmd = np.min([np.einsum("nd,dk,nk->n", x - m, within, x - m) for m in means], 0) - d0
    got = {r.id: r for r in loaded.transform(df).collect()}
    assert [got[i].rmd for i in range(120)] == pytest.approx(rmd)
    assert [got[i].maha_score for i in range(120)] == pytest.approx([1 - (rmd < v - 1e-12).sum() / 120 for v in rmd])
    assert got[120].rmd is None and got[120].maha_score is None and got[120].energy_score is not None


def test_errors(spark):
    df = spark.createDataFrame([(1, [1.0])], "label int, features array<double>").withColumn("logits", F.col("features"))
    with pytest.raises(ValueError):
        FeatureOOD().fit(df.limit(0))
    with pytest.raises(ValueError):
        FeatureOOD(covariance="full").fit(df)
