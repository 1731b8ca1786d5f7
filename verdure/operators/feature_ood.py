"""Out-of-distribution scores of classifier features as a Spark ML estimator: fit, calibrate, write, load, transform.

The state is small and of fixed size (class means, two precisions); the calibrated reference may be as large as the validation set, so it stays a table: sorted, with
positions, written beside the state. Scores become p-values by a merge with that table, in ranges."""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector
from . import ood

SCORES = {"rmd": "maha_score", "energy": "energy_score"}


class _Columns(HasFeaturesCol, HasLabelCol):
    logitsCol = Param(Params._dummy(), "logitsCol", "column of the logits, an array", TypeConverters.toString)
    covariance = Param(Params._dummy(), "covariance", "ledoit_wolf or identity", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", logitsCol="logits", covariance="ledoit_wolf")


class FeatureOOD(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """fit() finds class means and the shrunk precisions within classes and over all."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", logitsCol="logits", covariance="ledoit_wolf"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> FeatureOODModel:
        vec, label, kind = self.getFeaturesCol(), self.getLabelCol(), self.getOrDefault("covariance")
        rows = dataset.select(F.col(label).cast("int").alias("label"), F.col(vec).cast("array<double>").alias("v")).dropna()
        means = ood.mean_table(rows, "label", "v")
        if not means:
            raise ValueError("no rows with a label and features")
        mu0 = ood.mean_table(rows.withColumn("label", F.lit(0)), "label", "v")[0][1]
        within = all_ = np.eye(len(mu0))
        if kind == "ledoit_wolf":
            table = F.create_map(*(x for k, m in means for x in (F.lit(k), F.array(*map(F.lit, m)))))
            within = ood.ledoit_wolf(rows.select(F.zip_with("v", table[F.col("label")], lambda a, b: a - b).alias("v")), "v")[1]
            all_ = ood.ledoit_wolf(rows, "v")[1]
        elif kind != "identity":
            raise ValueError("covariance is ledoit_wolf or identity")
        return self._copyValues(FeatureOODModel(means, mu0, within, all_))


class FeatureOODModel(Model, _Columns, MLReadable, MLWritable):
    """means: (label, mean) of each class; reference: (score, value, position) of calibrate(), or None."""

    def __init__(self, means=None, mu0=None, precision=None, precision0=None, reference: DataFrame | None = None):
        super().__init__()
        self.means, self.mu0, self.precision, self.precision0, self.reference = means, mu0, precision, precision0, reference

    def scored(self, rows: DataFrame) -> DataFrame:
        """Adds nearest, distance, rmd and energy."""
        out = ood.relative_mahalanobis(rows, self.getFeaturesCol(), self.means, self.mu0, np.array(self.precision), np.array(self.precision0))
        return out.withColumn("energy", vector.energy(F.col(self.getOrDefault("logitsCol")).cast("array<double>")))

    def calibrate(self, validation: DataFrame) -> FeatureOODModel:
        """Takes the scores of validation rows as the reference."""
        each = self.scored(validation).select(F.explode(F.array(*(F.struct(F.lit(k).alias("score"), F.col(k).alias("value")) for k in SCORES))).alias("s")).select("s.*").filter("value IS NOT NULL")
        self.reference = ood.positions(each, ["score"], ["value"])
        return self

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Adds nearest, distance, rmd, energy and, if there is a reference, maha_score and energy_score: the share of the reference that looks no more typical."""
        out = self.scored(dataset)
        if self.reference is None:
            return out.withColumns({p: F.lit(None).cast("double") for p in SCORES.values()})
        for score, p in SCORES.items():
            out = ood.p_values(out.withColumn("_score", F.lit(score)), "_score", score, self.reference.filter(F.col("score") == score), "score", "value").withColumnRenamed("p", p).drop("_score")
        return out

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: FeatureOODModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        model, spark = self.instance, self.sparkSession
        DefaultParamsWriter.saveMetadata(model, path, spark, extraMetadata={"calibrated": model.reference is not None})
        numbers = lambda v: list(map(float, v))
        rows = [("mean", int(k), numbers(m)) for k, m in model.means] + [("mu0", 0, numbers(model.mu0))]
        rows += [(n, i, numbers(r)) for n, m in (("precision", model.precision), ("precision0", model.precision0)) for i, r in enumerate(m)]
        spark.createDataFrame(rows, "name string, i int, row array<double>").coalesce(1).write.parquet(f"{path}/state")
        if model.reference is not None:
            model.reference.write.parquet(f"{path}/reference")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FeatureOODModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        state: dict = {}
        for r in sorted(spark.read.parquet(f"{path}/state").collect(), key=lambda r: (r.name, r.i)):  # classes + 2 d + 1 rows
            state.setdefault(r.name, []).append((r.i, list(r.row)))
        matrix = lambda n: np.array([v for _, v in state[n]])
        reference = spark.read.parquet(f"{path}/reference") if metadata["calibrated"] else None
        model = self.cls(state["mean"], state["mu0"][0][1], matrix("precision"), matrix("precision0"), reference)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
