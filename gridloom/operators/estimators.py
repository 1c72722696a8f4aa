"""Preparation and linear models as stages of Spark ML pipelines: what they learn is held in their parameters, so they are saved and loaded like any stage."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from . import fits
from .learning import linear_score, logistic


class Stored(HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A stage from an array column to another one."""

    def take(self, given: dict) -> None:
        self._set(**{k: v for k, v in given.items() if v is not None})


class Preparer(Stored, Estimator):
    """Median imputation, quasi-constant and correlation pruning, and z-scores of an array column, learned from all rows by sums."""

    quasi = Param(Params._dummy(), "quasi", "a feature goes whose commonest value has at least this share", TypeConverters.toFloat)
    correlated = Param(Params._dummy(), "correlated", "a feature goes that is correlated above this with an earlier one", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, quasi: float | None = None, correlated: float | None = None):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="prepared", quasi=0.95, correlated=0.95)
        self.take(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PreparedModel:
        x = F.col(self.getInputCol()).cast("array<double>").alias("_x")
        rows = kept(dataset.select(x, F.lit(0).alias("_y"), F.array(F.lit(0)).alias("train")), "prepare")
        found, _ = fits.prepared(rows, 1, self.getOrDefault("quasi"), self.getOrDefault("correlated"), both=False)
        if 0 not in found:
            raise ValueError("a preparation needs rows")
        p = found[0]
        return self._copyValues(PreparedModel(median=p.median.tolist(), kept=p.kept.tolist(), mean=p.mean.tolist(), std=p.std.tolist()))


class PreparedModel(Stored, Model):
    """The kept features, imputed and scaled, worked out inside the JVM."""

    median = Param(Params._dummy(), "median", "what a missing feature counts as", TypeConverters.toListFloat)
    kept = Param(Params._dummy(), "kept", "places of the kept features", TypeConverters.toListInt)
    mean = Param(Params._dummy(), "mean", "means of the kept features", TypeConverters.toListFloat)
    std = Param(Params._dummy(), "std", "deviations of the kept features", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, median: list | None = None, kept: list | None = None, mean: list | None = None, std: list | None = None):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="prepared")
        self.take(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = F.col(self.getInputCol()).cast("array<double>")
        numbers = [self.getOrDefault(n) for n in ("kept", "mean", "std")]
        told = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(m).alias("m"), F.lit(s).alias("s"), F.lit(self.getOrDefault("median")[k]).alias("d")) for k, m, s in zip(*numbers, strict=True)))

        def one(f):
            v = F.get(x, f["k"])
            return (F.when(v.isNull() | F.isnan(v), f["d"]).otherwise(v) - f["m"]) / f["s"]

        return dataset.withColumn(self.getOutputCol(), F.transform(told, one))


class Linear(Stored, HasLabelCol, Estimator):
    """What both linear models share: a label and the model that they give."""

    def model(self, weights) -> LinearModel:
        return self._copyValues(LinearModel(weights=[float(w) for w in weights]))


class Discriminant(Linear):
    """Linear discriminant analysis from summed moments; without a shrinkage, the optimal one."""

    shrinkage = Param(Params._dummy(), "shrinkage", "the share of a scaled identity in the covariance", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, labelCol: str | None = None, outputCol: str | None = None, shrinkage: float | None = None):
        super().__init__()
        self._setDefault(inputCol="prepared", labelCol="label", outputCol="score")
        self.take(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LinearModel:
        shrink = self.getOrDefault("shrinkage") if self.isSet("shrinkage") else None
        return self.model(fits.whole_discriminant(dataset, self.getInputCol(), self.getLabelCol(), shrink))


class RidgeLogistic(Linear):
    """A class-balanced logistic model with a squared penalty, fitted by MLlib."""

    c = Param(Params._dummy(), "c", "the weight of the loss against the penalty", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, labelCol: str | None = None, outputCol: str | None = None, c: float | None = None):
        super().__init__()
        self._setDefault(inputCol="prepared", labelCol="label", outputCol="score", c=1.0)
        self.take(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LinearModel:
        return self.model(logistic(dataset, self.getInputCol(), self.getLabelCol(), self.getOrDefault("c"), False))


class LinearModel(Stored, HasLabelCol, Model):
    """The probability that linear weights give, worked out inside the JVM."""

    weights = Param(Params._dummy(), "weights", "weights, the intercept last", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, weights: list | None = None):
        super().__init__()
        self._setDefault(inputCol="prepared", labelCol="label", outputCol="score")
        self.take(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), linear_score(F.col(self.getInputCol()).cast("array<double>"), self.getOrDefault("weights")))
