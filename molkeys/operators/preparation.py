"""Preparation of features as a Spark ML stage: what the training rows say is fitted once, saved with a pipeline, and applied to any rows.

Order of work: missing values take the training median; values below 0 are cut and log1p is taken where asked; features without variance
go, then those whose total is below a bound; the rest are scaled. A column that later rows lack takes its median, others are ignored.
Statistics of all features are aggregates over their long form, so a wide table is no wide aggregate.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles, long_form


# Names of columns that are labels rather than features.
LABEL_NAMES = ("label", "labels", "class", "classes", "target", "targets", "y", "residue_type", "residue", "ligand", "ligand_name", "carb_name", "carbohydrate")


def feature_columns(columns: list[str], identifier: str) -> list[str]:
    """The columns that may be features: neither the identifier's nor one named like a label."""
    return [c for c in columns if c != identifier and c.strip().lower() not in LABEL_NAMES]


class _Settings(Params):
    outputCol = Param(Params._dummy(), "outputCol", "vector of the prepared features", TypeConverters.toString)
    log = Param(Params._dummy(), "log", "whether to take log1p of values cut at 0", TypeConverters.toBoolean)
    scaler = Param(Params._dummy(), "scaler", "standard, robust or none", TypeConverters.toString)

    def _value(self, column: str, median: float) -> Column:
        x = F.coalesce(F.nanvl(F.col(f"`{column}`").cast("double"), F.lit(None)), F.lit(float(median)))
        return F.log1p(F.greatest(x, F.lit(0.0))) if self.getOrDefault("log") else x


class Preparation(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    inputCols = Param(Params._dummy(), "inputCols", "numeric columns", TypeConverters.toListString)
    leastTotal = Param(Params._dummy(), "leastTotal", "features with a smaller total go, where it is above 0", TypeConverters.toFloat)

    def __init__(self, inputCols: list[str] = (), outputCol: str = "features", log: bool = False, leastTotal: float = 0.0, scaler: str = "standard"):
        super().__init__()
        if scaler not in ("standard", "robust", "none"):
            raise ValueError(f"unknown scaler {scaler}")
        self._set(inputCols=list(inputCols), outputCol=outputCol, log=log, leastTotal=leastTotal, scaler=scaler)

    def _fit(self, dataset: DataFrame) -> PreparationModel:
        columns, least, scaler = (self.getOrDefault(p) for p in ("inputCols", "leastTotal", "scaler"))
        found = {r.column: r.value for r in exact_quantiles(dataset, columns, [0.5]).collect()}
        medians = [found.get(c, 0.0) for c in columns]  # without values: 0
        filled = dataset.select(*[self._value(c, m).alias(f"f{i}") for i, (c, m) in enumerate(zip(columns, medians))])
        names = [f"f{i}" for i in range(len(columns))]
        got = {r.c: r for r in long_form(filled, names).groupBy("c").agg(F.avg("v").alias("mean"), F.var_samp("v").alias("variance"), F.stddev_pop("v").alias("deviation"), F.sum("v").alias("total")).collect()}
        constant = [c for i, c in enumerate(columns) if i not in got or not got[i].variance or got[i].variance <= 0]
        rare = [c for i, c in enumerate(columns) if c not in constant and least > 0 and got[i].total < least]
        kept = [i for i, c in enumerate(columns) if c not in constant and c not in rare]
        if not kept:
            raise ValueError("no feature is left")
        centers, scales = [0.0] * len(kept), [1.0] * len(kept)
        if scaler == "standard":
            centers, scales = [got[i].mean for i in kept], [got[i].deviation for i in kept]
        elif scaler == "robust":
            parts = {(r.column, r.share): r.value for r in exact_quantiles(filled, [names[i] for i in kept], [0.25, 0.5, 0.75]).collect()}
            centers = [parts[names[i], 0.5] for i in kept]
            scales = [(parts[names[i], 0.75] - parts[names[i], 0.25]) or 1.0 for i in kept]
        cut = self.getOrDefault("log") and not long_form(dataset, columns).where("v < 0").isEmpty()
        model = PreparationModel()
        model._set(outputCol=self.getOrDefault("outputCol"), log=self.getOrDefault("log"), scaler=scaler, features=[columns[i] for i in kept], fills=[medians[i] for i in kept], centers=centers, scales=scales, constant=constant, rare=rare, cut=bool(cut))
        return model


class PreparationModel(Model, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    features = Param(Params._dummy(), "features", "columns kept, in the order of the vector", TypeConverters.toListString)
    fills = Param(Params._dummy(), "fills", "their medians", TypeConverters.toListFloat)
    centers = Param(Params._dummy(), "centers", "what is taken off", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "what is divided by", TypeConverters.toListFloat)
    constant = Param(Params._dummy(), "constant", "columns without variance", TypeConverters.toListString)
    rare = Param(Params._dummy(), "rare", "columns of small total", TypeConverters.toListString)
    cut = Param(Params._dummy(), "cut", "whether training values were cut at 0", TypeConverters.toBoolean)

    def __init__(self):
        super().__init__()

    @property
    def kept(self) -> list[str]:
        return self.getOrDefault("features")

    @property
    def medians(self) -> dict[str, float]:
        return dict(zip(self.kept, self.getOrDefault("fills")))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        there, values = set(dataset.columns), []
        for c, m, center, scale in zip(self.kept, *(self.getOrDefault(p) for p in ("fills", "centers", "scales"))):
            x = self._value(c, m) if c in there else self._filled(m)
            values.append(x if (center, scale) == (0.0, 1.0) else (x - F.lit(center)) / F.lit(scale))
        return dataset.withColumn(self.getOrDefault("outputCol"), array_to_vector(F.array(*values)))

    def _filled(self, median: float) -> Column:
        return F.log1p(F.greatest(F.lit(median), F.lit(0.0))) if self.getOrDefault("log") else F.lit(median)

    def report(self, spark) -> DataFrame:
        """One row: how many features there are, which went and why, and whether values were cut."""
        constant, rare = self.getOrDefault("constant"), self.getOrDefault("rare")
        row = (len(self.kept) + len(constant) + len(rare), len(self.kept), constant, rare, self.getOrDefault("scaler"), self.getOrDefault("log"), self.getOrDefault("cut"))
        return spark.createDataFrame([row], "n_features int, n_kept int, zero_variance array<string>, rare array<string>, scaler string, log boolean, negatives_cut boolean")
