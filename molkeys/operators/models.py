"""Classifiers with Spark ML: training, saved models, calibration, boosting with history, importances, evaluation."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, OneVsRestModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molkeys.scratch import scratch_path, written

from . import metrics
from .preparation import Preparation, PreparationModel
from .ranks import draw, numbered


def numeric(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles; what cannot be read is null."""
    return rows.select(*[F.col(f"`{c}`").cast("string").try_cast("double").alias(c) if c in columns else F.col(f"`{c}`") for c in rows.columns])


def missing_report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_missing, all_missing)."""
    counts = rows.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns], F.count("*").alias("_n"))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_missing"), (F.col(f"`{c}`") == F.col("_n")).alias("all_missing")) for c in columns])).alias("r")).select("r.*")


def fit_preprocessor(train: DataFrame, columns: list[str], log: bool = False, least_total: float = 0.0, scaler: str = "standard") -> PreparationModel:
    """What the training rows say about their features."""
    return Preparation(columns, log=log, leastTotal=least_total, scaler=scaler).fit(train)


def prepare(rows: DataFrame, state: PreparationModel) -> DataFrame:
    """Adds ``features``, the vector of kept features; a column that is missing takes its median, others are ignored."""
    return state.transform(rows)


def penalty(params: dict) -> dict:
    """Spark's parameters of ``penalty`` (l1, l2, elasticnet or none), ``C``, ``l1_ratio`` and the ``n`` training rows; others pass through.

    An elastic net needs a ratio from 0 to 1, no other penalty takes one, and C must be positive; C and n are needed with a penalty.
    """
    if "penalty" not in params:
        return params
    rest = {k: v for k, v in params.items() if k not in ("penalty", "C", "l1_ratio", "n")}
    kind, c, ratio = params["penalty"], params.get("C", 1.0), params.get("l1_ratio")
    if kind not in ("l1", "l2", "elasticnet", "none"):
        raise ValueError(f"unknown penalty {kind}")
    if (kind == "elasticnet") != (ratio is not None):
        raise ValueError("an elastic net, and nothing else, needs l1_ratio")
    if ratio is not None and not 0 <= ratio <= 1:
        raise ValueError("l1_ratio must be from 0 to 1")
    if c <= 0:
        raise ValueError("C must be positive")
    return rest | ({} if kind == "none" else {"regParam": 1.0 / (c * params["n"]), "elasticNetParam": {"l1": 1.0, "l2": 0.0}.get(kind, ratio)})


def classifier(kind: str, label: str = "label", features: str = "features", weight: str | None = None, seed: int = 42, n_features: int = 0, n_classes: int = 2, **params):
    """random_forest, boosting, svm, logistic_regression or mlp."""
    common = {"labelCol": label, "featuresCol": features}
    weighted = common | ({"weightCol": weight} if weight else {})
    if kind == "random_forest":
        return RandomForestClassifier(**weighted, seed=seed, featureSubsetStrategy="sqrt", **({"numTrees": 500, "maxDepth": 15} | params))
    if kind == "boosting":
        return OneVsRest(classifier=GBTClassifier(**common, seed=seed, **({"maxIter": 100, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8} | params)), **common)
    if kind == "svm":
        return OneVsRest(classifier=LinearSVC(**common, **({"maxIter": 100} | params)), **common)
    if kind == "logistic_regression":
        return LogisticRegression(**weighted, family="multinomial", **({"maxIter": 200} | penalty(params)))
    if kind == "mlp":
        return MultilayerPerceptronClassifier(**common, seed=seed, layers=[n_features, *params.pop("hidden", [64, 32]), n_classes], **params)
    raise ValueError(f"unknown classifier {kind}")


#: Training rows of a task at least.
TASK_ROWS = 200


def dealt(rows: DataFrame) -> DataFrame:
    """Training rows over all cores of the cluster.

    A small table is one file and so one task, and trees count their rows, and choose their splits, in as many tasks as the rows have.
    """
    rows = written(rows, "training")
    return rows.repartition(max(1, min(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // TASK_ROWS)))


#: Nodes of trees that are grown, and held by the driver, at once, about.
NODES = 400_000
#: Between the seeds of a forest's parts, more than a table has partitions.
SEEDS = 1_000_003


def train(rows: DataFrame, state: PreparationModel, model) -> PipelineModel:
    """Preparation and classifier as one pipeline, fitted on rows; the stage of a forest of many nodes is a ``Forest``."""
    if isinstance(model, RandomForestClassifier):
        return grown(dealt(rows).persist(), state, model)
    fitted = Pipeline(stages=[state, model]).fit(rows)
    without_summary(fitted.stages[-1])
    return fitted


def grown(rows: DataFrame, state: PreparationModel, model: RandomForestClassifier) -> PipelineModel:
    """Preparation and forest, its trees grown part by part so that no part has more than about ``NODES`` nodes.

    Spark keeps all nodes of a forest in the driver, while it grows and after, and sends them with each task. A part is written before the next one grows.
    The first is as large as any trees of so many rows and levels may be, the others by the nodes of those before. A forest of few nodes is one part, as Spark fits it.
    """
    trees, path, parts, nodes = model.getNumTrees(), scratch_path(rows.sparkSession, "forest"), [], 0
    most = min(2 ** (model.getMaxDepth() + 1) - 1, 2 * max(1, rows.count()) - 1)
    done = 0
    while done < trees:
        size = trees if model.getLeafCol() else min(trees - done, max(1, int(NODES // most)))
        # places of rows in trees are kept with the rows: else all trees go with each task
        own = model.copy({model.numTrees: size, model.seed: model.getSeed() + SEEDS * len(parts), model.cacheNodeIds: True})
        fitted = Pipeline(stages=[state, own]).fit(rows)
        part = without_summary(fitted.stages[-1])
        done, nodes = done + size, nodes + part.totalNumNodes
        if size == trees:
            break
        parts.append(f"{path}/{len(parts)}")
        part.save(parts[-1])
        # trees of one forest are of like size
        most = min(most, max(1.0, 1.25 * nodes / done))
    rows.unpersist()
    if not parts:
        return fitted
    return PipelineModel([state, Forest(parts, model.getFeaturesCol(), trees, model.getThresholds() if model.isSet(model.thresholds) else [])])


def without_summary(model):
    """The fitted model without its training summary, as a loaded one is.

    The summary of two classes holds the session, and tasks cannot take that along once the session has observed a metric.
    """
    for one in getattr(model, "models", [model]):
        if getattr(one, "hasSummary", False):
            one._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(rows: DataFrame, model: PipelineModel, label: str = "label") -> DataFrame:
    """Rows with prediction, probabilities as an array, confidence and whether it is right; a saved model is applied to new rows the same way.

    A model without probabilities, but with scores, gives the softmax of its scores.
    """
    out = model.transform(rows)
    if "probability" in out.columns:
        shares = vector_to_array("probability")
    elif "rawPrediction" in out.columns:
        shares = softmax(vector_to_array("rawPrediction"))
    else:
        shares = F.lit(None).cast("array<double>")
    out = out.withColumn("probabilities", shares)
    return out.withColumns({"confidence": F.array_max("probabilities"), "is_correct": F.col("prediction") == F.col(label)})


def misclassified(predicted: DataFrame) -> DataFrame:
    return predicted.where("not is_correct")


def evaluate_splits(predicted: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """(split, n, accuracy, balanced accuracy, macro and weighted precision, recall and F1) of predicted rows."""
    names = [r[0] for r in predicted.select(split).distinct().orderBy(split).collect()]
    out = None
    for name in names:
        own = predicted.where(F.col(split) == name)
        one = metrics.summary(own, label, "prediction").crossJoin(own.agg(F.count("*").alias("n"))).withColumn("split", F.lit(name))  # single rows
        out = one if out is None else out.unionByName(one)
    return out


def importances(model: PipelineModel) -> DataFrame:
    """(feature, importance) of a forest, or the mean of absolute coefficients of a linear model, largest first."""
    spark = SparkSession.active()
    names, last = model.stages[0].kept, model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficientMatrix"):
        values = abs(last.coefficientMatrix.toArray()).mean(0)
    else:
        values = sum(abs(m.coefficients.toArray()) for m in last.models) / len(last.models)
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def class_coefficients(model: PipelineModel) -> DataFrame:
    """(class, feature, coefficient) of a linear model."""
    names, last = model.stages[0].kept, model.stages[-1]
    matrix = last.coefficientMatrix.toArray() if hasattr(last, "coefficientMatrix") else [m.coefficients.toArray() for m in last.models]
    return SparkSession.active().createDataFrame([(c, n, float(v)) for c, row in enumerate(matrix) for n, v in zip(names, row)], "class int, feature string, coefficient double")


class ForestWriter(MLWriter):
    def __init__(self, forest: Forest):
        super().__init__()
        self.forest = forest

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.forest, path, self.sparkSession)
        for i, part in enumerate(self.forest.parts()):
            part.save(f"{path}/parts/{i}")


class ForestReader(MLReader):
    def load(self, path: str) -> Forest:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        forest = Forest()
        forest._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(forest, metadata)
        return forest._set(paths=[f"{path}/parts/{i}" for i in range(len(forest.getOrDefault("paths")))])


class Forest(Model, MLWritable, MLReadable):
    """A random forest in written parts, of which one at a time is in memory. It scores as Spark's forest of all the trees does.

    Scoring runs one job a part, as ``transform`` is called, which writes the votes of its trees for each row; a row's votes are added in the order of the parts.
    """

    paths = Param(Params._dummy(), "paths", "of the parts", TypeConverters.toListString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector of the features", TypeConverters.toString)
    numTrees = Param(Params._dummy(), "numTrees", "of all parts", TypeConverters.toInt)
    thresholds = Param(Params._dummy(), "thresholds", "by which the probability of each class is divided for the prediction, none if empty", TypeConverters.toListFloat)

    def __init__(self, paths: list[str] = (), featuresCol: str = "features", numTrees: int = 0, thresholds: list[float] = ()):
        super().__init__()
        self._set(paths=list(paths), featuresCol=featuresCol, numTrees=numTrees, thresholds=list(thresholds))

    @property
    def getNumTrees(self) -> int:
        return self.getOrDefault("numTrees")

    def parts(self) -> Iterator[RandomForestClassificationModel]:
        for path in self.getOrDefault("paths"):
            yield RandomForestClassificationModel.load(path)

    @property
    def featureImportances(self) -> DenseVector:
        """The mean of the trees that have a split, as in one forest."""
        total = sum(part.featureImportances.toArray() * sum(t.numNodes > 1 for t in part.trees) for part in self.parts())
        return DenseVector(total / (total.sum() or 1.0))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark, features = dataset.sparkSession, self.getOrDefault("featuresCol")
        rows = written(dataset.withColumn("_row", F.monotonically_increasing_id()), "scored")
        path = scratch_path(spark, "votes")
        for i, part in enumerate(self.parts()):
            voted = part.setPredictionCol("").setProbabilityCol("").transform(rows.select("_row", features))
            voted.select("_row", F.lit(i).alias("part"), vector_to_array("rawPrediction").alias("votes")).write.mode("append").parquet(path)
        each = spark.read.parquet(path).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("part", "votes"))).alias("_each"))
        none = F.transform(F.col("_each")[0]["votes"], lambda _: F.lit(0.0))
        votes = F.aggregate("_each", none, lambda a, x: F.zip_with(a, x["votes"], lambda p, q: p + q))
        shares = F.transform("_votes", lambda x: x / F.lit(float(self.getNumTrees)))
        limits = self.getOrDefault("thresholds")
        # a limit of 0 is passed by any share above 0
        judged = F.zip_with("_shares", F.array(*map(F.lit, limits)), lambda p, t: F.when(t > 0, p / t).when(p > 0, float("inf")).otherwise(0.0)) if limits else F.col("_shares")
        out = rows.join(each.select("_row", votes.alias("_votes")), "_row").withColumn("_shares", shares)
        # of equal shares the first class
        first = (F.array_position(judged, F.array_max(judged)) - 1).cast("double")
        return out.withColumns({"rawPrediction": array_to_vector("_votes"), "probability": array_to_vector("_shares"), "prediction": first}).drop("_row", "_votes", "_shares")

    def write(self) -> ForestWriter:
        return ForestWriter(self)

    @classmethod
    def read(cls) -> ForestReader:
        return ForestReader()


class Calibration(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Probabilities from one score a class: a logistic curve for each, scaled to sum to one. A stage behind a classifier with scores."""

    slopes = Param(Params._dummy(), "slopes", "of the curves", TypeConverters.toListFloat)
    offsets = Param(Params._dummy(), "offsets", "of the curves", TypeConverters.toListFloat)

    def __init__(self, slopes: list[float] = (), offsets: list[float] = ()):
        super().__init__()
        self._set(slopes=list(slopes), offsets=list(offsets))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scores = vector_to_array("rawPrediction")
        each = [1 / (1 + F.exp(-(F.lit(a) * F.get(scores, F.lit(i)) + F.lit(b)))) for i, (a, b) in enumerate(zip(self.getOrDefault("slopes"), self.getOrDefault("offsets")))]
        total = sum(each[1:], each[0])
        shares = F.array(*[F.when(total > 0, e / total).otherwise(1.0 / len(each)) for e in each])
        out = dataset.drop("prediction").withColumn("_shares", shares)
        # of equal shares the first class
        return out.withColumns({"probability": array_to_vector("_shares"), "prediction": (F.array_position("_shares", F.array_max("_shares")) - 1).cast("double")}).drop("_shares")


def calibrated_svm(rows: DataFrame, state: PreparationModel, key: str, label: str = "label", folds: int = 5, seed: int = 42, **params) -> tuple[PipelineModel, DataFrame]:
    """(pipeline, out-of-fold rows): linear support vectors for each class against the rest, with probabilities.

    Every row is scored by a model that has not seen its fold; folds have like shares of all classes. A logistic curve for each class is fitted to
    these scores, with targets drawn in from 0 and 1 by the class counts. The model that is kept is fitted on all rows.
    """
    if folds < 2:
        raise ValueError("calibration needs two folds")
    data = written(numbered(state.transform(rows), [draw(seed, key), F.col(key)], [label], "_p").withColumn("fold", (F.col("_p") % folds).cast("int")).select(key, F.col(label).cast("double").alias(label), "features", "fold"), "folds")
    svm = classifier("svm", label, seed=seed, **params)
    parts = [without_summary(svm.fit(data.where(F.col("fold") != f))).transform(data.where(F.col("fold") == f)) for f in range(folds)]
    scores = parts[0].select(key, label, "fold", "rawPrediction")
    for part in parts[1:]:
        scores = scores.unionByName(part.select(*scores.columns))
    scores = written(scores, "scores")
    final = without_summary(svm.fit(data))
    slopes, offsets = [], []
    for c in range(len(final.models)):
        one = scores.select((F.col(label) == c).alias("is"), F.get(vector_to_array("rawPrediction"), F.lit(c)).alias("s"))
        n, hits = one.agg(F.count("*"), F.count_if("is")).first()
        high, low = (hits + 1) / (hits + 2), 1 / (n - hits + 2)
        target = F.when(F.col("is"), high).otherwise(low)
        both = one.select(array_to_vector(F.array("s")).alias("features"), F.explode(F.array(F.struct(F.lit(1.0).alias("y"), target.alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - target).alias("w")))).alias("t"))
        curve = LogisticRegression(labelCol="y", weightCol="w", maxIter=100, tol=1e-9).fit(both.select("features", "t.y", "t.w"))
        slopes.append(float(curve.coefficients[0]))
        offsets.append(float(curve.intercept))
    calibration = Calibration(slopes, offsets)
    return PipelineModel([state, final, calibration]), calibration.transform(scores)


def calibration_table(predicted: DataFrame, label: str = "label", bins: int = 10) -> DataFrame:
    """(class, bin, n, mean_probability, share): how often a class is true where it has a probability of about so much."""
    long = predicted.select(F.col(label).alias("_y"), F.posexplode(vector_to_array("probability")).alias("class", "p"))
    place = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return long.groupBy("class", place.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_probability"), F.avg((F.col("_y") == F.col("class")).cast("double")).alias("share"))


def boost(rows: DataFrame, state: PreparationModel, validation: str, label: str = "label", seed: int = 42, **params) -> tuple[PipelineModel, DataFrame]:
    """(pipeline, history) of boosted trees, one against the rest, that stop when the rows marked by the column ``validation`` gain nothing.

    The history has (class, iteration, train, validation): the loss of the ensemble's first trees over both sets of rows, for as many trees as
    the stop left.
    """
    data = written(state.transform(rows).select(F.col(label).cast("double").alias(label), "features", validation), "boosting")
    n_classes = int(data.agg(F.max(label)).first()[0]) + 1
    settings = {"maxIter": 100, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8, "validationTol": 0.01} | params
    models, lines = [], []
    for c in range(1 if n_classes == 2 else n_classes):
        own = data.withColumn("_y", (F.col(label) == (1 if n_classes == 2 else c)).cast("double"))
        trees = GBTClassifier(labelCol="_y", featuresCol="features", seed=seed, validationIndicatorCol=validation, **settings).fit(own)
        losses = [trees.evaluateEachIteration(own.where(F.col(validation) == held).select("_y", "features")) for held in (False, True)]
        lines += [(c, i, float(x), float(y)) for i, (x, y) in enumerate(zip(*losses), 1)]
        models.append(trees)
    history = rows.sparkSession.createDataFrame(lines, "class int, iteration int, train double, validation double")
    return PipelineModel([state, models[0] if n_classes == 2 else OneVsRestModel(models)]), history


def softmax(scores: Column) -> Column:
    """Shares of decision scores."""
    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def projection(rows: DataFrame, k: int = 2, vector: str = "features") -> DataFrame:
    """Principal components for a plot."""
    return PCA(k=k, inputCol=vector, outputCol="pca").fit(rows).transform(rows)
