"""Evaluation of predictions as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running_sums


def confusion(rows: DataFrame, true: str = "y", pred: str = "p", by: list[str] = ()) -> DataFrame:
    return rows.groupBy(*by, true, pred).agg(F.count("*").alias("n"))


def normalised_confusion(rows: DataFrame, true: str = "y", pred: str = "p") -> DataFrame:
    """Shares of each true class; 0 where a class has no rows."""
    return confusion(rows, true, pred).withColumn("share", F.coalesce(F.try_divide("n", F.sum("n").over(Window.partitionBy(true))), F.lit(0.0)))


def top_confused(rows: DataFrame, true: str = "y", pred: str = "p", n: int = 25) -> DataFrame:
    """A report of the most frequent wrong pairs."""
    return confusion(rows, true, pred).where(F.col(true) != F.col(pred)).orderBy(F.desc("n"), true, pred).limit(n)


def class_report(rows: DataFrame, true: str = "y", pred: str = "p") -> DataFrame:
    """(class, support, precision, recall, f1); 0 where a share is undefined."""
    cells = confusion(rows, true, pred)
    t = cells.groupBy(F.col(true).alias("class")).agg(F.sum("n").alias("support"))
    p = cells.groupBy(F.col(pred).alias("class")).agg(F.sum("n").alias("predicted"))
    hit = cells.where(F.col(true) == F.col(pred)).select(F.col(true).alias("class"), F.col("n").alias("hits"))
    out = t.join(p, "class", "full").join(hit, "class", "left").na.fill(0)
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumns({"precision": share(F.col("hits"), F.col("predicted")), "recall": share(F.col("hits"), F.col("support"))})
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("class", "support", "precision", "recall", "f1")


def summary(rows: DataFrame, true: str = "y", pred: str = "p") -> DataFrame:
    """One row: accuracy, balanced accuracy, macro and weighted precision, recall and F1."""
    report = class_report(rows, true, pred)
    acc = rows.agg(F.avg((F.col(true) == F.col(pred)).cast("double")).alias("accuracy"))
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}")
    balanced = F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy")
    return report.agg(balanced, *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[weighted(c) for c in ("precision", "recall", "f1")]).crossJoin(acc)


def binary_auc(rows: DataFrame, true: str = "y", score: str = "score", by: list[str] = ()) -> DataFrame:
    """ROC-AUC and average precision of a score; rows of equal scores are one step, so only distinct scores are ordered.

    Counts per score are aggregated before the cumulative sums, which go by ranges of scores.
    """
    steps = rows.groupBy(*by, score).agg(F.sum(F.col(true).cast("long")).alias("pos"), F.sum(1 - F.col(true).cast("long")).alias("neg"))
    steps = running_sums(steps, [(F.col(score), Column.desc_nulls_last)], {"tp": F.col("pos"), "fp": F.col("neg")}, by)
    out = steps.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("area"),
        F.sum(F.col("pos") * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))).alias("ap"),
    )
    return out.select(*by, F.try_divide("area", F.col("n_pos") * F.col("n_neg")).alias("roc_auc"), F.try_divide("ap", "n_pos").alias("average_precision"))


def multiclass_auc(rows: DataFrame, classes: list, true: str = "y", probabilities: str = "probability") -> DataFrame:
    """Macro and weighted one-against-the-rest ROC-AUC and average precision; null with fewer than two classes."""
    one = F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in classes]).alias("cls"), F.col(probabilities).alias("score"))).alias("x")
    long = rows.select(true, one).select(F.col("x.cls").alias("cls"), (F.col(true) == F.col("x.cls")).cast("int").alias("y1"), F.col("x.score").alias("score"))
    each = binary_auc(long, "y1", "score", ["cls"]).join(rows.groupBy(F.col(true).alias("cls")).agg(F.count("*").alias("n")), "cls")
    return each.agg(*[F.when(F.count("*") >= 2, F.avg(c)).alias(f"macro_{c}") for c in ("roc_auc", "average_precision")], *[F.when(F.count("*") >= 2, F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"weighted_{c}") for c in ("roc_auc", "average_precision")])


def feature_frequency(freq: DataFrame, key: str = "key") -> DataFrame:
    """Total of each feature and the samples that have it, largest first."""
    return freq.groupBy(key).agg(F.sum("freq").alias("total"), F.count(F.when(F.col("freq") != 0, 1)).alias("n_samples")).orderBy(F.desc("total"), key)


def confidence_histogram(rows: DataFrame, confidence: str = "confidence", bins: int = 30) -> DataFrame:
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
