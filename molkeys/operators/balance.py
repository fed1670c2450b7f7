"""Balance of classes in training rows: copies, interpolated rows, and removal of rows that their neighbours contradict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molkeys.scratch import written

from .labels import class_counts
from .neighbours import nearest
from .ranks import draw, numbered


def balance_oversample(rows: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Copies of rows until each class has the size of the largest; which rows get one more is by hash. ``copy`` counts from 1."""
    most = class_counts(rows, label).agg(F.max("n").alias("_most"))
    out = numbered(rows, [draw(seed, key), F.col(key)], [label], "_p", "_n").crossJoin(F.broadcast(most))  # a single row
    copies = F.floor(F.col("_most") / F.col("_n")) + (F.col("_p") <= F.col("_most") % F.col("_n")).cast("int")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("_n", "_most", "_p")


def share(seed: int, *keys: str) -> Column:
    """A number from 0 up to 1 that depends on a seed and keys alone."""
    return F.conv(F.substring(draw(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def smote(rows: DataFrame, label: str, key: str, vector: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(label, key, copy, vector): rows, of copy 0, and interpolated ones until each class has the size of the largest.

    ``vector`` is an array of doubles. An interpolated row lies between a row and one of its k nearest of the class; k is the smallest class
    less one if that is smaller, and a class of one row is an error. Rows take their turns in a random order.
    """
    rows = rows.select(F.col(label).alias("label"), F.col(key).alias("key"), F.col(vector).alias("v"))
    counts = class_counts(rows, "label")
    most, smallest = counts.agg(F.max("n"), F.min("n")).first()
    keep = rows.select("label", "key", F.lit(0).alias("copy"), "v")
    if most is None or most == smallest:
        return keep.toDF(label, key, "copy", vector)
    k = min(k, smallest - 1)
    if k < 1:
        raise ValueError("interpolation needs two rows in every class")
    small = rows.join(counts.where(F.col("n") < most), "label").drop("n")
    placed = numbered(small, [draw(seed, "key"), F.col("key")], ["label"], "p", "n")
    need = F.lit(most) - F.col("n")
    turns = F.floor(need / F.col("n")) + (F.col("p") <= need % F.col("n")).cast("int")
    base = written(placed.withColumn("turns", turns).where("turns > 0"), "base")
    near = nearest(base, small, k, "key", "v", "label").select(F.col("key").alias("of"), "rank", "neighbour")
    made = base.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("turns").cast("int"))))
    made = made.withColumns({"pick": F.least(F.floor(share(seed + 1, "key", "copy") * k), F.lit(k - 1)).cast("int") + 1, "s": share(seed + 2, "key", "copy")})
    other = small.select(F.col("key").alias("neighbour"), F.col("v").alias("w"))
    made = made.join(near, (F.col("key") == F.col("of")) & (F.col("pick") == F.col("rank"))).join(other, "neighbour")
    between = F.zip_with("v", "w", lambda a, b: a + F.col("s") * (b - a))
    return keep.unionByName(made.select("label", "key", "copy", between.alias("v"))).toDF(label, key, "copy", vector)


def edited(rows: DataFrame, label: str, key: str, vector: str, k: int = 3, rule: str = "all") -> DataFrame:
    """The rows whose k nearest agree with their label: all of them, or (rule ``mode``) the most frequent label, ties to the smallest.

    A row without neighbours stays.
    """
    if rule not in ("all", "mode"):
        raise ValueError(f"unknown rule {rule}")
    names = rows.select(F.col(key).alias("neighbour"), F.col(label).alias("theirs"))
    votes = nearest(rows, rows, k, key, vector).join(names, "neighbour").groupBy(key, "theirs").agg(F.count("*").alias("n"))
    # of k votes the winner, and how many labels there were
    won = votes.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "theirs"))["theirs"].alias("theirs"), F.count("*").alias("kinds"))
    gone = (F.col("theirs") != F.col(label)) | ((F.col("kinds") > 1) if rule == "all" else F.lit(False))
    out = rows.join(won, key, "left").where(~F.coalesce(gone, F.lit(False)))
    return out.select(*rows.columns)


def smote_edited(rows: DataFrame, label: str, key: str, vector: str, k: int = 5, edit_k: int = 3, seed: int = 42) -> DataFrame:
    """(label, key, copy, vector) after interpolation and then removal of rows that a neighbour contradicts."""
    made = written(smote(rows, label, key, vector, k, seed).withColumn("_id", F.concat_ws("/", F.col(key).cast("string"), F.col("copy").cast("string"))), "balanced")
    return edited(made, label, "_id", vector, edit_k).drop("_id")
