"""Key frequencies across samples: feature tables, common keys, occurrence percentages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_per_key(freq: DataFrame, line: str, sample: str = "sample") -> DataFrame:
    """The last line of a repeated key counts."""
    return freq.groupBy(sample, "key").agg(F.max_by("freq", line).alias("freq"))


#: Columns of a table, as many as plans of a wide table bear.
MOST_COLUMNS = 20_000


def feature_table(freq: DataFrame, sample: str = "sample", keys: list[int] | None = None) -> DataFrame:
    """One row a sample and one column a key, in the order of the keys as text; missing is 0.

    Without ``keys`` all distinct keys become columns; more than ``MOST_COLUMNS`` are an error, for which ``feature_maps`` is the form.
    """
    if keys is None:
        found = freq.select("key").distinct().limit(MOST_COLUMNS + 1).collect()
        if len(found) > MOST_COLUMNS:
            raise ValueError("too many keys for columns; use feature_maps")
        keys = sorted((r.key for r in found), key=str)
    return freq.groupBy(sample).pivot("key", keys).agg(F.first("freq")).na.fill(0)


def feature_maps(freq: DataFrame, sample: str = "sample") -> DataFrame:
    """One map a sample: the sparse form of the feature table, of any width."""
    return freq.groupBy(sample).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "freq")))).alias("features"))


def common_keys(freq: DataFrame, group: list[str] = (), sample: str = "sample") -> DataFrame:
    """(group, key): keys that all samples of a group have: the true intersection, which is empty where a sample shares nothing."""
    group = list(group)
    per_key = freq.groupBy(*group, "key").agg(F.countDistinct(sample).alias("n"))
    total = freq.groupBy(*group).agg(F.countDistinct(sample).alias("total"))
    joined = per_key.join(total, group) if group else per_key.crossJoin(F.broadcast(total))  # a single row
    return joined.where("n = total").select(*group, "key")


def common_key_summary(freq: DataFrame, group: list[str] = (), sample: str = "sample") -> DataFrame:
    """Per sample: its keys, how many of them are common, and their summed frequency."""
    group = list(group)
    shared = common_keys(freq, group, sample).withColumn("shared", F.lit(True))
    rows = freq.join(shared, [*group, "key"], "left")
    hit = F.col("shared").isNotNull()
    return rows.groupBy(*group, sample).agg(F.countDistinct("key").alias("total_keys"), F.countDistinct(F.when(hit, F.col("key"))).alias("common_keys"), F.coalesce(F.sum(F.when(hit, F.col("freq"))), F.lit(0)).alias("common_freq"))


def key_percent(freq: DataFrame, group: str, sample: str = "sample") -> DataFrame:
    """Share of a group's samples with a line for the key, in percent to three places, half to even; repeated lines count."""
    total = freq.groupBy(group).agg(F.countDistinct(sample).alias("total_files"))
    rows = freq.groupBy(group, "key").agg(F.count("*").alias("key_occurrence"))
    return rows.join(total, group).withColumn("key_percent", F.bround(F.col("key_occurrence") / F.col("total_files") * 100, 3))


def one_vs_all(freq: DataFrame, group: str, groups: list[str], sample: str = "sample") -> DataFrame:
    """One row a key with the percentage of every group, 0 where it has none."""
    rows = key_percent(freq, group, sample).groupBy("key").pivot(group, groups).agg(F.first("key_percent")).na.fill(0.0)
    return rows.select("key", *[F.col(g).alias(f"{g}_key%") for g in groups])
