"""Exact quantiles of many columns at once, by selection over their values in long form.

Each wanted order statistic of a column has a bracket of values that holds it. A pass counts the values of all brackets in bins, keeps
the bin that the statistic is in, and its bracket becomes the smallest and largest value there. Counts are taken before the shuffle, so what moves is
some rows for each column and task, whatever the number of rows. When a bracket holds one value, or few, it is read off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molkeys.scratch import written

BINS = 256
#: Values of a bracket that are sorted in one task rather than counted again.
FEW = 4096


def long_form(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(c, v): the place of a column in the list, and its values. Nulls and values that are not finite are missing."""
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    return rows.select(F.posexplode(values).alias("c", "v")).where("v is not null and not isnan(v) and abs(v) < double('Infinity')")


def exact_quantiles(rows: DataFrame, columns: list[str], shares: list[float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """(column, share, value) with linear interpolation between neighbours; a column without values has no rows."""
    long = long_form(rows, columns)
    totals = long.groupBy("c").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("share"), (F.lit(float(p)) * (F.col("n") - 1)).alias("pos")) for p in shares]))
    wanted = written(totals.select("c", "n", "lo", "hi", at.alias("w")).select("c", "n", "lo", "hi", "w.share", F.floor("w.pos").alias("low"), F.ceil("w.pos").alias("high"), (F.col("w.pos") - F.floor("w.pos")).alias("part")), "quantiles")
    ranks = wanted.select("c", "n", "lo", "hi", F.explode(F.array_distinct(F.array("low", "high"))).alias("rank")).distinct()
    state = written(ranks.select("c", "rank", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside"), "lo", "hi"), "brackets")

    def held(some: DataFrame) -> DataFrame:
        # as many rows as wanted statistics of columns, which the plan itself lists
        return long.join(F.broadcast(some), "c").where("v between lo and hi")

    wide = f"lo < hi and inside > {int(few)}"
    while not state.where(wide).isEmpty():
        # halves, so that the width of a bracket does not overflow
        place = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        counts = held(state.where(wide)).groupBy("c", "rank", "below", F.least(F.floor(place * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("k"), F.min("v").alias("l"), F.max("v").alias("h"))
        before = F.sum("k").over(Window.partitionBy("c", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("k")
        hit = counts.withColumn("b", before).where("rank - below >= b and rank - below < b + k")
        state = written(hit.select("c", "rank", (F.col("below") + F.col("b")).alias("below"), F.col("k").alias("inside"), F.col("l").alias("lo"), F.col("h").alias("hi")).unionByName(state.where(f"not ({wide})")), "brackets")
    read = held(state.where("lo < hi")).groupBy("c", "rank", "below").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    found = read.select("c", "rank", F.get("vs", (F.col("rank") - F.col("below")).cast("int")).alias("v")).unionByName(state.where("lo = hi").select("c", "rank", F.col("lo").alias("v")))
    found = written(found, "statistics")
    low, high = (found.select("c", F.col("rank").alias(r), F.col("v").alias(f"v_{r}")) for r in ("low", "high"))
    value = F.when(F.col("part") == 0, F.col("v_low")).otherwise(F.col("v_low") + F.col("part") * (F.col("v_high") - F.col("v_low")))
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("c") + 1)
    return wanted.join(low, ["c", "low"]).join(high, ["c", "high"]).select(name.alias("column"), "share", value.alias("value"))
