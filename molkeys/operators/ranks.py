"""Places and running sums of rows in a global order, or in the order of their class, without a window that one task has to hold.

Rows are dealt by ranges of (class, order), so that each partition is one stretch of the whole order. The place of a row is its place
in its stretch and the rows of its class in the stretches before, which are a prefix sum over (stretch, class), a table of a few
rows a task. A class of any size is spread over as many tasks as its rows need. Running sums go the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molkeys.scratch import written


def _stretches(rows: DataFrame, order: list, by: list[str], values: dict[str, Column], of_class: dict[str, Column]) -> DataFrame:
    """Rows with running sums of ``values``, this row included, and with sums of ``of_class`` over the whole class."""
    keys = [f"_k{i}" for i in range(len(by))]
    pairs = [c if isinstance(c, tuple) else (c, Column.asc_nulls_first) for c in order]
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_own")
    all_values = [*values.values(), *of_class.values()]
    flat = rows.select(own, *[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], *[c.alias(f"_o{i}") for i, (c, _) in enumerate(pairs)], *[c.alias(f"_v{i}") for i, c in enumerate(all_values)])
    sorts = [direction(F.col(f"_o{i}")) for i, (_, direction) in enumerate(pairs)]
    dealt = flat.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *sorts).withColumn("_stretch", F.spark_partition_id())
    dealt = written(dealt, "stretches")
    sums = dealt.groupBy("_stretch", *keys).agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(all_values))])
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    upto = whole.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = len(values)
    starts = sums.select(F.col("_stretch").alias("_s"), *[F.col(k).alias(f"{k}s") for k in keys], *[(F.sum(f"_t{i}").over(upto) - F.col(f"_t{i}")).alias(f"_b{i}") for i in range(n)], *[F.sum(f"_t{i}").over(whole).alias(f"_b{i}") for i in range(n, len(all_values))])
    on = F.col("_stretch") == F.col("_s")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}s"))
    here = Window.partitionBy("_stretch", *keys).orderBy(*sorts).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumns({f"_r{i}": F.sum(f"_v{i}").over(here) for i in range(n)}).join(starts, on)
    running = [(F.col(f"_b{i}") + F.col(f"_r{i}")).alias(name) for i, name in enumerate(values)]
    return placed.select("_own.*", *running, *[F.col(f"_b{i}").alias(name) for i, name in enumerate(of_class, n)])


def numbered(rows: DataFrame, order: list, by: list[str] = (), name: str = "place", size: str | None = None) -> DataFrame:
    """Rows with their place, from 1, in the order within ``by``, and the rows of their class where ``size`` names that column.

    An item of the order is an expression, ascending with nulls first, or a pair of one and a direction such as ``Column.desc``.
    The order should be one of distinct rows, as by a hash and a key: rows that tie in all of it keep any order among them, and
    rows of one class that tie are one stretch. Null is a class of its own.
    """
    return _stretches(rows, order, list(by), {name: F.lit(1).cast("long")}, {} if size is None else {size: F.lit(1).cast("long")})


def running_sums(rows: DataFrame, order: list, values: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """Rows with a running sum for each of ``values``, which are numbers without nulls."""
    return _stretches(rows, order, list(by), values, {})


def draw(seed: int, *keys: str | Column) -> Column:
    """A text by which rows are in a random order that depends on a seed and their keys alone."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))
