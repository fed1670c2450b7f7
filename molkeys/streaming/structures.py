"""Triplet keys of atoms that arrive as a stream of files: stateless up to the keys, counted per micro-batch.

A structure's atoms arrive in one row, so no state is kept between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molkeys.functions import geometry


def keys_of_arrays(rows: DataFrame, by: list[str], atoms: str = "atoms") -> DataFrame:
    """Keys of rows that hold all atoms of a structure as an ordered array; works on streams and tables."""
    n = F.size(atoms)
    first = rows.where(n >= 3).select(*by, F.col(atoms).alias("atoms"), F.explode(F.sequence(F.lit(0), n - 3)).alias("i"))
    second = first.select(*by, "atoms", "i", F.explode(F.sequence(F.col("i") + 1, F.size("atoms") - 2)).alias("j"))
    third = second.select(*by, F.get("atoms", F.col("i")).alias("a"), F.get("atoms", F.col("j")).alias("b"), F.explode(F.slice("atoms", F.col("j") + 2, F.size("atoms"))).alias("c"))
    third = third.select(*by, *[F.col(f"{p}.{k}").alias(f"{p}_{k}") for p in "abc" for k in ("code", "x", "y", "z")])
    return geometry.key_columns(geometry.with_vertices(third, by))


def stream_keys(source: DataFrame, path: str, checkpoint: str, by: list[str]):
    """Append the keys of arriving structures to a Parquet table; each file is read exactly once."""
    return keys_of_arrays(source, by).select(*by, "key", "theta_bin", "dist_bin", "max_dist", "error").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
