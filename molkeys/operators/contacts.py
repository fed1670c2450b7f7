"""Contacts between two sets of atoms of a structure, and labels by the nearest one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molkeys.functions.geometry import fenced
from molkeys.functions.identifiers import atom_id_parts, half_even, interaction_label


def contacts(left: DataFrame, right: DataFrame, cut: float = 3.0, by: str = "pdb") -> DataFrame:
    """(by, columns of both sides prefixed l_ and r_, distance) of pairs within the cut.

    A grid with cells as wide as the cut turns the distance into an equi-join: a left atom meets the 27 cells around it.
    """
    cell = lambda c: F.floor(F.col(c) / cut).cast("long")
    names = lambda df, p: df.select(F.col(by), *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != by])
    a = names(left, "l").withColumns({"cx": cell("l_x"), "cy": cell("l_y"), "cz": cell("l_z")})
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    a = a.withColumn("s", F.explode(steps)).withColumns({"cx": F.col("cx") + F.col("s.i"), "cy": F.col("cy") + F.col("s.j"), "cz": F.col("cz") + F.col("s.k")}).drop("s")
    b = names(right, "r").withColumns({"cx": cell("r_x"), "cy": cell("r_y"), "cz": cell("r_z")})
    d = F.sqrt(F.pow(F.col("l_x") - F.col("r_x"), 2) + F.pow(F.col("l_y") - F.col("r_y"), 2) + F.pow(F.col("l_z") - F.col("r_z"), 2))
    return a.join(b, [by, "cx", "cy", "cz"]).drop("cx", "cy", "cz").withColumn("distance", d).where(F.col("distance") <= cut)


def component_interactions(rows: DataFrame, component: str, atom: str = "drug", distance: str = "distance", line: str = "line") -> DataFrame:
    """(protein, chain, carb_name, carb_res, min_distance, label, line) of a contact table's atoms of one component, in any case.

    Distances count as the table has them; one that is no number is an error. ``line`` is where a residue comes first.
    """
    p = atom_id_parts(F.col(atom))
    bad = F.raise_error(F.concat(F.lit("bad distance of line "), F.col(line).cast("string")))
    own = fenced(rows, p=p).where(F.upper("p.res") == component.upper())
    value = F.coalesce(F.col(distance).cast("string").try_cast("double"), bad)
    low = own.groupBy(F.col("p.pdb").alias("protein"), F.col("p.chain").alias("chain"), F.col("p.res").alias("carb_name"), F.col("p.resnum").alias("carb_res")).agg(F.min(value).alias("min_distance"), F.min(line).alias("line"))
    return low.withColumn("label", interaction_label(F.col("min_distance")))


def nearest_labels(rows: DataFrame, residue: list[str], distance: str = "distance", ci: float = 1.5, wci: float = 2.0) -> DataFrame:
    """Per residue: the smallest distance, rounded to a tenth as contact tables hold it, and its label."""
    low = rows.groupBy(*residue).agg(F.min(half_even(F.col(distance), 1).cast("double")).alias("min_distance"))
    return low.withColumn("label", interaction_label(F.col("min_distance"), ci, wci))
