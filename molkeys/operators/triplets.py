"""Atom triplets: enumeration, keys, frequencies and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molkeys.functions import geometry

ATOM = ("code", "x", "y", "z")


#: Atoms of an index block; a group of more is cut into blocks.
BLOCK = 64


def enumerate_triplets(atoms: DataFrame, by: list[str], order: str = "idx", carry: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """(by, a_*, b_*, c_*): all i < j < k of each group in order, as flat columns of the three atoms.

    A group becomes one array. One of at most ``block`` atoms is enumerated where it is. A larger one is cut into blocks, and each triple of
    blocks, with the atoms of its own three, is dealt to a task by itself, so a chain of thousands of atoms is spread over the cluster and no
    row holds more than three blocks. Groups of less than three atoms give nothing.
    """
    atom = F.struct(order, *ATOM, *carry)
    groups = atoms.groupBy(*by).agg(F.array_sort(F.collect_list(atom)).alias("atoms")).where(F.size("atoms") >= 3)
    zero = F.lit(0)
    small = groups.where(F.size("atoms") <= block).select(*by, zero.alias("ua"), zero.alias("ub"), zero.alias("uc"), *[F.col("atoms").alias(p) for p in ("pa", "pb", "pc")])

    cut = F.transform(F.sequence(zero, F.floor((F.size("atoms") - 1) / block).cast("int")), lambda u: F.slice("atoms", u * block + 1, block))
    large = groups.where(F.size("atoms") > block).select(*by, cut.alias("blocks")).select(*by, "blocks", F.posexplode("blocks").alias("ua", "pa"))
    large = large.select(*by, "blocks", "ua", "pa", F.explode(F.sequence("ua", F.size("blocks") - 1)).alias("ub"))
    later = F.slice("blocks", F.col("ub") + 1, F.size("blocks"))
    large = large.select(*by, "ua", "ub", "pa", F.get("blocks", F.col("ub")).alias("pb"), F.posexplode(later).alias("du", "pc"))
    # a fixed number, since units are small beside the rows that they make, and adaptive execution would put them together
    tasks = int(atoms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = large.select(*by, "ua", "ub", (F.col("ub") + F.col("du")).alias("uc"), "pa", "pb", "pc").repartition(tasks, *by, "ua", "ub", "uc")

    units = small.unionByName(large)
    first = units.select(*by, "ua", "ub", "uc", "pb", "pc", F.posexplode("pa").alias("i", "a"))
    # of one block with itself only what comes later
    same = F.col("ua") == F.col("ub")
    behind = F.when(same, F.slice("pb", F.col("i") + 2, block)).otherwise(F.col("pb"))
    second = first.select(*by, "ub", "uc", "a", "pc", F.when(same, F.col("i") + 1).otherwise(0).alias("skip"), F.posexplode(behind).alias("j", "b"))
    last = F.when(F.col("ub") == F.col("uc"), F.slice("pc", F.col("skip") + F.col("j") + 2, block)).otherwise(F.col("pc"))
    third = second.select(*by, "a", "b", F.explode(last).alias("c"))
    return third.select(*by, *[F.col(f"{p}.{k}").alias(f"{p}_{k}") for p in "abc" for k in (order, *ATOM, *carry)])


def triplet_keys(atoms: DataFrame, by: list[str], order: str = "idx", carry: tuple[str, ...] = (), mirror: bool = False, lenient: bool = False) -> DataFrame:
    """One row a triplet with its vertices in key order, bins, key and error."""
    rows = enumerate_triplets(atoms, by, order, carry)
    return geometry.key_columns(geometry.with_vertices(rows, by, carry), mirror, lenient)


def key_frequency(keys: DataFrame, by: list[str]) -> DataFrame:
    return keys.where("error is null").groupBy(*by, "key").agg(F.count("*").alias("freq"))


def summaries(keys: DataFrame, atoms: DataFrame, by: list[str]) -> DataFrame:
    """Per sample: atoms, triplets, distinct keys, largest and smallest longest side."""
    of_keys = keys.where("error is null").groupBy(*by).agg(F.count("*").alias("n_triplets"), F.countDistinct("key").alias("n_keys"), F.max("max_dist").alias("max_distance"), F.min("max_dist").alias("min_distance"))
    return atoms.groupBy(*by).agg(F.count("*").alias("n_atoms")).join(of_keys, by)


def drop_small(atoms: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Groups of at least so many atoms, without a window over a whole group."""
    return atoms.join(atoms.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*by), by, "left_semi")


def atom_count_filter(atoms: DataFrame, expected: DataFrame, instance: list[str], name: str = "res") -> DataFrame:
    """Atoms of instances whose count is the one expected of their name; unknown names go."""
    counts = atoms.groupBy(*instance).agg(F.count("*").alias("n_found"))
    right = counts.join(F.broadcast(expected.select(F.upper(name).alias("expected_name"), "expected")), F.upper(name) == F.col("expected_name")).where("n_found = expected").select(*instance)
    return atoms.join(right, instance, "left_semi")


def matches_atoms(a: Column, b: Column, c: Column, wanted: list[str], ignore_suffix: bool = False) -> Column:
    """Whether three atom names are the wanted ones as a multiset; an ending _P or _D may be ignored."""
    strip = (lambda x: F.regexp_replace(x, "_[PD]$", "")) if ignore_suffix else (lambda x: x)
    names = F.array_sort(F.array(*[strip(F.upper(F.trim(x))) for x in (a, b, c)]))
    return names == F.array(*[F.lit(x) for x in sorted(w.strip().upper() for w in wanted)])
