"""From a sample table and structure lines to keys: targets, their atoms, key records and the run's summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molkeys.functions.identifiers import clean, natural_key, sorted_join
from molkeys.sources import structures

from . import triplets

TARGET = ("identifier", "protein", "chain", "name", "seq", "summary_names", "summary_seqs", "line")


def _rows(rows: DataFrame) -> DataFrame:
    """Clean text columns and the numbers of a row, in their order and with repeats."""
    names = [c for c in ("protein", "chain", "name", "seq") if c in rows.columns]
    rows = rows.select(F.col("line").cast("long"), *[clean(F.col(c)).alias(c) for c in names])
    for c in {"name", "seq"} - set(names):
        rows = rows.withColumn(c, F.lit(""))
    numbers = F.filter(F.transform(F.split("seq", ";"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.withColumn("seqs", numbers).where("protein <> '' and chain <> ''")


def residue_targets(rows: DataFrame) -> DataFrame:
    """A target for each residue that a row (line, protein, chain, name, seq) names; ``seq`` may be a list cut at semicolons.

    Rows without protein, chain, name or number give none; repeated rows give repeated targets.
    """
    one = _rows(rows).where("name <> ''").select("line", "protein", "chain", "name", F.explode("seqs").alias("seq"))
    identifier = F.concat_ws("_", "protein", "chain", "seq", "name")
    return one.withColumns({"identifier": identifier, "summary_names": F.col("name"), "summary_seqs": F.col("seq")}).select(*TARGET)


def chain_targets(rows: DataFrame) -> DataFrame:
    """A target for each protein and chain; names in the order of their numbers, with repeats, and the distinct numbers go to the summary."""
    rows = _rows(rows)
    pairs = rows.where("name <> ''").select("line", "protein", "chain", "name", F.posexplode("seqs").alias("nth", "seq"))
    ordered = F.array_sort(F.collect_list(F.struct(natural_key(F.col("seq")).alias("k"), "line", "nth", "name")))
    of_pairs = pairs.groupBy("protein", "chain").agg(F.array_join(F.transform(ordered, lambda x: x["name"]), ",").alias("summary_names"), sorted_join(F.collect_set("seq"), natural_key, ",").alias("summary_seqs"))
    out = rows.groupBy("protein", "chain").agg(F.min("line").alias("line")).join(of_pairs, ["protein", "chain"], "left").na.fill("", ["summary_names", "summary_seqs"])
    none = F.lit(None).cast("string")
    return out.withColumns({"identifier": F.concat_ws("_", "protein", "chain"), "name": none, "seq": none}).select(*TARGET)


def target_atoms(lines: DataFrame, targets: DataFrame, kind: str = "ligand") -> DataFrame:
    """Atoms (identifier, ln, label, ...) of the structures that targets name: those of a residue, or of a whole chain where name is null.

    Chains are compared as written. Repeated targets give their atoms once.
    """
    atoms = structures.key_atoms(lines, kind)
    wanted = targets.select("identifier", F.upper("protein").alias("pdb"), "chain", F.col("name").alias("t_name"), F.col("seq").alias("t_seq")).dropDuplicates(["identifier"])
    of_chains = atoms.join(wanted.where("t_name is null"), ["pdb", "chain"])
    residue = wanted.where("t_name is not null").withColumns({"res": F.col("t_name"), "seq": F.col("t_seq")})
    of_residues = atoms.join(residue, ["pdb", "chain", "res", "seq"])
    columns = ["identifier", *atoms.columns]
    return of_chains.select(*columns).unionByName(of_residues.select(*columns))


def target_keys(lines: DataFrame, targets: DataFrame, lexical: DataFrame, kind: str = "ligand", mirror: bool = False, expected: DataFrame | None = None) -> DataFrame:
    """The triplets of each target with their keys; ``expected`` (res, expected) drops residues with another number of atoms.

    ``lexical`` (name, code) holds the codes of atom labels; atoms without one go.
    """
    atoms = structures.with_codes(target_atoms(lines, targets, kind), lexical)
    if expected is not None:
        atoms = triplets.atom_count_filter(atoms, expected, ["identifier", "chain", "res", "seq"])
    return triplets.triplet_keys(atoms, ["identifier"], order="ln", carry=("label", "raw_seq"), mirror=mirror)


def key_records(keys: DataFrame) -> DataFrame:
    """The twenty fields of a key line: key, label and five-character number of each vertex, bins, angle, side and coordinates."""
    vertices = [F.col(f"v{v}_{source}").alias(f"{name}{v}") for v in (1, 2, 3) for source, name in (("label", "atom"), ("raw_seq", "seq"))]
    places = [F.col(f"v{v}_{c}").alias(f"{c}{v}") for v in (1, 2, 3) for c in "xyz"]
    return keys.where("error is null").select("identifier", "key", *vertices, "theta_bin", "theta", "dist_bin", "max_dist", *places)


def run_summary(keys: DataFrame, atoms: DataFrame, targets: DataFrame) -> DataFrame:
    """The nine columns of a run's summary, once for each different row, with the line by which they are ordered."""
    counts = triplets.summaries(keys, atoms, ["identifier"])
    rows = targets.select("identifier", "summary_names", "chain", "summary_seqs", "line").join(counts, "identifier")
    columns = ["identifier", "n_atoms", "n_triplets", "n_keys", "max_distance", "min_distance", "summary_names", "chain", "summary_seqs"]
    return rows.groupBy(*columns).agg(F.min("line").alias("line"))
