"""Residue tables: discovery labels, chains of linked residues, aggregated identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molkeys.functions.identifiers import chain_order, clean, insertion_key, natural_key, pdb_id, sorted_join, split_list
from molkeys.scratch import written
from molkeys.sources.tables import resolve

from .ranks import numbered

# The twenty standard amino acids.
AMINO_ACIDS = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split()


def record_name(component: Column) -> Column:
    """The record type that holds a component in automatic mode."""
    return F.when(F.upper(F.trim(component)).isin(*AMINO_ACIDS), "ATOM").otherwise("HETATM")


def discovery_labels(found: DataFrame, seeds: DataFrame, keys: list[str], include_missing: bool = False) -> DataFrame:
    """Residues of the structures labelled CI where a seed names them, else NCI; seeds without a residue can be kept."""
    known = seeds.select(*keys).distinct().withColumn("seed", F.lit(True))
    out = found.select(*keys).distinct().join(known, keys, "left").select(*keys, F.when(F.col("seed"), "CI").otherwise("NCI").alias("label"))
    return out.unionByName(missing_seeds(found, seeds, keys).withColumn("label", F.lit("CI"))) if include_missing else out


# Names of the columns of a seed table, the first that is there wins.
SEED_ROLES = {
    "pdb": ["protein", "pdb", "pdb_id", "entry_id", "identifier"],
    "chain": ["chain", "chain_id"],
    "name": ["aa", "carb", "carb_name", "residue", "residue_name", "ligand", "entity_name", "name"],
    "seq": ["resnumber", "seqnum", "carb_id", "residue_number", "residue_id", "seq_id"],
    "label": ["label", "lable", "class", "group"],
}


def seeds(rows: DataFrame, line: str, component: str, label: str = "CI") -> tuple[DataFrame, DataFrame]:
    """((line, pdb, chain, name, seq) of the seeds, counters) of a seed table with columns of any of the known names.

    Rows of another component, or with a label that is another one, are no seeds; without a column of names all rows are of the component. A number may
    be a list. counters: (rows_read, rows_used, rows_without_number).
    """
    columns = [c for c in rows.columns if c != line]
    found = {r: resolve(columns, r, names, rule="first", required=r in ("pdb", "chain", "seq")) for r, names in SEED_ROLES.items()}
    value = lambda r, default: F.lit(default) if found[r] is None else clean(F.col(f"`{found[r]}`"))
    read = rows.select(F.col(f"`{line}`").alias("line"), pdb_id(value("pdb", "")).alias("pdb"), value("chain", "").alias("chain"), F.upper(value("name", component)).alias("name"), split_list(value("seq", "")).alias("seqs"), F.upper(value("label", label)).alias("label"))
    own = (F.col("pdb") != "") & (F.col("name") == component.upper()) & F.col("label").isin("", label.upper())
    used = own & (F.size("seqs") > 0)
    counters = read.agg(F.count("*").alias("rows_read"), F.count_if(used).alias("rows_used"), F.count_if(own & (F.size("seqs") == 0)).alias("rows_without_number"))
    return read.where(used).select("line", "pdb", "chain", "name", F.explode("seqs").alias("seq")), counters


def in_label_order(rows: DataFrame, protein: str = "protein", chain: str = "chain", name: str = "aa", label: str = "label", seq: str | None = None) -> DataFrame:
    """Rows with their ``place``: by protein, CI before other labels, chain with blank ones last, number where given, and name."""
    first = F.when(F.upper(label) == "CI", 0).otherwise(1)
    order = [F.col(protein), first, chain_order(F.col(chain)), *([insertion_key(F.col(seq))] if seq else []), F.col(name), F.col(label)]
    return numbered(rows, order)


def merged_rows(rows: DataFrame, by: list[str], seqs: str = "seqs", separator: str = ";") -> DataFrame:
    """Rows of the same keys as one, with the numbers of all their lists in natural order."""
    return aggregate_residues(explode_residues(rows.select(*by, F.col(seqs).alias("seqs")), "seqs", separator), by, separator=separator)


def missing_seeds(found: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    return seeds.select(*keys).distinct().join(found, keys, "left_anti")


def aggregate_residues(rows: DataFrame, by: list[str], seq: str = "seq", separator: str = ";", insertion: bool = True) -> DataFrame:
    """One row a group with its distinct sequence numbers in natural order, joined."""
    key = insertion_key if insertion else natural_key
    return rows.groupBy(*by).agg(F.collect_set(seq).alias("seqs")).select(*by, sorted_join(F.col("seqs"), key, separator).alias("seqs"))


def explode_residues(rows: DataFrame, seqs: str = "seqs", separator: str = ";") -> DataFrame:
    """The inverse of ``aggregate_residues``."""
    parts = F.array_distinct(F.filter(F.transform(F.split(seqs, separator), lambda x: F.trim(x)), lambda x: x != ""))
    return rows.select(*[c for c in rows.columns if c != seqs], F.explode(parts).alias("seq"))


def ordered_names(rows: DataFrame, by: list[str], name: str, seq: str, order: str) -> DataFrame:
    """Names of a group by sequence number and row order, with repeats, joined by commas."""
    parts = F.array_sort(F.collect_list(F.struct(natural_key(F.col(seq)).alias("k"), F.col(order).alias("o"), F.col(name).alias("v"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x["v"]), ",").alias("names"))


def between_atoms(residues: DataFrame, chain_atoms: DataFrame, chain: list[str], seq: str = "seq") -> DataFrame:
    """Residues whose number lies strictly between the least and the greatest ATOM number of their chain."""
    key = insertion_key(F.col(seq))
    ends = chain_atoms.groupBy(*chain).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    return residues.join(ends, chain).where((key > F.col("low")) & (key < F.col("high"))).select(*residues.columns)


def linked(edges: DataFrame, seeds: DataFrame, allowed: DataFrame, node: str = "node", rounds: int = 50) -> DataFrame:
    """Nodes that links reach from the seeds through allowed nodes; the seeds are not part of it.

    Edges (a, b) go both ways. The frontier alone is joined in each round, and rounds end when it is empty. Each frontier is written once to the
    shared folder, and what has been reached is the union of the frontiers.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    step = both.join(allowed.select(F.col(node).alias("b")).distinct(), "b", "left_semi")
    frontier = step.join(seeds.select(F.col(node).alias("a")), "a", "left_semi").select(F.col("b").alias(node)).distinct()
    reached = None
    for _ in range(rounds):
        frontier = written(frontier, "frontier")
        if frontier.isEmpty():
            break
        reached = frontier if reached is None else reached.unionByName(frontier)
        frontier = step.join(frontier.withColumnRenamed(node, "a"), "a", "left_semi").select(F.col("b").alias(node)).distinct().join(reached, node, "left_anti")
    else:
        raise RuntimeError("links have not ended")
    return frontier if reached is None else reached


def choose_residues(residues: DataFrame, linked_nodes: DataFrame, heavy: DataFrame, mode: str = "auto", least_heavy: int = 1, by: str = "pdb", node: str = "node") -> DataFrame:
    """Residues that are linked, all, or linked where a structure has any (auto), with enough heavy atoms."""
    rows = residues.join(heavy.where(F.col("n_heavy") >= least_heavy).select(node), node, "left_semi")
    rows = rows.join(linked_nodes.select(node).distinct().withColumn("is_linked", F.lit(True)), node, "left").withColumn("is_linked", F.coalesce("is_linked", F.lit(False)))
    if mode == "all":
        return rows.drop("is_linked")
    if mode == "linked":
        return rows.where("is_linked").drop("is_linked")
    any_linked = rows.groupBy(by).agg(F.max("is_linked").alias("any_linked"))
    return rows.join(any_linked, by).where("is_linked or not any_linked").drop("is_linked", "any_linked")
