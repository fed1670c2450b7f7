"""Search of atom triplets from its input on: samples of table rows or lines, their key files, the rows found, counters.

Samples have (line, nth, protein, grp, canon, kind, fault). ``fault`` is null, or ``conflict`` where a row's label is another one than
its identifier's, ``format`` where the key mode does not take the identifier, or ``unparsable`` where a row has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from molkeys.functions.geometry import fenced
from molkeys.functions.identifiers import LABELS, canonical, clean, parse_identifier, without_label
from molkeys.scratch import written
from molkeys.sources import tables

from .labels import resolve_files
from .ranks import numbered
from .triplets import matches_atoms

CHAIN, RESIDUE, CROSS, AUTO = "chain", "no_chain", "cross", "auto"
#: The kinds of identifiers that a key mode takes.
KINDS = {CHAIN: ("PDB_CHAIN", "PDB_CHAIN_GROUP"), RESIDUE: ("PDB_CHAIN_SEQ_RESIDUE",)}
KINDS |= dict.fromkeys((CROSS, AUTO), KINDS[CHAIN] + KINDS[RESIDUE])
# Names of columns, compared by letters and digits.
NAMES = {
    "identifier": ("identifier", "protein_identifier", "protein_name", "protein"),
    "protein": ("protein", "pdb", "pdb_id", "protein_id"),
    "chain": ("chain", "chain_id", "carb_chain"),
    "residue": ("carb_name", "carb", "aa", "residue", "residue_name", "resname", "entity_name"),
    "seq": ("carb_id", "carb_res", "seq_num", "resnumber", "residue_number", "res_seq", "seq"),
    "code": ("chain_group", "group_code", "ligand_group", "ligands_code"),
    "grp": ("group", "label", "class"),
}
FIRST_NAMES = ("protein", "proteinname", "identifier", "proteinidentifier", "pdb", "pdbid")
HEADER_NAMES = ("protein", "chain", "carbname", "carbid", "seqnum", "resnumber", "group", "identifier")
SAMPLE = ("line", "nth", "protein", "grp", "canon", "kind", "fault")


def _folded(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[^\\p{L}\\p{N}]", "")


def _value(rows: DataFrame, role: str) -> Column:
    """The first column of a role; empty where there is none."""
    names = {"".join(filter(str.isalnum, n)) for n in NAMES[role]}
    hit = next((c for c in rows.columns if "".join(filter(str.isalnum, c.lower())) in names), None)
    return F.lit("") if hit is None else clean(F.col(f"`{hit}`"))


def structured_identifiers(rows: DataFrame, mode: str = AUTO) -> Column:
    """The identifiers that the columns of a row make up; none without protein or chain."""
    protein, chain, residue, seqs, code = (_value(rows, r) for r in ("protein", "chain", "residue", "seq", "code"))
    numbers = F.filter(F.transform(F.split(seqs, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    of_chain = F.when(code != "", F.array(F.concat_ws("_", protein, chain, code))).otherwise(F.array(F.concat_ws("_", protein, chain)))
    if mode != CHAIN:
        of_chain = F.when((residue != "") & (seqs != ""), F.transform(numbers, lambda n: F.concat_ws("_", protein, chain, n, residue))).otherwise(of_chain)
    return F.when((protein != "") & (chain != ""), of_chain).otherwise(F.array().cast("array<string>"))


def _samples(rows: DataFrame, mode: str) -> DataFrame:
    """Samples of (line, nth, identifier, explicit); a null identifier is unparsable."""
    p = parse_identifier(F.col("identifier"))
    explicit = F.when(F.upper("explicit").isin(*LABELS), F.upper("explicit")).otherwise(F.col("explicit"))
    # behind a fence, since the optimizer inlines the parse into each use of a field
    parsed = fenced(rows.select("line", "nth", "identifier", explicit.alias("explicit")), p=p)
    conflict = (F.col("explicit") != "") & (F.col("p.label") != "") & (F.upper("explicit") != F.col("p.label"))
    fault = F.when(F.col("identifier").isNull(), "unparsable").when(conflict, "conflict").when(~F.col("p.kind").isin(*KINDS[mode]), "format")
    group = F.when(F.col("explicit") != "", F.col("explicit")).otherwise(F.col("p.label"))
    out = parsed.select("line", "nth", without_label(F.col("identifier")).alias("protein"), group.alias("grp"), canonical(F.col("p"), F.col("identifier")).alias("canon"), F.col("p.kind").alias("kind"), fault.alias("fault"))
    good = out.where("fault is null")
    # of equal samples the first has the place, the last the text
    at = F.struct("line", "nth")
    kept = good.groupBy("canon", "grp", "kind").agg(F.min(at).alias("at"), F.max_by("protein", at).alias("protein"))
    kept = kept.select("at.line", "at.nth", "protein", "grp", "canon", "kind", F.lit(None).cast("string").alias("fault"))
    return kept.unionByName(out.where("fault is not null")).select(*SAMPLE)


def samples_of_rows(rows: DataFrame, line: str, mode: str = AUTO) -> DataFrame:
    """Samples of table rows with text columns of any known names: the identifier's column if the mode takes it, else what the other columns make up.

    Rows that are empty throughout are skipped.
    """
    data = [c for c in rows.columns if c != line]
    filled = F.lit(False)
    for c in data:
        filled = filled | (clean(F.col(f"`{c}`")) != "")
    of_data = rows.select(*[f"`{c}`" for c in data])
    whole = _value(of_data, "identifier")
    taken = (whole != "") & parse_identifier(whole)["kind"].isin(*KINDS[mode])
    made = F.when(taken, F.array(whole)).otherwise(structured_identifiers(of_data, mode))
    one = rows.where(filled).select(F.col(f"`{line}`").cast("long").alias("line"), _value(of_data, "grp").alias("explicit"), F.posexplode_outer(made).alias("nth", "identifier"))
    return _samples(one, mode)


def first_field(line: Column) -> Column:
    """What stands before the first semicolon, or else the first field of a CSV line."""
    return F.trim(F.when(line.contains(";"), F.substring_index(line, ";", 1)).otherwise(F.coalesce(F.from_csv(line, "f string")["f"], F.lit(""))))


def samples_of_lines(lines: DataFrame, mode: str = AUTO, header: bool = True) -> DataFrame:
    """Samples of the first fields of lines (ln, line) without a header; ``header`` skips a first line that names the protein."""
    rows = lines.select(F.col("ln").cast("long").alias("line"), F.lit(0).alias("nth"), first_field(F.col("line")).alias("identifier"), F.lit("").alias("explicit")).where("identifier <> ''")
    if header:
        rows = rows.where(~((F.col("line") == 0) & F.upper("identifier").isin("PROTEIN", "PROTEIN NAME")))
    return _samples(rows, mode)


def is_header(line: Column) -> Column:
    """Whether a search input's first line names columns."""
    first = first_field(line)
    names = F.transform(F.split(F.replace(line, F.lit(";"), F.lit(",")), ","), _folded)
    known = F.arrays_overlap(names, F.array(*[F.lit(n) for n in HEADER_NAMES]))
    return _folded(first).isin(*FIRST_NAMES) | (known & (parse_identifier(first)["kind"] == "RAW"))


def read_samples(spark: SparkSession, path: str, mode: str = AUTO) -> DataFrame:
    """Samples of a search input, a table with a header or lines."""
    text = spark.read.text(path).where(F.trim("value") != "").limit(1).select(is_header(F.col("value")).alias("h")).first()
    if text is not None and text.h:
        # a table's rows are numbered in the order of their bytes, the header not counted
        rows = written(tables.read_strings(spark, path).select("*", F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id")), "rows")
        rows = numbered(rows, [F.col("_start"), F.col("_id")], name="_line").drop("_start", "_id")
        return _some(samples_of_rows(rows, "_line", mode), path)
    return _some(samples_of_lines(tables.numbered_lines(spark, path).select("ln", "line"), mode, header=False), path)


def _some(samples: DataFrame, path: str) -> DataFrame:
    if samples.isEmpty():
        raise ValueError(f"no samples in {path}")
    return samples


def strict(samples: DataFrame) -> DataFrame:
    """The samples, with an error for the first faulty one that is read."""
    return samples.withColumn("canon", F.when(F.col("fault").isNull(), F.col("canon")).otherwise(F.raise_error(F.concat(F.lit("sample of line "), F.col("line").cast("string"), F.lit(": "), "fault"))))


def resolved_samples(samples: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples with their files, counters of samples by outcome) of files (key, file_label, file)."""
    resolved = resolve_files(samples.where("fault is null").select(F.col("canon").alias("key"), F.col("grp").alias("label")), files)
    status = lambda s, n: F.count_if(F.col("status") == s).alias(n)
    counters = resolved.agg(F.count("*").alias("samples"), status("resolved", "key_files_found"), status("missing", "key_files_missing"), status("ambiguous", "ambiguous_key_files"))
    return resolved.where("status = 'resolved'").select("file", F.col("key").alias("sample"), F.col("label").alias("grp")), counters


def search(samples: DataFrame, lines: DataFrame, wanted: list[str], layout: str = "auto", ignore_suffix: bool = False, files: DataFrame | None = None) -> tuple[DataFrame, Observation, DataFrame]:
    """(rows found, observed, counters of samples) of samples in lines (key, file_label, file, line) of key files; key is the canonical identifier.

    The lines are read once: rows_read, rows_matched and malformed_rows are counted on their way to the rows found, and are there when those have
    been read (see ``counters``). Files (key, file_label, file) come from a directory's listing, or else from a scan of these columns.
    Each sample reads its file, so a file that several samples resolve to counts for each.
    """
    files = lines.select("key", "file_label", "file").distinct() if files is None else files
    found, of_samples = resolved_samples(samples, files)
    read = lines.where(F.trim("line") != "").select("file", "line").join(found, "file")
    rows = tables.key_rows(read, layout=layout)
    hit = (F.col("layout") != "malformed") & matches_atoms(F.col("atom1"), F.col("atom2"), F.col("atom3"), wanted, ignore_suffix)
    rows = rows.withColumn("hit", F.coalesce(hit, F.lit(False)))
    observed = Observation()
    rows = rows.observe(observed, F.count_if(F.col("layout") != "malformed").alias("rows_read"), F.count_if("hit").alias("rows_matched"), F.count_if(F.col("layout") == "malformed").alias("malformed_rows"))
    return rows.where("hit").drop("hit", "line"), observed, of_samples


def counters(found: DataFrame, observed: Observation, of_samples: DataFrame) -> DataFrame:
    """One row with all counters of a search; reads the rows found once, without keeping them."""
    found.write.format("noop").mode("overwrite").save()
    return of_samples.select("*", *[F.lit(int(observed.get.get(n) or 0)).cast("bigint").alias(n) for n in ("rows_read", "rows_matched", "malformed_rows")])
