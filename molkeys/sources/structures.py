"""Fixed-width structure files as DataFrames.

Files are read whole and split, so that line order is known; ``.gz`` files are read by the text source. Rules that stop a scan
are window-free: the first stopping line of each file is one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Residues that are no ligands.
WATERS = ("HOH", "WAT", "DOD", "UNX")


def lines_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, pdb, ln, line) of all lines under the paths, in order."""
    name = F.regexp_extract(F.col("_metadata.file_name"), "([^/]+)$", 1)
    rows = spark.read.text(paths, wholetext=True).select(name.alias("file"), F.posexplode(F.split("value", "\\r?\\n")).alias("ln", "line"))
    pdb = F.upper(F.regexp_replace(F.regexp_replace("file", "(?i)\\.gz$", ""), "(?i)^(pdb)?(.*?)\\.(pdb|ent)$", "$2"))
    return rows.select("file", pdb.alias("pdb"), "ln", "line")


def first_model(lines: DataFrame, by: str = "pdb") -> DataFrame:
    """Lines before ENDMDL or the second MODEL."""
    model = F.when(F.substring("line", 1, 6).rlike("^MODEL\\s*$"), F.trim(F.substring("line", 11, 4)).try_cast("int"))
    stop = F.substring("line", 1, 6).startswith("ENDMDL") | (model > 1)
    ends = lines.where(stop).groupBy(by).agg(F.min("ln").alias("end"))
    return lines.join(ends, by, "left").where(F.col("end").isNull() | (F.col("ln") < F.col("end"))).drop("end")


def _cut(start: int, end: int) -> Column:
    """Python's [start:end] of the line."""
    return F.substring("line", start + 1, end - start)


def atom_lines(lines: DataFrame) -> DataFrame:
    """All ATOM and HETATM lines as typed columns; coordinates that cannot be read are null."""
    rows = lines.where(F.trim(_cut(0, 6)).isin("ATOM", "HETATM"))
    number = lambda a, b: F.trim(_cut(a, b)).try_cast("double")
    return rows.select(
        "pdb",
        "ln",
        F.trim(_cut(0, 6)).alias("record"),
        F.rtrim(_cut(13, 16)).alias("label"),
        F.trim(_cut(12, 16)).alias("atom"),
        F.trim(_cut(16, 17)).alias("alt"),
        F.trim(_cut(17, 20)).alias("res"),
        F.trim(_cut(21, 22)).alias("chain"),
        F.trim(_cut(22, 26)).alias("resnum"),
        F.trim(_cut(22, 27)).alias("seq"),
        _cut(22, 27).alias("raw_seq"),
        number(30, 38).alias("x"),
        number(38, 46).alias("y"),
        number(46, 54).alias("z"),
        F.trim(_cut(76, 78)).alias("element"),
        F.trim(_cut(77, 80)).alias("tail"),
    )


def key_atoms(lines: DataFrame, kind: str = "ligand") -> DataFrame:
    """Atoms for keys: first model, first alternative, no hydrogen by columns 78-80; ligands are HETATM, residues ATOM."""
    record = {"ligand": "HETATM", "residue": "ATOM"}[kind]
    rows = atom_lines(first_model(lines)).where(F.col("alt").isin("", "A") & (F.col("record") == record) & ~F.col("tail").isin("H", "D"))
    return rows.where("x is not null and y is not null and z is not null")


def contact_atoms(lines: DataFrame) -> DataFrame:
    """Atoms for contacts: all models and alternatives, no hydrogen, residue numbers without insertion code."""
    return atom_lines(lines).where(~F.col("element").isin("H", "D"))


def heavy(rows: DataFrame) -> Column:
    """Whether an atom is no hydrogen, by its element or else by the letters of its name."""
    letters = F.regexp_replace("atom", "[^A-Za-z]", "")
    return F.when(F.col("element") != "", ~F.upper("element").isin("H", "D")).otherwise(~F.upper(letters).rlike("^[HD]"))


def link_edges(lines: DataFrame) -> DataFrame:
    """(pdb, a, b): the residues that LINK records join, as structs of chain, name and number."""
    rows = first_model(lines).where(_cut(0, 6).startswith("LINK"))
    side = lambda a, b, c, d: F.struct(F.trim(_cut(b, b + 1)).alias("chain"), F.trim(_cut(a, a + 3)).alias("res"), F.trim(_cut(c, d)).alias("seq"))
    return rows.select("pdb", side(17, 21, 22, 27).alias("a"), side(47, 51, 52, 57).alias("b"))


def structure_tables(lines: DataFrame) -> dict[str, DataFrame]:
    """Residues of ATOM and of HETATM lines (no waters), heavy-atom counts, and links."""
    rows = atom_lines(first_model(lines))
    residue = ["pdb", "chain", "res", "seq"]
    het = rows.where((F.col("record") == "HETATM") & ~F.col("res").isin(*WATERS))
    return {
        "atom_residues": rows.where("record = 'ATOM'").select(*residue).distinct(),
        "het_residues": het.select(*residue).distinct(),
        "heavy": het.groupBy(*residue).agg(F.count_if(heavy(het)).alias("n_heavy")),
        "links": link_edges(lines),
    }


def matching_residues(lines: DataFrame, component: str, record: str = "auto") -> DataFrame:
    """(pdb, chain, res, seq) of one component in the first model."""
    from molkeys.operators.residues import record_name

    rows = atom_lines(first_model(lines)).where(F.upper("res") == component.strip().upper())
    wanted = {"atom": F.lit("ATOM"), "hetatm": F.lit("HETATM"), "auto": record_name(F.lit(component))}
    if record != "both":
        rows = rows.where(F.col("record") == wanted[record])
    return rows.select("pdb", "chain", "res", "seq").distinct()


# What a legacy file's telling line begins with, padded to six characters.
LEGACY = ("HEADER", "TITLE ", "COMPND", "SOURCE", "KEYWDS", "EXPDTA", "AUTHOR", "REVDAT", "JRNL  ", "REMARK", "SEQRES", "ATOM  ", "HETATM", "TER   ", "END   ")


def legacy_validity(lines: DataFrame, first: int = 200) -> DataFrame:
    """(file, valid): whether the first telling line among the first ones is of a legacy file; a marker tells before anything else in its line."""
    text = F.col("line")
    verdict = F.when(F.substring(text, 1, 6).isin(*LEGACY), True).when(text.startswith("data_") | text.contains("PDBx/mmCIF"), False)
    return lines.groupBy("file").agg(F.coalesce(F.min_by(verdict, F.when((F.col("ln") < first) & verdict.isNotNull(), F.col("ln"))), F.lit(False)).alias("valid"))


def availability(ids: DataFrame, files: DataFrame) -> DataFrame:
    """(pdb, status) of wanted ids against validated files (pdb, valid)."""
    rows = ids.select(F.upper(F.trim("pdb")).alias("pdb")).distinct().join(files.select("pdb", "valid"), "pdb", "left")
    status = F.when(F.col("pdb") == "", "empty_pdb_id").when(F.col("valid").isNull(), "missing_cached_pdb").when(F.col("valid"), "cached_legacy_pdb").otherwise("invalid_downloaded_pdb")
    return rows.select("pdb", status.alias("status"))


def with_codes(atoms: DataFrame, lexical: DataFrame, label: str = "label") -> DataFrame:
    """Atoms whose label has a code; ``lexical`` (name, code) is the small fixed table of the labels."""
    return atoms.join(F.broadcast(lexical.select(F.col("name").alias(label), "code")), label)


def unknown_labels(atoms: DataFrame, lexical: DataFrame, label: str = "label") -> DataFrame:
    return atoms.join(F.broadcast(lexical.select(F.col("name").alias(label))), label, "left_anti").groupBy(label).agg(F.count("*").alias("n"))


def structure_names(pdb: Column) -> Column:
    """The names under which a structure's file may lie, in the order in which they are taken."""
    low, up = F.lower(pdb), F.upper(pdb)
    plain = F.array(F.concat(up, F.lit(".pdb")), F.concat(low, F.lit(".pdb")), F.concat(F.lit("pdb"), low, F.lit(".ent")))
    return F.concat(plain, F.transform(plain, lambda n: F.concat(n, F.lit(".gz"))))


def located(ids: DataFrame, files: DataFrame, folders: list[str]) -> DataFrame:
    """(pdb, path) of the ids (pdb) in a listing (folder, name): the first folder of the list that has one of the names, the first name there; else null."""
    order = F.array_position(F.array(*[F.lit(f) for f in folders]), F.col("folder"))
    known = files.withColumn("at", order).where("at > 0").select("name", "at", F.concat_ws("/", "folder", "name").alias("path"))
    names = ids.select("pdb").distinct().select("pdb", F.posexplode(structure_names(F.col("pdb"))).alias("nth", "name"))
    best = names.join(known, "name").groupBy("pdb").agg(F.min(F.struct("at", "nth", "path"))["path"].alias("path"))
    return ids.select("pdb").distinct().join(best, "pdb", "left")


def by_availability(rows: DataFrame, status: DataFrame, pdb: str = "protein") -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows removed) of a table by whether its structure's status (pdb, status) is that of a usable legacy file."""
    usable = status.where(F.col("status").isin("cached_legacy_pdb", "downloaded_legacy_pdb")).select(F.col("pdb").alias("_pdb")).distinct()
    on = F.upper(F.trim(F.col(pdb))) == F.col("_pdb")
    return rows.join(usable, on, "left_semi"), rows.join(usable, on, "left_anti")
