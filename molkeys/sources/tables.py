"""Readers of sample tables, code lists, key files and matrices, and resolvers of their column names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molkeys.functions.identifiers import list_id
from molkeys.operators.ranks import numbered
from molkeys.scratch import written


class ColumnError(ValueError):
    pass


def resolve(columns: list[str], role: str, names: list[str], explicit: str | None = None, rule: str = "unique", required: bool = True) -> str | None:
    """The column of a role.

    An explicit name must be there. Rules: ``unique`` takes exact names, then names in any case, and several are an error;
    ``first`` takes the first candidate that is there; ``alias`` wants exactly one of all candidates; ``letters`` compares
    letters and digits only; ``part`` takes a unique column that holds a candidate.
    """
    fold = (lambda s: re.sub(r"[^a-z0-9]", "", s.lower())) if rule == "letters" else (lambda s: s.strip().lower())
    if explicit:
        hits = [c for c in columns if c == explicit] or [c for c in columns if fold(c) == fold(explicit)]
        if len(hits) != 1:
            raise ColumnError(f"{role}: no single column {explicit!r}")
        return hits[0]
    if rule == "first":
        hits = next(([c for c in columns if c == n or fold(c) == fold(n)][:1] for n in names if any(c == n or fold(c) == fold(n) for c in columns)), [])
    elif rule == "part":
        hits = [c for c in columns if c in names] or [c for c in columns if any(fold(n) in fold(c) for n in names)]
    else:
        hits = [c for c in columns if c in names] if rule == "unique" else []
        hits = hits or [c for c in columns if fold(c) in {fold(n) for n in names}]
    if len(hits) > 1:
        raise ColumnError(f"{role}: several columns {hits}")
    if not hits and required:
        raise ColumnError(f"{role}: none of {names}")
    return hits[0] if hits else None


def read_strings(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A CSV file with a header, all columns as text."""
    return spark.read.options(header=True, inferSchema=False, quote='"', escape='"', maxColumns="200000", **options).csv(path)


def lexical_map(rows: DataFrame, line: str = "line", keep_na: bool = False) -> DataFrame:
    """(name, code) from ``seq`` and ``atom`` or ``ATOM``, or both: the last row of a name wins, and ATOM over atom.

    ``NA`` is lost by default, as by readers that take it for a missing value. Names of columns are compared with their case.
    """
    if "seq" not in rows.columns or not {"atom", "ATOM"} & set(rows.columns):
        raise ColumnError("a lexical table needs seq, and atom or ATOM")
    # places, for the session may not tell names that differ by case only
    flat = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    col = lambda name: F.col(f"c{rows.columns.index(name)}")
    names = [F.struct(F.lit(i).alias("i"), col(c).alias("name")) for i, c in enumerate(("atom", "ATOM")) if c in rows.columns]
    both = flat.select(col("seq").try_cast("double").cast("int").alias("code"), col(line).cast("long").alias("at"), F.explode(F.array(*names)).alias("n"))
    both = both.where("n.name <> '' and code is not null")
    if not keep_na:
        both = both.where("n.name <> 'NA'")
    return both.groupBy(F.col("n.name").alias("name")).agg(F.max_by("code", F.struct("n.i", "at")).alias("code"))


def read_lexical(spark: SparkSession, path: str) -> DataFrame:
    """The lexical map of a CSV file; its header is read apart, since the reader renames columns that differ by case only."""
    head = spark.read.text(path).first()
    names = [x.strip().strip('"') for x in head.value.split(",")] if head else []
    rows = read_strings(spark, path)
    return lexical_map(rows.toDF(*names).withColumn("line", F.monotonically_increasing_id()) if names else rows)


def expected_counts(spark: SparkSession, path: str) -> DataFrame:
    """(kind, res, expected) from a JSON object of objects; names are upper-cased, counts below 1 are an error."""
    text = spark.read.text(path, wholetext=True)
    maps = text.select(F.from_json("value", "map<string,map<string,int>>").alias("m"))
    rows = maps.select(F.explode("m").alias("kind", "counts")).select("kind", F.explode("counts").alias("res", "expected"))
    checked = F.when(F.col("expected") >= 1, F.col("expected")).otherwise(F.raise_error(F.concat(F.lit("bad count of "), "res")))
    return rows.select("kind", F.upper(F.trim("res")).alias("res"), checked.alias("expected"))


KEY_FIELDS = {20: ("atom", "seq"), 26: ("atom", "seq", "residue", "chain")}


def key_rows(lines: DataFrame, text: str = "line", layout: str = "auto") -> DataFrame:
    """Triplet-key lines in one schema: 26 fields or more are cross rows, 20 or more standard ones, fewer malformed."""
    part = F.split(text, "\t")
    n = F.size(part)
    kind = F.when(n >= 26, "cross").when(n >= 20, "standard").otherwise("malformed") if layout == "auto" else F.when(n >= {"cross": 26, "standard": 20}[layout], layout).otherwise("malformed")
    rows = lines.withColumns({"_p": part, "layout": kind})
    cross = F.col("layout") == "cross"
    at = lambda i, j: F.when(cross, F.trim(F.get("_p", F.lit(i)))).when((F.col("layout") == "standard") & F.lit(j is not None), F.trim(F.get("_p", F.lit(j if j is not None else 0))))
    columns = {"key": at(0, 0).try_cast("long")}
    for v in range(3):
        columns |= {f"atom{v + 1}": at(1 + 4 * v, 1 + 2 * v), f"seq{v + 1}": at(2 + 4 * v, 2 + 2 * v), f"residue{v + 1}": at(3 + 4 * v, None), f"chain{v + 1}": at(4 + 4 * v, None)}
    names = ["theta_bin", "theta", "dist_bin", "max_dist"] + [f"{c}{v}" for v in (1, 2, 3) for c in "xyz"]
    columns |= {name: at(13 + i, 7 + i).try_cast("int" if name.endswith("_bin") else "double") for i, name in enumerate(names)}
    return rows.withColumns(columns).drop("_p")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ln, line) of text files of any size, lines numbered from 1 in each file.

    The reader cuts files into splits; the byte where a split begins and the order in which its lines are read order all lines of a file, and
    their places in that order are their numbers. No file is one row or one task.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id")]
    lines = written(spark.read.text(path).select(*place, F.col("value").alias("line")), "lines")
    return numbered(lines, [F.col("_start"), F.col("_id")], ["file"], "ln").select("file", "ln", "line")


def distance_rows(spark: SparkSession, path: str) -> DataFrame:
    """(id_i, id_j, d) of headerless lines ``id;d,d,...`` of a file, or of files in the order of their names; columns are in the order of the lines.

    A row of the matrix is a row, so a matrix may be of any number of them.
    """
    rows = written(numbered_lines(spark, path).where(F.trim("line") != ""), "matrix")
    rows = numbered(rows, [F.col("file"), F.col("ln")], name="i")
    rows = rows.select("i", F.trim(F.substring_index("line", ";", 1)).alias("id_i"), F.split(F.substring_index("line", ";", -1), ",").alias("ds"))
    cells = rows.select("id_i", F.posexplode("ds").alias("j", "d"))
    names = rows.select((F.col("i") - 1).alias("j"), F.col("id_i").alias("id_j"))
    return cells.join(names, "j").select("id_i", "id_j", F.trim("d").try_cast("decimal(20,10)").alias("d"))


def write_numbered(lines: DataFrame, path: str) -> None:
    """Text files (ln, line) in the order of their numbers: part after part, and within each."""
    lines.repartitionByRange("ln").sortWithinPartitions("ln").select(F.col("line").alias("value")).write.text(path)


#: Columns of an id list, the first that is there wins.
ID_COLUMNS = ("protein", "pdb_id", "entry_id", "identifier", "pdb")


def listed_ids(rows: DataFrame, line: str = "line") -> DataFrame:
    """(line, id) of the rows of an id list in the order of its lines, each id once: of the preferred column, else the first valid value of a row."""
    data = [c for c in rows.columns if c != line]
    lower = {c.lower(): c for c in data}
    best = next((lower[c] for c in ID_COLUMNS if c in lower), None)
    value = F.coalesce(*[list_id(F.col(f"`{c}`")) for c in ([best] if best else data)])
    return rows.select(F.col(line).alias("line"), value.alias("id")).where("id is not null").groupBy("id").agg(F.min("line").alias("line")).select("line", "id")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(line, id) of an id list, a CSV file with a header or lines of text."""
    if path.lower().endswith(".csv"):
        rows = read_strings(spark, path)
        return listed_ids(rows.select("*", F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line")))
    return listed_ids(numbered_lines(spark, path).select(F.col("ln").alias("line"), F.col("line").alias("text")))


def first_ids(ids: DataFrame, n: int, line: str = "line") -> DataFrame:
    """The first n ids of a list, by the lines that name them first."""
    return ids.groupBy("id").agg(F.min(line).alias(line)).orderBy(line, "id").limit(n)


def unique_values(rows: DataFrame, column: str) -> DataFrame:
    """(value): the filled values of a column without the blanks around them, each once."""
    if column not in rows.columns:
        raise ColumnError(f"no column {column}")
    return rows.select(F.trim(F.col(f"`{column}`").cast("string")).alias("value")).where("value <> ''").distinct()


# Names of the columns of a sample table.
SAMPLE_ROLES = {"protein": ["protein"], "chain": ["chain"], "name": ["residue", "ligand", "name", "entity_name", "carb_name"], "seq": ["seqnum", "carb_id"]}


def sample_rows(rows: DataFrame, line: str, whole_chains: bool = False, **explicit: str) -> DataFrame:
    """(line, protein, chain, name, seq) of a sample table with columns of any of the known names; ``explicit`` names a role's column.

    All roles are needed for residues; for whole chains name and number may be missing.
    """
    columns = [c for c in rows.columns if c != line]
    found = {r: resolve(columns, r, names, explicit.get(r), required=not (whole_chains and r in ("name", "seq"))) for r, names in SAMPLE_ROLES.items()}
    return rows.select(F.col(f"`{line}`").alias("line"), *[(F.lit("") if c is None else F.coalesce(F.trim(F.col(f"`{c}`")), F.lit(""))).alias(r) for r, c in found.items()])


def skipped_rows(samples: DataFrame, whole_chains: bool = False) -> DataFrame:
    """(line, missing): rows of a sample table that give no target, and which of their values are missing."""
    roles = ["protein", "chain"] if whole_chains else ["protein", "chain", "name", "seq"]
    filled = lambda r: F.exists(F.split(r, ";"), lambda x: F.trim(x) != "") if r == "seq" else F.col(r) != ""
    missing = F.array_compact(F.array(*[F.when(~filled(r), r) for r in roles]))
    return samples.select("line", F.array_join(missing, ",").alias("missing")).where("missing <> ''")


def sniff_format(first_line: str) -> str:
    """semicolon, header_csv, csv or empty, from a file's first line."""
    line = first_line.strip()
    if not line:
        return "empty"
    if ";" in line:
        return "semicolon"
    fields = [x.strip().lower() for x in line.split(",")]
    return "header_csv" if any(x in ("protein", "protein name", "chain", "label", "identifier", "pdb") for x in fields) else "csv"


def first_column(lines: DataFrame, text: str = "line") -> DataFrame:
    """The first field of each line that is not blank."""
    return lines.where(F.trim(text) != "").select(F.trim(F.get(F.split(F.col(text), "[;\t,]"), F.lit(0))).alias("value"))


def write_generalised(features: DataFrame, path: str, id_column: str, columns: list[str]) -> None:
    """Lines ``id;v1,v2,...``."""
    features.select(F.concat(F.col(id_column), F.lit(";"), F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in columns])).alias("value")).write.text(path)
