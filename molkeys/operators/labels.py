"""Label joins, triplet search, class balance and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molkeys.functions.geometry import fenced
from molkeys.functions.identifiers import canonical, clean, parse_identifier, with_label

from .ranks import draw, numbered
from .triplets import matches_atoms


def label_identifiers(rows: DataFrame, labels: DataFrame, identifier: str = "identifier") -> DataFrame:
    """(identifier, label, status): labels by identifier in either order of its parts; status is matched, unmatched or ambiguous."""
    # the parse is behind a fence, since the optimizer inlines it into each use of a field
    keyed = fenced(rows.select(identifier), p=parse_identifier(F.col(identifier))).select(identifier, canonical(F.col("p"), F.col(identifier)).alias("canon"))
    known = fenced(labels.select(identifier, "label"), p=parse_identifier(F.col(identifier))).select(canonical(F.col("p"), F.col(identifier)).alias("canon"), clean(F.col("label")).alias("label")).distinct()
    found = keyed.join(known, "canon", "left").groupBy(identifier).agg(F.countDistinct("label").alias("n"), F.min("label").alias("label"))
    status = F.when(F.col("n") == 0, "unmatched").when(F.col("n") == 1, "matched").otherwise("ambiguous")
    return found.select(identifier, F.when(F.col("n") == 1, F.col("label")).alias("label"), status.alias("status"))


def annotate(rows: DataFrame, labels: DataFrame, identifier: str = "identifier") -> DataFrame:
    """Rows whose identifier carries its label at the end; the first one read without a single label is an error (see ``label_identifiers``)."""
    found = label_identifiers(rows, labels, identifier).select(F.col(identifier).alias("_id"), F.col("label").alias("_label"), F.col("status").alias("_status"))
    joined = rows.join(found, F.col(identifier).eqNullSafe(F.col("_id")))
    bad = F.raise_error(F.concat(F.lit("no single label of "), F.coalesce(F.col(identifier), F.lit("null")), F.lit(": "), "_status"))
    named = F.when(F.col("_status") == "matched", with_label(F.col(identifier), F.col("_label"))).otherwise(bad)
    return joined.withColumn(identifier, named).select(*rows.columns)


def unmatched(rows: DataFrame, labels: DataFrame, identifier: str = "identifier") -> DataFrame:
    """(identifier, status) of the rows that ``annotate`` would refuse."""
    return label_identifiers(rows, labels, identifier).where("status <> 'matched'").select(identifier, "status")


def annotate_lines(lines: DataFrame, labels: DataFrame, strict: bool = True) -> DataFrame:
    """(ln, line, status) of a generalised file (ln, line) whose first fields carry their labels; all else of a line stays as it is.

    Lines are ``id;v,v,...`` where the first filled line has a semicolon, else CSV, in which lines that begin with ``Protein Name`` are headers
    and stay. Blank lines go. A line without a semicolon in a file of such lines is an error, and so is one without a single label; with
    ``strict`` off the latter keeps its text, with the status unmatched or ambiguous.
    """
    filled = lines.where(F.trim("line") != "")
    head = filled.agg(F.min_by("line", "ln").alias("head")).first().head
    if head is None:
        return filled.select("ln", "line", F.lit("matched").alias("status"))
    first = lambda c: F.coalesce(F.from_csv(c, "f string")["f"], F.lit(""))
    is_header = F.lower(F.trim(first(F.col("line")))) == "protein name"
    if ";" in head and not head.lower().lstrip().lstrip('"').startswith("protein name"):
        fault = F.raise_error(F.concat(F.lit("line "), F.col("ln").cast("string"), F.lit(" has no semicolon")))
        field = F.when(F.col("line").contains(";"), F.substring_index("line", ";", 1)).otherwise(fault)
        cut, quoted = fenced(filled, identifier=field).withColumn("header", F.lit(False)), F.lit(False)
        rest = F.substr("line", F.char_length("identifier") + 1)
    else:
        cut = fenced(filled, identifier=first(F.col("line")), header=is_header)
        quoted = F.col("line").rlike('^\\s*"')
        raw = F.regexp_extract("line", '^(\\s*"(?:[^"]|"")*"|[^,]*)', 1)
        rest = F.substr("line", F.char_length(raw) + 1)
    cut = cut.select("ln", "line", "identifier", "header", rest.alias("rest"), quoted.alias("quoted"))
    found = label_identifiers(cut.where("not header").select("identifier"), labels).select(F.col("identifier").alias("_id"), "label", "status")
    joined = cut.join(found, F.col("identifier") == F.col("_id"), "left").withColumn("status", F.when(F.col("header"), "matched").otherwise(F.col("status")))
    named = with_label(F.trim("identifier"), F.col("label"))
    text = F.concat(F.when(F.col("quoted"), F.concat(F.lit('"'), F.replace(named, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(named), F.col("rest"))
    bad = F.raise_error(F.concat(F.lit("line "), F.col("ln").cast("string"), F.lit(": no single label of "), F.col("identifier"))) if strict else F.col("line")
    return joined.select("ln", F.when(F.col("header"), F.col("line")).when(F.col("status") == "matched", text).otherwise(bad).alias("line"), "status")


def conflicting_labels(labels: DataFrame, identifier: str = "identifier") -> DataFrame:
    return labels.groupBy(identifier).agg(F.array_sort(F.collect_set("label")).alias("labels")).where(F.size("labels") > 1)


def resolve_files(samples: DataFrame, files: DataFrame) -> DataFrame:
    """Sample (key, label) to key file (key, file_label, file): its label first, then no label, then the only file if the sample has none.

    A sample with several candidates of like priority is ambiguous, one without is missing. Two files of one key and label are an error.
    """
    two = F.raise_error(F.concat(F.lit("two key files of "), F.col("key").cast("string"), F.lit(" "), "file_label"))
    files = files.groupBy("key", "file_label").agg(F.countDistinct("file").alias("n"), F.min("file").alias("file")).select("key", "file_label", F.when(F.col("n") == 1, F.col("file")).otherwise(two).alias("file"))
    only = files.groupBy("key").agg(F.count("*").alias("n_files"))
    rows = samples.join(files.join(only, "key"), "key", "left")
    rank = F.when(F.col("file").isNull(), 9).when(F.col("file_label") == F.col("label"), 0).when(F.col("file_label") == "", 1).when((F.col("label") == "") & (F.col("n_files") == 1), 2).otherwise(8)
    rows = rows.withColumn("rank", rank)
    best = rows.groupBy("key", "label").agg(F.min("rank").alias("best"), F.min_by("file", "rank").alias("file"))
    status = F.when(F.col("best") <= 2, "resolved").when(F.col("best") == 8, "ambiguous").otherwise("missing")
    return best.select("key", "label", F.when(F.col("best") <= 2, F.col("file")).alias("file"), status.alias("status"))


def search_triplets(keys: DataFrame, samples: DataFrame, wanted: list[str], ignore_suffix: bool = False, on: str = "sample") -> DataFrame:
    """Key rows of the samples whose three atoms are the wanted ones in any order."""
    rows = keys.where(matches_atoms(F.col("atom1"), F.col("atom2"), F.col("atom3"), wanted, ignore_suffix))
    return rows.join(samples, on)


def rename_by_prefix(names: DataFrame, renames: DataFrame) -> DataFrame:
    """(name, new_name): the longest old name that is the file name or ends at one of its dots is replaced; null where there is none."""
    parts = F.split("name", "[.]")
    olds = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    rows = names.select("name").distinct().select("name", F.explode(olds).alias("old")).join(renames, "old")
    best = rows.groupBy("name").agg(F.max_by(F.struct("old", "new"), F.char_length("old")).alias("best"))
    new = F.concat("best.new", F.expr("substr(name, char_length(best.old) + 1)"))
    return names.join(best.select("name", new.alias("new_name")), "name", "left").select("name", "new_name")


def code_or_default(names: DataFrame, lexical: DataFrame, on: str, code: str, default: str = "N/A") -> DataFrame:
    """Rows with the code of their name, or the default where the table has none."""
    known = lexical.select(F.col("name").alias("_name"), F.col("code").cast("string").alias("_code"))
    return names.join(known, F.col(on) == F.col("_name"), "left").select(*names.columns, F.coalesce("_code", F.lit(default)).alias(code))


def balanced_sample(rows: DataFrame, label: str, order: str, seed: int = 42) -> DataFrame:
    """As many rows of each class as the smallest has, by a hash of the seed; the draw does not depend on partitions."""
    least = rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("_least"))
    placed = numbered(rows, [draw(seed, order), F.col(order)], [label], "_nth")
    return placed.crossJoin(F.broadcast(least)).where("_nth <= _least").drop("_nth", "_least")  # a single row


def class_counts(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))


def least_class_count(rows: DataFrame, label: str, least: int) -> DataFrame:
    return rows.join(F.broadcast(class_counts(rows, label).where(F.col("n") >= least).select(label)), label, "left_semi")


def class_weights(rows: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """n / (k n_c) for every row of class c."""
    counts = class_counts(rows, label)
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    weights = counts.crossJoin(total).select(label, (F.col("total") / (F.col("k") * F.col("n"))).alias(name))
    return rows.join(F.broadcast(weights), label)


def stratified_split(rows: DataFrame, label: str, key: str, test: float = 0.15, val: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds ``split`` (train, val, test) with the shares in every class, by a hash order; shares of rows round half up."""
    if not (test > 0 and val > 0 and test + val < 1):
        raise ValueError("sizes must be positive and sum to less than one")
    out = numbered(rows, [draw(seed, key), F.col(key)], [label], "_p", "_n")
    split = F.when(F.col("_p") <= F.round(F.col("_n") * test), "test").when(F.col("_p") <= F.round(F.col("_n") * test) + F.round(F.col("_n") * val), "val").otherwise("train")
    return out.withColumn("split", split).drop("_p", "_n")


def _holdout(counts: DataFrame, fraction: float, seed: int, tries: int) -> DataFrame:
    """(grp) of the best holdout among hash-ordered ones: group counts are few, candidates are numbers."""
    groups = counts.select("grp").distinct()
    n = groups.count()
    take = max(1, min(n - 1, round(n * fraction)))
    drawn = groups.crossJoin(counts.sparkSession.range(tries).withColumnRenamed("id", "try"))
    drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("try").orderBy(F.xxhash64(F.lit(seed), "try", "grp"), "grp"))).withColumn("out", F.col("nth") <= take)
    cells = drawn.join(counts, "grp").groupBy("try", "label").agg(F.sum(F.when(F.col("out"), F.col("n")).otherwise(0)).alias("held"), F.sum("n").alias("total"))
    score = cells.groupBy("try").agg(
        F.abs(F.sum("held") / F.sum("total") - fraction).alias("size_error"),
        F.avg(F.abs(F.col("held") / F.col("total") - fraction)).alias("class_error"),
        F.avg((F.col("held") == 0).cast("double")).alias("missing"),
        F.min(F.col("total") - F.col("held")).alias("least_train"),
    )
    score = score.where("least_train > 0").withColumn("score", 4 * F.col("size_error") + F.col("class_error") + 0.25 * F.col("missing"))
    best = score.orderBy("score", "size_error", "class_error", "try").limit(1).select("try")
    return drawn.where("out").join(F.broadcast(best), "try", "left_semi").select("grp")


def grouped_split(rows: DataFrame, label: str, group: str, test: float = 0.15, val: float = 0.15, seed: int = 42, tries: int = 512) -> DataFrame:
    """Adds ``split`` so that no group is in two of them, classes are near their shares, and train has every class."""
    counts = rows.groupBy(F.col(group).alias("grp"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    if counts.select("grp").distinct().count() < 3:
        raise ValueError("a grouped split needs three groups")
    in_test = _holdout(counts, test, seed, tries)
    rest = counts.join(in_test, "grp", "left_anti")
    in_val = _holdout(rest, val / (1 - test), seed + 1, tries)
    named = in_test.withColumn("split", F.lit("test")).unionByName(in_val.withColumn("split", F.lit("val"))).withColumnRenamed("grp", group)
    return rows.join(named, group, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def split_statistics(rows: DataFrame, label: str, split: str = "split") -> DataFrame:
    """(split, label, n, percent) with percent of the split."""
    cells = rows.groupBy(split, label).agg(F.count("*").alias("n"))
    return cells.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(split)))


def split_audit(rows: DataFrame, label: str, group: str, split: str = "split") -> DataFrame:
    """(kind, split, n, classes): the diagnostics of a split as rows.

    Kinds: ``rows``, ``groups`` and ``classes`` of a split; ``overlap``, groups that two splits (named a_b) share; ``missing``, classes that a split
    lacks, with their names; ``few groups``, classes with fewer than three groups.
    """
    cells = rows.select(F.col(split).alias("split"), F.col(group).cast("string").alias("grp"), F.col(label).cast("string").alias("label"))
    counted = cells.groupBy("split", "grp", "label").agg(F.count("*").alias("n"))
    names = F.lit(None).cast("array<string>")
    of_split = counted.groupBy("split").agg(F.sum("n").alias("rows"), F.countDistinct("grp").alias("groups"), F.countDistinct("label").alias("classes"))
    sizes = of_split.unpivot("split", ["rows", "groups", "classes"], "kind", "n").select("kind", "split", "n", names.alias("classes"))
    splits = counted.groupBy("grp").agg(F.array_sort(F.collect_set("split")).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.concat_ws("_", a, b))))
    overlap = splits.select(F.explode(pairs).alias("split")).groupBy("split").agg(F.count("*").alias("n")).select(F.lit("overlap").alias("kind"), "split", "n", names.alias("classes"))
    known = of_split.select("split").crossJoin(counted.select("label").distinct())  # three splits
    missing = known.join(counted.select("split", "label").distinct(), ["split", "label"], "left_anti").groupBy("split").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("label")).alias("classes")).select(F.lit("missing").alias("kind"), "split", "n", "classes")
    few = counted.groupBy("label").agg(F.countDistinct("grp").alias("g")).where("g < 3").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("label")).alias("classes")).where("n > 0").select(F.lit("few groups").alias("kind"), F.lit("").alias("split"), "n", "classes")
    return sizes.unionByName(overlap).unionByName(missing).unionByName(few)


def split_report(rows: DataFrame, label: str, group: str, split: str = "split") -> DataFrame:
    """Per split: rows, groups, classes, and groups that another split has too."""
    shared = rows.groupBy(group).agg(F.countDistinct(split).alias("k")).where("k > 1").select(group, F.lit(1).alias("shared"))
    return rows.join(shared, group, "left").groupBy(split).agg(F.count("*").alias("n_rows"), F.countDistinct(group).alias("n_groups"), F.countDistinct(label).alias("n_classes"), F.countDistinct(F.when(F.col("shared") == 1, F.col(group))).alias("n_shared_groups"))
