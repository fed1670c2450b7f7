"""Queries of the structural-key operators over the shared test tables, with their DuckDB equivalents.

Atoms come from the vectors: twelve neighbouring ones are a structure, their labels the codes, three components the coordinates.
Key frequencies come from the line items: suppliers are samples, part sizes keys. Every query covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molkeys.functions import geometry, identifiers
from molkeys.operators import balance, contacts, key_tables, labels, metrics, models, neighbours, quantiles, residues, search, similarity, targets, triplets
from molkeys.scratch import scratch_path
from molkeys.sources import key_directory, structures, tables

Frame = DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(struct, idx, code, x, y, z)."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: (F.col("embedding")[i].cast("double") * 40)
    return e.select(F.floor(F.col("vec_id") / 12).cast("long").alias("struct"), (F.col("vec_id") % 12).cast("int").alias("idx"), (F.col("label") + 1).cast("int").alias("code"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, grp, region, key, freq, line)."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("key"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    counted = li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "key").agg(F.count("*").alias("freq"))
    return counted.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("l_suppkey").alias("sample"), F.col("s_nationkey").alias("grp"), F.col("r_name").alias("region"), "key", "freq")


def triplet_keys(spark, sf_dir) -> Frame:
    return triplets.key_frequency(triplets.triplet_keys(atoms(spark, sf_dir), ["struct"]), ["struct"])


def mirror_keys(spark, sf_dir) -> Frame:
    return triplets.key_frequency(triplets.triplet_keys(atoms(spark, sf_dir), ["struct"], mirror=True), ["struct"])


def triplet_bins(spark, sf_dir) -> Frame:
    return triplets.triplet_keys(atoms(spark, sf_dir), ["struct"]).groupBy("theta_bin", "dist_bin").agg(F.count("*").alias("n"))


def triplet_summary(spark, sf_dir) -> Frame:
    a = atoms(spark, sf_dir)
    out = triplets.summaries(triplets.triplet_keys(a, ["struct"]), a, ["struct"])
    return out.select("struct", "n_atoms", "n_triplets", "n_keys", F.round("max_distance", 6).alias("max_distance"), F.round("min_distance", 6).alias("min_distance"))


def atom_count_filter(spark, sf_dir) -> Frame:
    a = atoms(spark, sf_dir).withColumn("res", F.concat(F.lit("L"), F.col("code").cast("string")))
    counts = F.array(*[F.struct(F.lit(f"L{c}").alias("res"), F.lit(2).alias("expected")) for c in range(1, 8)])
    expected = spark.range(1).select(F.explode(counts).alias("c")).select("c.*")
    return triplets.atom_count_filter(a, expected, ["struct", "res"]).groupBy("struct", "res").agg(F.count("*").alias("n"))


def search_atoms(spark, sf_dir) -> Frame:
    a = atoms(spark, sf_dir).withColumn("name", F.concat(F.lit("C"), F.col("code").cast("string")))
    rows = triplets.triplet_keys(a, ["struct"], carry=("name",)).where("error is null")
    rows = rows.select(F.col("struct").alias("sample"), "key", F.col("v1_name").alias("atom1"), F.col("v2_name").alias("atom2"), F.col("v3_name").alias("atom3"))
    samples = atoms(spark, sf_dir).select(F.col("struct").alias("sample")).distinct()
    return labels.search_triplets(rows, samples, ["C2", "C1", "C2"]).select("sample", "key", "atom1", "atom2", "atom3")


def fixed_width(spark, sf_dir) -> Frame:
    """Vectors written as structure lines and read back."""
    e = atoms(spark, sf_dir)
    line = F.format_string("HETATM%5d  C%-2d NAG A%4d    %8.3f%8.3f%8.3f  1.00 20.00           C  ", F.col("idx"), F.col("code"), F.col("idx"), "x", "y", "z")
    lines = e.select(F.col("struct").cast("string").alias("pdb"), F.col("idx").alias("ln"), line.alias("line"))
    out = structures.key_atoms(lines, "ligand")
    return out.select("pdb", "label", "res", "chain", "seq", F.round(F.col("x") * 1000).cast("long").alias("x1000"), F.round(F.col("z") * 1000).cast("long").alias("z1000"))


def common_keys(spark, sf_dir) -> Frame:
    return key_tables.common_keys(frequencies(spark, sf_dir), ["grp"])


def common_key_summary(spark, sf_dir) -> Frame:
    return key_tables.common_key_summary(frequencies(spark, sf_dir), ["grp"])


def key_percent(spark, sf_dir) -> Frame:
    return key_tables.key_percent(frequencies(spark, sf_dir), "grp").select("grp", "key", "key_occurrence", "total_files", "key_percent")


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def one_vs_all(spark, sf_dir) -> Frame:
    out = key_tables.one_vs_all(frequencies(spark, sf_dir), "region", REGIONS)
    return out.select("key", *[F.col(f"`{r}_key%`").alias(f"{r.lower().replace(' ', '_')}_percent") for r in REGIONS])


def feature_table(spark, sf_dir) -> Frame:
    out = key_tables.feature_table(frequencies(spark, sf_dir), keys=list(range(1, 51)))
    return out.select("sample", *[F.col(f"`{k}`").cast("long").alias(f"k{k}") for k in range(1, 51)])


def feature_frequency(spark, sf_dir) -> Frame:
    return metrics.feature_frequency(frequencies(spark, sf_dir))


def generalised_jaccard(spark, sf_dir) -> Frame:
    return similarity.generalised_jaccard(frequencies(spark, sf_dir), digits=6)


def set_jaccard(spark, sf_dir) -> Frame:
    f = frequencies(spark, sf_dir).groupBy(F.col("grp").alias("sample"), "key").agg(F.sum("freq").alias("freq"))
    return similarity.generalised_jaccard(f, weighted=False, digits=6)


def distance_matrix(spark, sf_dir) -> Frame:
    f = frequencies(spark, sf_dir).groupBy(F.col("grp").alias("sample"), "key").agg(F.sum("freq").alias("freq"))
    return similarity.distance_matrix(f).select("id_i", "id_j", F.round("d", 6).alias("d"))


def matrix_faults(spark, sf_dir) -> Frame:
    f = frequencies(spark, sf_dir).groupBy(F.col("grp").alias("sample"), "key").agg(F.sum("freq").alias("freq"))
    m = similarity.distance_matrix(f).withColumn("d", F.when(F.expr("id_i = 1 and id_j = 2"), 2.0).otherwise(F.round("d", 6)))
    return similarity.matrix_faults(m)


def similarity_text(spark, sf_dir) -> Frame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size").cast("decimal(20,10)") / F.lit(50)).cast("decimal(20,10)").alias("d"))
    return p.select("p_partkey", identifiers.similarity(F.col("d")).alias("similarity"))


def adjusted_rand(spark, sf_dir) -> Frame:
    return similarity.adjusted_rand(table(spark, sf_dir, "documents"), "lang", "source").select(F.round("ari", 9).alias("ari"))


def clusters(spark, sf_dir) -> Frame:
    f = frequencies(spark, sf_dir).groupBy(F.col("grp").alias("sample"), "key").agg(F.sum("freq").alias("freq"))
    return similarity.average_linkage(similarity.distance_matrix(f), 5)


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    a = atoms(spark, sf_dir).withColumnRenamed("struct", "pdb")
    return a.where("code <= 5"), a.where("code > 5")


def contact_pairs(spark, sf_dir) -> Frame:
    left, right = _sides(spark, sf_dir)
    out = contacts.contacts(left, right, 6.0)
    return out.select("pdb", "l_idx", "r_idx", F.round("distance", 6).alias("distance"))


def interaction_labels(spark, sf_dir) -> Frame:
    left, right = _sides(spark, sf_dir)
    out = contacts.contacts(left, right, 12.0).withColumn("distance", F.floor("distance") / 4)
    return contacts.nearest_labels(out, ["pdb", "l_idx"]).select("pdb", "l_idx", "min_distance", "label")


def linked_residues(spark, sf_dir) -> Frame:
    a = atoms(spark, sf_dir).withColumnRenamed("struct", "pdb")
    node = lambda c: (F.col("pdb") * 12 + F.col(c)).cast("long")
    edges = contacts.contacts(a, a, 7.0).where("l_idx < r_idx").select(node("l_idx").alias("a"), node("r_idx").alias("b"))
    nodes = a.select(node("idx").alias("node"), "code")
    return residues.linked(edges, nodes.where("code = 1"), nodes.where("code <> 1"))


def discovery_labels(spark, sf_dir) -> Frame:
    found = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("chain"), (F.col("l_partkey") % 97).alias("seq"))
    seeds = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 120).alias("chain"), (F.col("o_orderkey") % 101).alias("seq"))
    return residues.discovery_labels(found, seeds, ["chain", "seq"], include_missing=False).unionByName(residues.missing_seeds(found, seeds, ["chain", "seq"]).withColumn("label", F.lit("CI missing")))


def aggregated_residues(spark, sf_dir) -> Frame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.concat((F.col("o_orderkey") % 500).cast("string"), F.when(F.col("o_orderkey") % 7 == 0, "A").otherwise("")).alias("seq"))
    return residues.aggregate_residues(o, ["o_custkey"])


def exploded_residues(spark, sf_dir) -> Frame:
    return residues.explode_residues(aggregated_residues(spark, sf_dir)).groupBy("seq").agg(F.count("*").alias("n"))


def _names(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    pdb = F.concat((F.col("c_custkey") % 10).cast("string"), F.lpad(F.hex(F.col("c_custkey") % 4096), 3, "0"))
    chain = F.element_at(F.array(*[F.lit(x) for x in "ABCg"]), (F.col("c_nationkey") % 4 + 1).cast("int"))
    seq, label = (F.col("c_custkey") % 300).cast("string"), F.when(F.col("c_custkey") % 3 == 0, "_CI").when(F.col("c_custkey") % 3 == 1, "_NCI").otherwise("")
    kind = F.col("c_custkey") % 5
    name = F.when(kind == 0, F.concat_ws("_", pdb, chain, seq, F.lit("NAG"))).when(kind == 1, F.concat_ws("_", seq, pdb, chain, F.lit("man"))).when(kind == 2, F.concat_ws("_", pdb, chain, F.lit("NNB"))).when(kind == 3, F.concat_ws("_", pdb, chain)).otherwise(F.concat(F.lit("x-"), F.col("c_custkey").cast("string")))
    return c.select("c_custkey", F.concat(name, F.when(kind < 3, label).otherwise("")).alias("identifier"))


def parsed_identifiers(spark, sf_dir) -> Frame:
    n = _names(spark, sf_dir)
    parsed = geometry.fenced(n, p=identifiers.parse_identifier(F.col("identifier")))
    return parsed.select("c_custkey", identifiers.canonical(F.col("p"), F.col("identifier")).alias("canon"), "p").select("c_custkey", "canon", F.col("p.kind").alias("kind"), F.col("p.label").alias("label"))


def label_join(spark, sf_dir) -> Frame:
    n = _names(spark, sf_dir)
    seq = F.split("identifier", "_")
    # labels know the four-part identifiers in the other order of their parts, all others as they are
    other = F.when(F.col("c_custkey") % 5 == 0, F.concat_ws("_", seq[2], seq[0], seq[1], seq[3])).otherwise(F.col("identifier"))
    known = n.select(other.alias("identifier"), F.when(F.col("c_custkey") % 2 == 0, "CI").otherwise("NCI").alias("label"))
    return labels.label_identifiers(n.select("identifier"), known.where(F.crc32(F.col("identifier").cast("binary")) % 4 != 0))


def resolved_files(spark, sf_dir) -> Frame:
    o = table(spark, sf_dir, "orders")
    samples = o.select((F.col("o_custkey") % 200).alias("key"), F.when(F.col("o_orderkey") % 3 == 0, "CI").otherwise("").alias("label")).distinct()
    files = o.select((F.col("o_orderkey") % 230).alias("key"), F.when(F.col("o_orderkey") % 2 == 0, "CI").when(F.col("o_orderkey") % 5 == 0, "").otherwise("NCI").alias("file_label")).distinct()
    return labels.resolve_files(samples, files.withColumn("file", F.concat_ws("_", F.col("key").cast("string"), F.col("file_label")))).select("key", "label", "status")


def balanced_sizes(spark, sf_dir) -> Frame:
    return labels.balanced_sample(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def oversampled_sizes(spark, sf_dir) -> Frame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return balance.balance_oversample(d, "lang", "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


def class_weights(spark, sf_dir) -> Frame:
    d = labels.class_weights(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang")
    return d.select("doc_id", "lang", F.round("weight", 9).alias("weight"))


def frequent_classes(spark, sf_dir) -> Frame:
    return labels.least_class_count(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 60)


def legacy_files(spark, sf_dir) -> Frame:
    """Five lines a customer, of which one may tell."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"))
    told = F.element_at(F.array(*[F.lit(x) for x in LINES]), (F.pmod(F.col("file") * 7 + F.col("ln") * 3, F.lit(len(LINES))) + 1).cast("int"))
    lines = c.select("file", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("ln")).withColumn("line", told)
    return structures.legacy_validity(lines, 4)


def renamed_files(spark, sf_dir) -> Frame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    names = c.select(F.concat_ws(".", F.concat(F.lit("P"), F.col("k") % 50), F.col("k") % 7, F.lit("keys")).alias("name")).distinct()
    old = F.when(F.col("k") % 3 == 0, F.concat_ws(".", F.concat(F.lit("P"), F.col("k") % 50), F.col("k") % 7)).otherwise(F.concat(F.lit("P"), F.col("k") % 40))
    renames = c.select(old.alias("old")).distinct().withColumn("new", F.concat("old", F.lit("_N")))
    return labels.rename_by_prefix(names, renames)


def coded_names(spark, sf_dir) -> Frame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("name"))
    n = table(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("name"), F.col("n_regionkey").alias("code"))
    return labels.code_or_default(c, n, "name", "code")


def half_even_texts(spark, sf_dir) -> Frame:
    """Eighths, tenths, hundredths and balances: halves that are exact and halves that are not, of either sign."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    v = F.when(k % 4 == 0, k / 8).when(k % 4 == 1, k / 20).when(k % 4 == 2, k / 200).otherwise(F.col("c_acctbal").cast("double") / 10)
    return c.select("c_custkey", *[identifiers.half_even(v, d).alias(n) for d, n in ((1, "one"), (2, "two"), (3, "three"))])


def chains_in_order(spark, sf_dir) -> Frame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), F.element_at(F.array(*[F.lit(x) for x in (" ", "B", "A", "", "c")]), (F.col("c_custkey") % 5 + 1).cast("int")).alias("chain"))
    per = c.select("grp", identifiers.chain_order(F.col("chain")).alias("o")).groupBy("grp").agg(F.array_sort(F.collect_set("o")).alias("os"))
    return per.select("grp", F.array_join(F.transform("os", lambda o: F.when(o["blank"], F.lit("_")).otherwise(o["chain"])), ",").alias("chains"))


def _sample_rows(spark, sf_dir) -> DataFrame:
    """A sample table over the customers, with columns as such tables name them."""
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    pdb = F.concat(text(k % 10), F.lpad(F.hex(k % 256), 3, "0"))
    seqs = F.when(k % 4 == 0, F.concat_ws("; ", text(k % 30), text(k % 9))).when(k % 4 == 1, text(k % 30)).otherwise("")
    name = F.when(k % 3 == 0, "NAG").when(k % 3 == 1, "man").otherwise("")
    columns = {"protein": F.when(k % 11 == 0, "").otherwise(pdb), "Chain ID": F.when(k % 13 == 0, "").otherwise(F.when(k % 2 == 0, "A").otherwise("b")), "carb_name": name, "SeqNum": seqs, "chain_group": F.when(k % 5 == 0, "nnb").otherwise(""), "Group": F.when(k % 7 == 0, "ci").when(k % 7 == 1, "other").otherwise("")}
    return table(spark, sf_dir, "customer").select(k.alias("line"), *[v.alias(c) for c, v in columns.items()])


def search_samples(spark, sf_dir) -> Frame:
    out = search.samples_of_rows(_sample_rows(spark, sf_dir), "line")
    return out.select("line", F.coalesce("nth", F.lit(0)).alias("nth"), "protein", "grp", "canon", "kind", "fault")


def search_chain_samples(spark, sf_dir) -> Frame:
    out = search.samples_of_rows(_sample_rows(spark, sf_dir), "line", search.CHAIN)
    return out.select("line", "protein", "grp", "canon", "kind", "fault")


def search_counters(spark, sf_dir) -> Frame:
    """Samples of the table against key files of one line for each order: standard, cross or malformed."""
    samples = search.samples_of_rows(_sample_rows(spark, sf_dir), "line", search.CHAIN)
    o = table(spark, sf_dir, "orders")
    k = F.col("o_custkey")
    key = F.concat_ws("_", F.concat((k % 10).cast("string"), F.lpad(F.hex(k % 256), 3, "0")), F.when(k % 2 == 0, "A").otherwise("b"))
    size = F.element_at(F.array(F.lit(20), F.lit(26), F.lit(19)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    atom = F.concat(F.lit("C"), (F.col("o_orderkey") % 4).cast("string"))
    cell = lambda i: F.when(i == 0, "7").when(i == 1, atom).when(i == F.when(size == 26, 5).otherwise(3), "C2").when(i == F.when(size == 26, 9).otherwise(5), "C1").otherwise("0")
    line = F.array_join(F.transform(F.sequence(F.lit(0), size - 1), cell), "\t")
    label = F.when(k % 3 == 0, "CI").otherwise("")
    lines = o.select(key.alias("key"), label.alias("file_label"), F.concat_ws("/", key, label).alias("file"), line.alias("line"))
    return search.counters(*search.search(samples, lines, ["C1", "C2", "C3"]))


def residue_targets(spark, sf_dir) -> Frame:
    rows = _sample_rows(spark, sf_dir).select("line", "protein", F.col("Chain ID").alias("chain"), F.col("carb_name").alias("name"), F.col("SeqNum").alias("seq"))
    return targets.residue_targets(rows).select("line", "identifier", "name", "seq")


def chain_targets(spark, sf_dir) -> Frame:
    rows = _sample_rows(spark, sf_dir).select("line", "protein", F.col("Chain ID").alias("chain"), F.col("carb_name").alias("name"), F.col("SeqNum").alias("seq"))
    return targets.chain_targets(rows).select("line", "identifier", "summary_names", "summary_seqs")


def _target_keys(spark, sf_dir) -> DataFrame:
    """Keys of residues of four atoms, from written structure lines and a table that names them."""
    e = atoms(spark, sf_dir)
    seq = F.floor(F.col("idx") / 4).cast("int")
    line = F.format_string("HETATM%5d  C%-2d NAG A%4d    %8.3f%8.3f%8.3f  1.00 20.00           C  ", F.col("idx"), F.col("code"), seq, "x", "y", "z")
    lines = e.select(F.col("struct").cast("string").alias("pdb"), F.col("idx").alias("ln"), line.alias("line"))
    wanted = e.select(F.col("struct").alias("line"), F.col("struct").cast("string").alias("protein")).distinct().select("line", "protein", F.lit("A").alias("chain"), F.lit("NAG").alias("name"), F.lit("0;1; 2").alias("seq"))
    codes = e.select(F.concat(F.lit("C"), F.col("code").cast("string")).alias("atom"), F.col("code").cast("string").alias("seq"), F.lit(0).alias("line")).distinct()
    return targets.target_keys(lines, targets.residue_targets(wanted), tables.lexical_map(codes))


def target_keys(spark, sf_dir) -> Frame:
    return targets.key_records(_target_keys(spark, sf_dir)).groupBy("identifier", "key").agg(F.count("*").alias("freq"))


RECORD = ["key", *[f"{c}{v}" for v in (1, 2, 3) for c in ("atom", "seq", "x", "y", "z")], "theta_bin", "theta", "dist_bin", "max_dist"]


def _record(rows: DataFrame) -> Frame:
    return rows.select("identifier", *[F.trim(c).alias(c) if c.startswith(("atom", "seq")) else F.round(c, 6).alias(c) if c in ("theta", "max_dist") else F.col(c) for c in RECORD])


def target_records(spark, sf_dir) -> Frame:
    """All twenty fields of the key lines."""
    return _record(targets.key_records(_target_keys(spark, sf_dir)))


def record_files(spark, sf_dir) -> Frame:
    """The key lines written as one file a target, and those of every second structure read back, typed."""
    records = targets.key_records(_target_keys(spark, sf_dir))
    # identifiers as files have them: the structure's number in four places
    four = F.concat_ws("_", F.lpad(F.substring_index("identifier", "_", 1), 4, "0"), F.substring_index("identifier", "_", -3))
    named = records.withColumns({"identifier": four, "label": F.when(F.substring_index("identifier", "_", 1).cast("int") % 2 == 0, "CI").otherwise("NI")})
    path = scratch_path(spark, "record-files")
    key_directory.write_records(named, path)
    lines = key_directory.read_lines(spark, path).where("label = 'CI'").select("identifier", "text")
    return _record(tables.key_rows(lines, "text"))


def key_files(spark, sf_dir) -> Frame:
    """Frequencies written as one file a sample, named by identifier and label, and read back."""
    k = F.col("sample")
    identifier = F.concat_ws("_", F.concat((k % 10).cast("string"), F.lpad(F.hex(k % 4096), 3, "0")), F.lit("A"), k.cast("string"), F.lit("NAG"))
    freq = frequencies(spark, sf_dir).select(identifier.alias("identifier"), F.when(k % 3 == 0, "CI").when(k % 3 == 1, "NCI").otherwise("").alias("label"), "key", "freq")
    path = scratch_path(spark, "key-files")
    key_directory.write_frequencies(freq, path)
    return key_directory.read_frequencies(spark, path).select("identifier", "label", "key", "freq")


def matrix_files(spark, sf_dir) -> Frame:
    """The distance matrix written as numbered lines and read back."""
    f = frequencies(spark, sf_dir).groupBy(F.col("grp").alias("sample"), "key").agg(F.sum("freq").alias("freq"))
    cells = similarity.distance_matrix(f).select("id_i", F.struct("id_j", F.round("d", 6).cast("decimal(20,6)").alias("d")).alias("c"))
    ds = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["d"].cast("string")), ",")
    lines = cells.groupBy("id_i").agg(F.concat(F.first("id_i").cast("string"), F.lit(";"), ds).alias("line")).select(F.col("id_i").alias("ln"), "line")
    path = scratch_path(spark, "matrix-files")
    tables.write_numbered(lines, path)
    return tables.distance_rows(spark, path).select(F.col("id_i").cast("int").alias("id_i"), F.col("id_j").cast("int").alias("id_j"), F.col("d").cast("double").alias("d"))


def annotated_lines(spark, sf_dir) -> Frame:
    """Lines of a generalised file whose first fields take the labels of the same residues, named in the other order."""
    n = _names(spark, sf_dir).where("c_custkey % 5 = 0").withColumn("seq", F.split("identifier", "_"))
    lines = n.select(F.col("c_custkey").alias("ln"), F.concat("identifier", F.lit(";"), F.col("c_custkey").cast("string"), F.lit(",0")).alias("line"))
    four = F.concat_ws("_", F.get("seq", F.lit(2)), F.get("seq", F.lit(0)), F.get("seq", F.lit(1)), F.get("seq", F.lit(3)))
    known = n.where("c_custkey % 4 <> 1").select(four.alias("identifier"), F.when(F.col("c_custkey") % 2 == 0, "I").otherwise("NI").alias("label"))
    return labels.annotate_lines(lines, known, strict=False)


def chain_triplets(spark, sf_dir) -> Frame:
    """Keys of chains of a hundred atoms, which are enumerated by blocks."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: (F.col("embedding")[i].cast("double") * 40)
    a = e.select(F.floor(F.col("vec_id") / 100).cast("long").alias("struct"), (F.col("vec_id") % 100).cast("int").alias("idx"), (F.col("label") + 1).cast("int").alias("code"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
    return triplets.key_frequency(triplets.triplet_keys(a, ["struct"]), ["struct"])


def _vectors(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", (F.col("label") % 2).cast("double").alias("label"), F.col("label").alias("kind"), F.col("embedding").cast("array<double>").alias("v"))


def nearest_neighbours(spark, sf_dir) -> Frame:
    v = _vectors(spark, sf_dir)
    return neighbours.nearest(v, v, 3, "vec_id", "v", "kind").select("kind", "vec_id", "rank", "neighbour", F.round("distance", 6).alias("distance"))


def interpolated_rows(spark, sf_dir) -> Frame:
    out = balance.smote(_vectors(spark, sf_dir), "label", "vec_id", "v")
    return out.select("label", "vec_id", "copy", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(63)), 6).alias("last"))


def edited_rows(spark, sf_dir) -> Frame:
    return balance.edited(_vectors(spark, sf_dir), "label", "vec_id", "v").select("vec_id", "label")


def balanced_rows(spark, sf_dir) -> Frame:
    return labels.balanced_sample(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey")


def oversampled_rows(spark, sf_dir) -> Frame:
    return balance.balance_oversample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "lang", "copy")


def split_rows(spark, sf_dir) -> Frame:
    return labels.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.25, 0.25)


def feature_quantiles(spark, sf_dir) -> Frame:
    out = quantiles.exact_quantiles(_features(spark, sf_dir), FEATURES, [0.25, 0.5, 0.75])
    return out.select("column", "share", F.round("value", 9).alias("value"))


def split_sizes(spark, sf_dir) -> Frame:
    d = labels.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.25, 0.25)
    return labels.split_statistics(d, "lang").select("split", "lang", "n")


def grouped_split(spark, sf_dir) -> Frame:
    d = labels.grouped_split(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "lang", "source")
    return labels.split_report(d, "lang", "source")


def _predictions(spark, sf_dir) -> DataFrame:
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return l.join(d.select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") > 900).cast("int").alias("p"), F.least(F.floor(F.col("n_chars") / 100), F.lit(40)).cast("double").alias("score"))


def class_report(spark, sf_dir) -> Frame:
    return metrics.class_report(_predictions(spark, sf_dir)).select("class", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def metric_summary(spark, sf_dir) -> Frame:
    out = metrics.summary(_predictions(spark, sf_dir))
    return out.select(*[F.round(c, 9).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")])


def confusion(spark, sf_dir) -> Frame:
    return metrics.normalised_confusion(_predictions(spark, sf_dir)).select("y", "p", "n", F.round("share", 9).alias("share"))


def binary_auc(spark, sf_dir) -> Frame:
    return metrics.binary_auc(_predictions(spark, sf_dir)).select(F.round("roc_auc", 9).alias("roc_auc"), F.round("average_precision", 9).alias("average_precision"))


def confidence_histogram(spark, sf_dir) -> Frame:
    rows = _predictions(spark, sf_dir).select((F.col("score") / 40).alias("confidence"))
    return metrics.confidence_histogram(rows)


def missing_report(spark, sf_dir) -> Frame:
    c = table(spark, sf_dir, "customer").select("c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, F.lit("x")).otherwise(F.col("c_acctbal").cast("string")).alias("balance"))
    return models.missing_report(models.numeric(c, ["c_mktsegment", "balance"]), ["c_mktsegment", "balance"])


FEATURES = [f"f{i}" for i in range(64)]


def _features(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", (F.col("label") % 2).cast("double").alias("label"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(FEATURES)])


def forest_predictions(spark, sf_dir) -> Frame:
    rows = labels.stratified_split(_features(spark, sf_dir), "label", "vec_id")
    train = rows.where("split = 'train'")
    state = models.fit_preprocessor(train, FEATURES, scaler="none")
    model = models.train(train, state, models.classifier("random_forest"))
    return models.predict(rows.where("split = 'test'"), model).select("vec_id", "label", "prediction", "confidence", "is_correct")


def logistic_predictions(spark, sf_dir) -> Frame:
    rows = labels.class_weights(labels.stratified_split(_features(spark, sf_dir), "label", "vec_id"), "label")
    train = rows.where("split = 'train'")
    state = models.fit_preprocessor(train, FEATURES)
    model = models.train(train, state, models.classifier("logistic_regression", weight="weight"))
    return models.predict(rows.where("split = 'test'"), model).select("vec_id", "label", "prediction", "confidence", "is_correct")


def saved_model(spark, sf_dir) -> Frame:
    """How many test rows there are, and how many a model scores alike before and after it was saved."""
    rows = labels.stratified_split(_features(spark, sf_dir), "label", "vec_id")
    train = rows.where("split = 'train'")
    model = models.train(train, models.fit_preprocessor(train, FEATURES), models.classifier("logistic_regression", maxIter=20))
    path = scratch_path(spark, "model")
    models.save(model, path)
    test = rows.where("split = 'test'")
    pick = lambda m, p: models.predict(test, m).select("vec_id", F.struct("prediction", "probabilities").alias(p))
    both = pick(model, "a").join(pick(models.load(path), "b"), "vec_id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("n_alike"))


def calibrated_predictions(spark, sf_dir) -> Frame:
    rows = labels.stratified_split(_features(spark, sf_dir), "label", "vec_id")
    train = rows.where("split <> 'test'")
    model, _ = models.calibrated_svm(train, models.fit_preprocessor(train, FEATURES), "vec_id", folds=3, maxIter=10)
    return models.predict(rows.where("split = 'test'"), model).select("vec_id", "label", "prediction", "confidence", "is_correct")


def boosting_history(spark, sf_dir) -> Frame:
    learnable = _features(spark, sf_dir).withColumn("label", (F.col("f0") + F.col("f1") > F.col("f2")).cast("double"))
    rows = labels.stratified_split(learnable, "label", "vec_id").withColumn("held", F.col("split") == "val")
    return models.boost(rows.where("split <> 'test'"), models.fit_preprocessor(rows.where("split = 'train'"), FEATURES, scaler="none"), "held", maxIter=10, maxDepth=3)[1]


def forest_importances(spark, sf_dir) -> Frame:
    rows = _features(spark, sf_dir)
    return models.importances(models.train(rows, models.fit_preprocessor(rows, FEATURES, scaler="none"), models.classifier("random_forest", numTrees=50, maxDepth=8)))


def evaluated_splits(spark, sf_dir) -> Frame:
    rows = labels.stratified_split(_features(spark, sf_dir), "label", "vec_id")
    train = rows.where("split = 'train'")
    return models.evaluate_splits(models.predict(rows, models.train(train, models.fit_preprocessor(train, FEATURES), models.classifier("logistic_regression", maxIter=50))))


def listed_ids(spark, sf_dir) -> Frame:
    """Ids of a list with quotes, versions and parts, each once and at its first line."""
    k = F.col("c_custkey")
    core = F.concat(F.lit("p"), (k % 400).cast("string"))
    value = F.when(k % 12 == 0, F.concat(F.lit('"'), core, F.lit('"'))).when(k % 6 == 0, F.concat(F.lit('"'), core, F.lit('" x'))).when(k % 6 == 1, F.concat(core, F.lit(".1"))).when(k % 6 == 2, F.concat(core, F.lit("-2"))).when(k % 6 == 3, F.concat(core, F.lit("?"))).when(k % 6 == 4, "").otherwise(core)
    return tables.listed_ids(table(spark, sf_dir, "customer").select(k.alias("line"), value.alias("Entry_ID"), F.lit("other").alias("note")))


def _seed_rows(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    columns = {"pdb_id": F.concat(text(k % 10), F.lpad(F.hex(k % 300), 3, "0")), "chain": F.when(k % 3 == 0, "A").otherwise("b"), "aa": F.when(k % 4 == 0, "man").otherwise("Nag"), "resnumber": F.when(k % 7 == 0, "").when(k % 7 == 1, F.concat_ws(";", text(k % 90), F.concat(text(k % 50), F.lit(".0")))).otherwise(text(k % 90)), "lable": F.when(k % 5 == 0, "nci").when(k % 5 == 1, "").otherwise("ci")}
    return table(spark, sf_dir, "customer").select(k.alias("line"), *[v.alias(c) for c, v in columns.items()])


def seed_residues(spark, sf_dir) -> Frame:
    return residues.seeds(_seed_rows(spark, sf_dir), "line", "NAG")[0]


def seed_counters(spark, sf_dir) -> Frame:
    return residues.seeds(_seed_rows(spark, sf_dir), "line", "NAG")[1]


def first_seed_ids(spark, sf_dir) -> Frame:
    """A report of the first hundred structures that seeds name."""
    return tables.first_ids(seed_residues(spark, sf_dir).select("line", F.col("pdb").alias("id")), 100)


def component_interactions(spark, sf_dir) -> Frame:
    """Nearest contacts of one component's residues, from atom identifiers and written distances."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    atom = F.concat_ws("_", F.concat(F.lit("x_1AB"), (F.col("o_custkey") % 40).cast("string")), F.when(k % 2 == 0, "A").otherwise("b"), F.when(k % 3 == 0, "man").when(k % 3 == 1, "MAN").otherwise("NAG"), (k % 11).cast("string"), F.lit("C1"))
    rows = o.select(k.alias("line"), atom.alias("drug"), identifiers.half_even(F.pmod(k * 7, F.lit(60)) / 20, 1).alias("distance"))
    return contacts.component_interactions(rows, "Man")


def chain_group_files(spark, sf_dir) -> Frame:
    """Key files of some chain groups, by exact and by partial match, and the last parts of their names."""
    n = _names(spark, sf_dir).select("c_custkey", "identifier", F.concat("identifier", F.lit(".keys_theta29_dist18")).alias("name"))
    group = identifiers.chain_group(F.col("name"))
    return n.select("c_custkey", group.alias("grp"), identifiers.file_residue(F.col("name")).alias("residue"), identifiers.in_groups(group, ["nnb", "NAG "]).alias("exact"), identifiers.in_groups(group, ["N"], "contains").alias("partial"), identifiers.token(F.col("identifier"), 2).alias("third"))


def located_structures(spark, sf_dir) -> Frame:
    """Structures in two folders under any of their names."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    pdb = F.concat(F.lit("1A"), F.lpad(F.hex(F.col("k") % 256), 2, "0"))
    names = structures.structure_names(pdb)
    listing = c.where("k % 3 > 0").select(F.when(F.col("k") % 2 == 0, "cache").otherwise("local").alias("folder"), F.get(names, (F.col("k") % 6).cast("int")).alias("name")).distinct()
    return structures.located(c.select(pdb.alias("pdb")), listing, ["local", "cache"])


def sample_targets(spark, sf_dir) -> Frame:
    """Residue targets of a table whose columns have other names."""
    rows = _sample_rows(spark, sf_dir).select("line", F.col("protein").alias("Protein"), F.col("Chain ID").alias("the chain"), F.col("carb_name").alias("LIGAND"), F.col("SeqNum").alias("carb_id"), "chain_group")
    return targets.residue_targets(tables.sample_rows(rows, "line", chain="the chain")).select("line", "identifier", "name", "seq")


def skipped_samples(spark, sf_dir) -> Frame:
    rows = _sample_rows(spark, sf_dir).withColumnRenamed("Chain ID", "chain")
    return tables.skipped_rows(tables.sample_rows(rows, "line"))


def split_audit(spark, sf_dir) -> Frame:
    """Diagnostics of a split by rows, whose groups it does not respect."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    rare = d.withColumn("lang", F.when(F.col("doc_id") == 7, "rare").otherwise(F.col("lang")))
    out = labels.split_audit(rare.withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").when(F.col("doc_id") % 5 == 1, "val").otherwise("train")), "lang", "source")
    return out.select("kind", "split", "n", F.array_join("classes", ",").alias("classes"))


def labelled_order(spark, sf_dir) -> Frame:
    """Residues in the order of a sample table, with their places."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).cast("string").alias("protein"), F.element_at(F.array(*[F.lit(x) for x in (" ", "B", "a")]), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("chain"), F.when(F.col("o_orderkey") % 4 == 0, "CI").otherwise("NCI").alias("label"), F.concat((F.col("o_orderkey") % 30).cast("string"), F.when(F.col("o_orderkey") % 7 == 0, "A").otherwise("")).alias("seq"), F.col("o_orderkey").cast("string").alias("aa"))
    return residues.in_label_order(o, seq="seq").select("o_orderkey", "place")


QUERIES = {
    f.__name__: f
    for f in (triplet_keys, mirror_keys, triplet_bins, triplet_summary, atom_count_filter, search_atoms, fixed_width, common_keys, common_key_summary, key_percent, one_vs_all, feature_table, feature_frequency, generalised_jaccard, set_jaccard, distance_matrix, matrix_faults, similarity_text, adjusted_rand, clusters, contact_pairs, interaction_labels, linked_residues, discovery_labels, aggregated_residues, exploded_residues, parsed_identifiers, label_join, resolved_files, balanced_sizes, oversampled_sizes, class_weights, frequent_classes, legacy_files, renamed_files, coded_names, half_even_texts, chains_in_order, search_samples, search_chain_samples, search_counters, residue_targets, chain_targets, target_keys, split_sizes, grouped_split, class_report, metric_summary, confusion, binary_auc, confidence_histogram, missing_report, forest_predictions, logistic_predictions, target_records, record_files, key_files, matrix_files, annotated_lines, chain_triplets, nearest_neighbours, interpolated_rows, edited_rows, balanced_rows, oversampled_rows, split_rows, feature_quantiles, saved_model, calibrated_predictions, boosting_history, forest_importances, evaluated_splits, listed_ids, seed_residues, seed_counters, first_seed_ids, component_interactions, chain_group_files, located_structures, sample_targets, skipped_samples, split_audit, labelled_order)
}

#: Lines of made structure files.
LINES = ("HEADER    X", "data_1ABC", "JRNL        AUTH", "note PDBx/mmCIF", "TITLE", "REMARK PDBx/mmCIF", "xyz", "TER   1", "CRYST1", "", "MODEL", "END")

ATOMS = "atoms AS (SELECT vec_id // 12 AS struct, vec_id % 12 AS idx, label + 1 AS code, embedding[1]::DOUBLE * 40 AS x, embedding[2]::DOUBLE * 40 AS y, embedding[3]::DOUBLE * 40 AS z FROM embeddings)"
FREQ = """freq AS (SELECT l_suppkey AS sample, s_nationkey AS grp, r_name AS region, p_size::BIGINT AS key, count(*) AS freq
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""
BY_GROUP = "freq AS (SELECT grp AS sample, key, sum(freq)::BIGINT AS freq FROM base GROUP BY ALL)"


def _d(a: str, b: str) -> str:
    return f"sqrt(pow({a}.x - {b}.x, 2) + pow({a}.y - {b}.y, 2) + pow({a}.z - {b}.z, 2))"


def _keys(mirror: bool = False, extra: str = "") -> str:
    """The triplets with their keys, as SQL of its own."""
    bins = " + ".join(["1", *[f"(theta >= {e})::INT" for e in geometry.THETA_EDGES]])
    sign = "CASE WHEN theta1 > 90 THEN -1 ELSE 1 END * " if mirror else ""
    atom = lambda p: f"struct_pack(idx := {p}.idx, code := {p}.code, x := {p}.x, y := {p}.y, z := {p}.z)"
    pair = lambda p, q, r, dp, dq: f"CASE WHEN {p}.code > {r}.code THEN CASE WHEN {dq} > {dp} THEN [{q}, {p}, {r}] ELSE [{p}, {q}, {r}] END ELSE CASE WHEN {dq} > {dp} THEN [{r}, {q}, {p}] ELSE [{r}, {p}, {q}] END END"
    return f"""{ATOMS},
    t AS (SELECT a.struct, {atom('a')} AS p, {atom('b')} AS q, {atom('c')} AS r FROM atoms a JOIN atoms b ON a.struct = b.struct AND a.idx < b.idx JOIN atoms c ON a.struct = c.struct AND b.idx < c.idx),
    t2 AS MATERIALIZED (SELECT *, {_d('p', 'q')} AS d12, {_d('p', 'r')} AS d13, {_d('q', 'r')} AS d23 FROM t),
    v AS MATERIALIZED (SELECT struct, CASE WHEN p.code = q.code AND q.code = r.code THEN CASE WHEN d12 >= d13 AND d12 >= d23 THEN [p, q, r] WHEN d13 >= d23 THEN [p, r, q] ELSE [q, r, p] END
        WHEN p.code = q.code THEN {pair('p', 'q', 'r', 'd13', 'd23')} WHEN p.code = r.code THEN {pair('p', 'r', 'q', 'd12', 'd23')} WHEN q.code = r.code THEN {pair('q', 'r', 'p', 'd12', 'd13')}
        WHEN p.code > q.code AND q.code > r.code THEN [p, q, r] WHEN p.code > r.code AND r.code > q.code THEN [p, r, q] WHEN q.code > p.code AND p.code > r.code THEN [q, p, r]
        WHEN q.code > r.code AND r.code > p.code THEN [q, r, p] WHEN r.code > p.code AND p.code > q.code THEN [r, p, q] ELSE [r, q, p] END AS v FROM t2),
    w AS MATERIALIZED (SELECT struct, v[1] AS v1, v[2] AS v2, v[3] AS v3, struct_pack(x := (v[1].x + v[2].x) / 2, y := (v[1].y + v[2].y) / 2, z := (v[1].z + v[2].z) / 2) AS m FROM v),
    g AS MATERIALIZED (SELECT *, {_d('v1', 'v2')} AS d01, {_d('v1', 'v3')} AS d02, {_d('v2', 'v3')} AS dd, {_d('m', 'v3')} AS d3 FROM w),
    h AS MATERIALIZED (SELECT *, greatest(d01, d02, dd) AS max_dist, 180 * acos((pow(d02, 2) - pow(d01 / 2, 2) - pow(d3, 2)) / (2 * (d01 / 2) * d3)) / 3.14::DOUBLE AS theta1 FROM g),
    h2 AS MATERIALIZED (SELECT *, CASE WHEN theta1 <= 90 THEN theta1 ELSE abs(180 - theta1) END AS theta FROM h),
    h3 AS MATERIALIZED (SELECT *, {bins} AS theta_bin, least(floor(max_dist) + 1, 18)::INT AS dist_bin FROM h2),
    keys AS (SELECT *, {sign}(18 * 29 * 112 * 112 * (v1.code - 1)::BIGINT + 18 * 29 * 112 * (v2.code - 1) + 18 * 29 * (v3.code - 1) + 29 * (dist_bin - 1) + theta_bin - 1) AS key FROM h3)"""


_LINKS = f"""{ATOMS}, e AS (SELECT a.struct * 12 + a.idx AS a, b.struct * 12 + b.idx AS b FROM atoms a JOIN atoms b ON a.struct = b.struct AND a.idx <> b.idx AND {_d('a', 'b')} <= 7)"""
_JACCARD = """t AS (SELECT sample, sum(freq) AS t FROM freq GROUP BY 1),
    j AS (SELECT a.sample AS id_i, b.sample AS id_j, sum(least(a.freq, b.freq)) AS low FROM freq a JOIN freq b ON a.key = b.key AND a.sample < b.sample GROUP BY ALL),
    jaccard AS (SELECT id_i, id_j, low / (x.t + y.t - low)::DOUBLE AS jaccard FROM j JOIN t x ON x.sample = id_i JOIN t y ON y.sample = id_j)"""
_PRED = "pred AS (SELECT doc_id, quality AS y, (n_chars > 900)::INT AS p, least(n_chars // 100, 40)::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"
_REPORT = """rep AS (SELECT class, coalesce(sum(s), 0)::BIGINT AS support, coalesce(sum(h), 0)::DOUBLE AS hits, coalesce(sum(q), 0)::DOUBLE AS predicted FROM (
        SELECT y AS class, 1 AS s, (y = p)::INT AS h, 0 AS q FROM pred UNION ALL SELECT p, 0, 0, 1 FROM pred) GROUP BY class),
    pr AS (SELECT class, support, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall FROM rep),
    report AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)"""
_SEQ = "s AS (SELECT DISTINCT o_custkey, (o_orderkey % 500)::VARCHAR || CASE WHEN o_orderkey % 7 = 0 THEN 'A' ELSE '' END AS seq, (o_orderkey % 500) AS num FROM orders)"
_NAMES = """base AS (SELECT c_custkey, (c_custkey % 10)::VARCHAR || lpad(printf('%X', c_custkey % 4096), 3, '0') AS pdb, ['A', 'B', 'C', 'g'][c_nationkey % 4 + 1] AS chain, (c_custkey % 300)::VARCHAR AS seq,
        ['CI', 'NCI', ''][c_custkey % 3 + 1] AS label, c_custkey % 5 AS kind FROM customer)"""

_SAMPLES = """rows AS (SELECT c_custkey AS line, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE (c_custkey % 10) || lpad(printf('%X', c_custkey % 256), 3, '0') END AS protein, CASE WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'b' END AS chain,
        ['NAG', 'man', ''][c_custkey % 3 + 1] AS name, CASE c_custkey % 4 WHEN 0 THEN [(c_custkey % 30)::VARCHAR, (c_custkey % 9)::VARCHAR] WHEN 1 THEN [(c_custkey % 30)::VARCHAR] ELSE [] END AS seqs,
        CASE WHEN c_custkey % 5 = 0 THEN 'nnb' ELSE '' END AS code, CASE c_custkey % 7 WHEN 0 THEN 'CI' WHEN 1 THEN 'other' ELSE '' END AS grp FROM customer),
    filled AS (SELECT * FROM rows WHERE protein || chain || name || array_to_string(seqs, '') || code || grp <> '')"""


_SEEDS = """r AS (SELECT c_custkey AS line, upper((c_custkey % 10) || lpad(printf('%X', c_custkey % 300), 3, '0')) AS pdb, CASE WHEN c_custkey % 3 = 0 THEN 'A' ELSE 'b' END AS chain, c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 AS own,
        CASE c_custkey % 7 WHEN 0 THEN [] WHEN 1 THEN [(c_custkey % 90)::VARCHAR, (c_custkey % 50)::VARCHAR] ELSE [(c_custkey % 90)::VARCHAR] END AS seqs FROM customer), s AS (SELECT *, own AND len(seqs) > 0 AS used FROM r)"""


def _samples(mode: str) -> str:
    """The samples of the table as SQL: numbers only outside the chain mode."""
    by_seq = "name <> '' AND len(seqs) > 0" if mode != "chain" else "false"
    return f"""{_SAMPLES}, made AS (SELECT *, CASE WHEN protein = '' OR chain = '' THEN [NULL] WHEN {by_seq} THEN list_transform(seqs, lambda x: concat_ws('_', protein, chain, x, name)) WHEN code <> '' THEN [concat_ws('_', protein, chain, code)] ELSE [concat_ws('_', protein, chain)] END AS ids FROM filled),
    one AS (SELECT *, unnest(ids) AS identifier, generate_subscripts(ids, 1) - 1 AS nth FROM made),
    kinds AS (SELECT *, CASE WHEN {by_seq} THEN 'PDB_CHAIN_SEQ_RESIDUE' WHEN code <> '' THEN 'PDB_CHAIN_GROUP' ELSE 'PDB_CHAIN' END AS kind,
        CASE WHEN {by_seq} THEN concat_ws('_', protein, chain, seqs[nth + 1], upper(name)) WHEN code <> '' THEN concat_ws('_', protein, chain, upper(code)) ELSE identifier END AS canon FROM one WHERE identifier IS NOT NULL),
    samples AS (SELECT min(struct_pack(line := line, nth := nth)) AS place, arg_max(identifier, struct_pack(line := line, nth := nth)) AS protein, grp, canon, kind FROM kinds GROUP BY canon, grp, kind)"""


#: The atoms of the targets: three residues of four atoms a structure, coordinates as structure lines hold them.
_TARGET_ATOMS = "atoms AS (SELECT vec_id // 4 AS struct, vec_id % 4 AS idx, label + 1 AS code, printf('%.3f', embedding[1]::DOUBLE * 40)::DOUBLE AS x, printf('%.3f', embedding[2]::DOUBLE * 40)::DOUBLE AS y, printf('%.3f', embedding[3]::DOUBLE * 40)::DOUBLE AS z FROM embeddings)"
_VECTORS = "v AS (SELECT vec_id, (label % 2)::DOUBLE AS label, label AS kind, embedding::DOUBLE[] AS e FROM embeddings)"


def _records(identifier: str, where: str = "true") -> str:
    vertex = ", ".join(f"'C' || v{i}.code AS atom{i}, (struct % 3)::VARCHAR AS seq{i}, v{i}.x AS x{i}, v{i}.y AS y{i}, v{i}.z AS z{i}" for i in (1, 2, 3))
    return f"WITH {_keys().replace(ATOMS, _TARGET_ATOMS)} SELECT {identifier} || '_A_' || (struct % 3) || '_NAG' AS identifier, key, {vertex}, theta_bin, round(theta, 6) AS theta, dist_bin, round(max_dist, 6) AS max_dist FROM keys WHERE {where}"


ORACLES = {
    "search_samples": f"WITH {_samples('auto')} SELECT place.line AS line, place.nth::INT AS nth, protein, grp, canon, kind, NULL::VARCHAR AS fault FROM samples UNION ALL SELECT line, 0, '', grp, '', 'RAW', 'unparsable' FROM one WHERE identifier IS NULL",
    "search_chain_samples": f"WITH {_samples('chain')} SELECT place.line AS line, protein, grp, canon, kind, NULL::VARCHAR AS fault FROM samples UNION ALL SELECT line, '', grp, '', 'RAW', 'unparsable' FROM one WHERE identifier IS NULL",
    "search_counters": f"""WITH {_samples('chain')}, o AS (SELECT (o_custkey % 10) || lpad(printf('%X', o_custkey % 256), 3, '0') || CASE WHEN o_custkey % 2 = 0 THEN '_A' ELSE '_b' END AS key, CASE WHEN o_custkey % 3 = 0 THEN 'CI' ELSE '' END AS fl, o_orderkey % 3 <> 2 AS good, o_orderkey % 3 <> 2 AND o_orderkey % 4 = 3 AS hit FROM orders),
        f AS (SELECT key, fl, count(*) FILTER (good) AS r, count(*) FILTER (hit) AS m, count(*) FILTER (NOT good) AS b FROM o GROUP BY ALL), n AS (SELECT key, count(*) AS n FROM f GROUP BY key),
        j AS (SELECT s.canon, s.grp, f.*, CASE WHEN f.key IS NULL THEN 9 WHEN fl = grp THEN 0 WHEN fl = '' THEN 1 WHEN grp = '' AND n = 1 THEN 2 ELSE 8 END AS rank FROM samples s LEFT JOIN f ON f.key = s.canon LEFT JOIN n ON n.key = s.canon),
        t AS (SELECT canon, grp, min(rank) AS best, arg_min(r, rank) AS r, arg_min(m, rank) AS m, arg_min(b, rank) AS b FROM j GROUP BY ALL)
        SELECT count(*) AS samples, count(*) FILTER (best <= 2) AS key_files_found, count(*) FILTER (best = 9) AS key_files_missing, count(*) FILTER (best = 8) AS ambiguous_key_files,
        coalesce(sum(r) FILTER (best <= 2), 0)::BIGINT AS rows_read, coalesce(sum(m) FILTER (best <= 2), 0)::BIGINT AS rows_matched, coalesce(sum(b) FILTER (best <= 2), 0)::BIGINT AS malformed_rows FROM t""",
    "residue_targets": f"WITH {_SAMPLES}, one AS (SELECT *, unnest(seqs) AS seq FROM rows WHERE protein <> '' AND chain <> '' AND name <> '') SELECT line, concat_ws('_', protein, chain, seq, name) AS identifier, name, seq FROM one",
    "chain_targets": f"""WITH {_SAMPLES}, one AS (SELECT *, unnest(CASE WHEN name = '' OR len(seqs) = 0 THEN [NULL] ELSE seqs END) AS seq, generate_subscripts(CASE WHEN name = '' OR len(seqs) = 0 THEN [NULL] ELSE seqs END, 1) AS nth FROM rows WHERE protein <> '' AND chain <> '')
        SELECT min(line) AS line, protein || '_' || chain AS identifier, coalesce(string_agg(name, ',' ORDER BY seq::INT, line, nth) FILTER (seq IS NOT NULL), '') AS summary_names, coalesce(array_to_string(list_transform(list_sort(list_distinct(list(seq::INT) FILTER (seq IS NOT NULL))), lambda x: x::VARCHAR), ','), '') AS summary_seqs FROM one GROUP BY protein, chain""",
    "listed_ids": """SELECT min(c_custkey) AS line, id FROM (SELECT c_custkey, CASE WHEN c_custkey % 6 IN (3, 4) OR c_custkey % 12 = 6 THEN NULL WHEN c_custkey % 6 = 2 AND length('p' || (c_custkey % 400)) < 4 THEN NULL ELSE 'P' || (c_custkey % 400) END AS id FROM customer) WHERE id IS NOT NULL GROUP BY id""",
    "seed_residues": f"WITH {_SEEDS} SELECT line, pdb, chain, 'NAG' AS name, unnest(list_distinct(seqs)) AS seq FROM s WHERE used",
    "seed_counters": f"WITH {_SEEDS} SELECT count(*) AS rows_read, count(*) FILTER (used) AS rows_used, count(*) FILTER (own AND NOT used) AS rows_without_number FROM s",
    "first_seed_ids": f"WITH {_SEEDS} SELECT min(line) AS line, pdb AS id FROM s WHERE used GROUP BY pdb ORDER BY line LIMIT 100",
    "component_interactions": """WITH r AS (SELECT o_orderkey AS line, 'x_1AB' || (o_custkey % 40) AS protein, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'b' END AS chain, ['man', 'MAN', 'NAG'][o_orderkey % 3 + 1] AS carb_name, (o_orderkey % 11)::VARCHAR AS carb_res, printf('%.1f', ((o_orderkey * 7) % 60) / 20)::DOUBLE AS d FROM orders)
        SELECT protein, chain, carb_name, carb_res, min(d) AS min_distance, min(line) AS line, CASE WHEN min(d) <= 1.5 THEN 'ci' WHEN min(d) <= 2 THEN 'wci' ELSE 'nci' END AS label FROM r WHERE upper(carb_name) = 'MAN' GROUP BY ALL""",
    "chain_group_files": f"""WITH {_NAMES}, n AS (SELECT c_custkey, CASE kind WHEN 0 THEN [pdb, chain, seq, 'NAG'] WHEN 1 THEN [seq, pdb, chain, 'man'] WHEN 2 THEN [pdb, chain, 'NNB'] WHEN 3 THEN [pdb, chain] ELSE ['x-' || c_custkey] END AS p, CASE WHEN kind < 3 AND label <> '' THEN [label] ELSE [] END AS l FROM base), q AS (SELECT c_custkey, list_concat(p, l) AS p FROM n)
        SELECT c_custkey, CASE WHEN len(p) >= 3 THEN upper(p[-1]) END AS grp, p[-1] AS residue, len(p) >= 3 AND upper(p[-1]) IN ('NNB', 'NAG') AS exact, len(p) >= 3 AND contains(upper(p[-1]), 'N') AS partial, p[3] AS third FROM q""",
    "located_structures": """WITH i AS (SELECT c_custkey AS k, '1A' || lpad(printf('%X', c_custkey % 256), 2, '0') AS pdb FROM customer), v AS (SELECT k, pdb, [pdb || '.pdb', lower(pdb) || '.pdb', 'pdb' || lower(pdb) || '.ent', pdb || '.pdb.gz', lower(pdb) || '.pdb.gz', 'pdb' || lower(pdb) || '.ent.gz'] AS names FROM i),
        f AS (SELECT DISTINCT CASE WHEN k % 2 = 0 THEN 'cache' ELSE 'local' END AS folder, names[k % 6 + 1] AS name FROM v WHERE k % 3 > 0), n AS (SELECT DISTINCT pdb, unnest(names) AS name, generate_subscripts(names, 1) AS nth FROM v)
        SELECT pdb, arg_min(folder || '/' || f.name, (folder = 'cache')::INT * 10 + nth) FILTER (folder IS NOT NULL) AS path FROM n LEFT JOIN f USING (name) GROUP BY pdb""",
    "sample_targets": f"WITH {_SAMPLES}, one AS (SELECT *, unnest(seqs) AS seq FROM rows WHERE protein <> '' AND chain <> '' AND name <> '') SELECT line, concat_ws('_', protein, chain, seq, name) AS identifier, name, seq FROM one",
    "skipped_samples": f"WITH {_SAMPLES}, m AS (SELECT line, concat_ws(',', CASE WHEN protein = '' THEN 'protein' END, CASE WHEN chain = '' THEN 'chain' END, CASE WHEN name = '' THEN 'name' END, CASE WHEN len(seqs) = 0 THEN 'seq' END) AS missing FROM rows) SELECT * FROM m WHERE missing <> ''",
    "split_audit": """WITH d AS (SELECT CASE WHEN doc_id = 7 THEN 'rare' ELSE lang END AS lang, source, CASE doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM documents),
        s AS (SELECT split, count(*) AS r, count(DISTINCT source) AS g, count(DISTINCT lang) AS c FROM d GROUP BY split), g AS (SELECT DISTINCT split, source FROM d), l AS (SELECT DISTINCT lang FROM d)
        SELECT 'rows' AS kind, split, r AS n, NULL::VARCHAR AS classes FROM s UNION ALL SELECT 'groups', split, g, NULL FROM s UNION ALL SELECT 'classes', split, c, NULL FROM s
        UNION ALL SELECT 'overlap', a.split || '_' || b.split, count(*), NULL FROM g a JOIN g b ON a.source = b.source AND a.split < b.split GROUP BY ALL
        UNION ALL SELECT 'missing', split, count(*), string_agg(lang, ',' ORDER BY lang) FROM (SELECT s.split, l.lang FROM s CROSS JOIN l EXCEPT SELECT split, lang FROM d) GROUP BY split
        UNION ALL SELECT 'few groups', '', count(*), string_agg(lang, ',' ORDER BY lang) FROM (SELECT lang FROM d GROUP BY lang HAVING count(DISTINCT source) < 3) HAVING count(*) > 0""",
    "labelled_order": """WITH o AS (SELECT o_orderkey, (o_custkey % 50)::VARCHAR AS protein, trim([' ', 'B', 'a'][o_orderkey % 3 + 1]) AS chain, o_orderkey % 4 <> 0 AS other, o_orderkey % 30 AS num, CASE WHEN o_orderkey % 7 = 0 THEN 'A' ELSE '' END AS code, o_orderkey::VARCHAR AS aa FROM orders)
        SELECT o_orderkey, row_number() OVER (ORDER BY protein, other, chain = '', chain, num, code, aa) AS place FROM o""",
    "target_records": _records("(struct // 3)"),
    "record_files": _records("lpad((struct // 3)::VARCHAR, 4, '0')", "(struct // 3) % 2 = 0"),
    "key_files": f"WITH {FREQ} SELECT (sample % 10) || lpad(printf('%X', sample % 4096), 3, '0') || '_A_' || sample || '_NAG' AS identifier, ['CI', 'NCI', ''][sample % 3 + 1] AS label, key, freq FROM freq",
    "annotated_lines": f"""WITH {_NAMES}, n AS (SELECT c_custkey AS ln, concat_ws('_', pdb, chain, seq, 'NAG') AS id, label, [concat_ws('_', seq, pdb, chain, 'NAG')] AS _, upper(pdb) || chain || seq AS place FROM base WHERE kind = 0),
        k AS (SELECT place, list(DISTINCT CASE WHEN ln % 2 = 0 THEN 'I' ELSE 'NI' END) AS ls FROM n WHERE ln % 4 <> 1 GROUP BY place)
        SELECT ln, id || CASE WHEN label <> '' THEN '_' || label ELSE '' END || CASE WHEN len(ls) = 1 THEN '_' || ls[1] ELSE '' END || ';' || ln || ',0' AS line, CASE WHEN ls IS NULL THEN 'unmatched' WHEN len(ls) = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM n LEFT JOIN k USING (place)""",
    "chain_triplets": "WITH " + _keys().replace(ATOMS, ATOMS.replace("vec_id // 12", "vec_id // 100").replace("vec_id % 12", "vec_id % 100")) + " SELECT struct, key, count(*) AS freq FROM keys GROUP BY ALL",
    "nearest_neighbours": f"WITH {_VECTORS} SELECT a.kind, a.vec_id, (row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id))::INT AS rank, b.vec_id AS neighbour, round(list_distance(a.e, b.e), 6) AS distance FROM v a JOIN v b ON a.kind = b.kind AND a.vec_id <> b.vec_id QUALIFY rank <= 3",
    "edited_rows": f"""WITH {_VECTORS}, n AS (SELECT a.vec_id, a.label, b.label AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS r FROM v a JOIN v b ON a.vec_id <> b.vec_id QUALIFY r <= 3)
        SELECT vec_id, label FROM v WHERE vec_id NOT IN (SELECT vec_id FROM n WHERE label <> other)""",
    "interpolated_rows": f"""WITH {_VECTORS}, c AS (SELECT label, count(*) AS n FROM v GROUP BY 1), m AS (SELECT max(n) AS most, least(5, min(n) - 1) AS k FROM c),
        small AS (SELECT v.*, n, most, k, row_number() OVER (PARTITION BY v.label ORDER BY md5('42:' || vec_id), vec_id) AS p FROM v JOIN c ON c.label = v.label, m WHERE n < most),
        made AS (SELECT *, unnest(range(1, (most - n) // n + CASE WHEN p <= (most - n) % n THEN 2 ELSE 1 END))::INT AS copy FROM small),
        u AS (SELECT *, ('0x' || substr(md5('43:' || vec_id || ':' || copy), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS a, ('0x' || substr(md5('44:' || vec_id || ':' || copy), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS s FROM made),
        near AS (SELECT a.vec_id, b.e AS w, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS r FROM small a JOIN small b ON a.label = b.label AND a.vec_id <> b.vec_id QUALIFY r <= a.k)
        SELECT label, vec_id, 0 AS copy, round(e[1], 6) AS first, round(e[64], 6) AS last FROM v UNION ALL
        SELECT label, u.vec_id, copy, round(e[1] + s * (w[1] - e[1]), 6), round(e[64] + s * (w[64] - e[64]), 6) FROM u JOIN near ON near.vec_id = u.vec_id AND r = least(floor(a * k), k - 1) + 1""",
    "balanced_rows": "SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42:' || c_custkey), c_custkey) <= (SELECT min(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment))",
    "oversampled_rows": """WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS p, count(*) OVER (PARTITION BY lang) AS n FROM documents), m AS (SELECT max(n) AS most FROM d)
        SELECT doc_id, lang, unnest(range(1, most // n + CASE WHEN p <= most % n THEN 2 ELSE 1 END))::INT AS copy FROM d, m""",
    "split_rows": """WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS p, round(count(*) OVER (PARTITION BY lang) * 0.25::DOUBLE) AS h FROM documents)
        SELECT doc_id, lang, CASE WHEN p <= h THEN 'test' WHEN p <= 2 * h THEN 'val' ELSE 'train' END AS split FROM d""",
    "feature_quantiles": "WITH f AS (SELECT unnest(embedding)::DOUBLE AS v, 'f' || (generate_subscripts(embedding, 1) - 1) AS c FROM embeddings) SELECT c AS column, s AS share, round(CASE s WHEN 0.25 THEN quantile_cont(v, 0.25) WHEN 0.5 THEN quantile_cont(v, 0.5) ELSE quantile_cont(v, 0.75) END, 9) AS value FROM f, (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS s) GROUP BY c, s",
    "saved_model": "SELECT sum(round(n * 0.15::DOUBLE))::BIGINT AS n, sum(round(n * 0.15::DOUBLE))::BIGINT AS n_alike FROM (SELECT count(*) AS n FROM embeddings GROUP BY label % 2)",
    "target_keys": "WITH " + _keys().replace(ATOMS, _TARGET_ATOMS) + " SELECT (struct // 3) || '_A_' || (struct % 3) || '_NAG' AS identifier, key, count(*) AS freq FROM keys GROUP BY ALL",
    "triplet_keys": f"WITH {_keys()} SELECT struct, key, count(*) AS freq FROM keys GROUP BY ALL",
    "mirror_keys": f"WITH {_keys(mirror=True)} SELECT struct, key, count(*) AS freq FROM keys GROUP BY ALL",
    "triplet_bins": f"WITH {_keys()} SELECT theta_bin, dist_bin, count(*) AS n FROM keys GROUP BY ALL",
    "triplet_summary": f"""WITH {_keys()}, n AS (SELECT struct, count(*) AS n_atoms FROM atoms GROUP BY 1)
        SELECT struct, any_value(n_atoms) AS n_atoms, count(*) AS n_triplets, count(DISTINCT key) AS n_keys, round(max(max_dist), 6) AS max_distance, round(min(max_dist), 6) AS min_distance FROM keys JOIN n USING (struct) GROUP BY struct""",
    "atom_count_filter": f"WITH {ATOMS} SELECT struct, 'L' || code AS res, count(*) AS n FROM atoms WHERE code BETWEEN 1 AND 7 GROUP BY ALL HAVING count(*) = 2",
    "search_atoms": f"WITH {_keys()} SELECT struct AS sample, key, 'C' || v1.code AS atom1, 'C' || v2.code AS atom2, 'C' || v3.code AS atom3 FROM keys WHERE list_sort([v1.code, v2.code, v3.code]) = [1, 2, 2]",
    "fixed_width": f"WITH {ATOMS} SELECT struct::VARCHAR AS pdb, CASE WHEN code < 10 THEN 'C' || code ELSE 'C' || code END AS label, 'NAG' AS res, 'A' AS chain, idx::VARCHAR AS seq, round(printf('%.3f', x)::DOUBLE * 1000)::BIGINT AS x1000, round(printf('%.3f', z)::DOUBLE * 1000)::BIGINT AS z1000 FROM atoms",
    "common_keys": f"WITH {FREQ} SELECT grp, key FROM freq JOIN (SELECT grp, count(DISTINCT sample) AS total FROM freq GROUP BY grp) USING (grp) GROUP BY grp, key, total HAVING count(DISTINCT sample) = total",
    "common_key_summary": f"""WITH {FREQ}, shared AS (SELECT grp, key FROM freq JOIN (SELECT grp, count(DISTINCT sample) AS total FROM freq GROUP BY grp) USING (grp) GROUP BY grp, key, total HAVING count(DISTINCT sample) = total)
        SELECT f.grp, sample, count(*) AS total_keys, count(s.key) AS common_keys, coalesce(sum(freq) FILTER (s.key IS NOT NULL), 0)::BIGINT AS common_freq FROM freq f LEFT JOIN shared s ON f.grp = s.grp AND f.key = s.key GROUP BY ALL""",
    "key_percent": f"WITH {FREQ} SELECT grp, key, count(*) AS key_occurrence, any_value(total) AS total_files, round_even(count(*) / any_value(total)::DOUBLE * 100, 3) AS key_percent FROM freq JOIN (SELECT grp, count(DISTINCT sample) AS total FROM freq GROUP BY grp) USING (grp) GROUP BY grp, key",
    "one_vs_all": f"""WITH {FREQ}, p AS (SELECT region, key, round_even(count(*) / any_value(total)::DOUBLE * 100, 3) AS pc FROM freq JOIN (SELECT region, count(DISTINCT sample) AS total FROM freq GROUP BY region) USING (region) GROUP BY region, key)
        SELECT key, {', '.join(f"coalesce(max(pc) FILTER (region = '{r}'), 0.0) AS {r.lower().replace(' ', '_')}_percent" for r in REGIONS)} FROM p GROUP BY key""",
    "feature_table": f"WITH {FREQ} SELECT sample, {', '.join(f'coalesce(max(freq) FILTER (key = {k}), 0)::BIGINT AS k{k}' for k in range(1, 51))} FROM freq GROUP BY sample",
    "feature_frequency": f"WITH {FREQ} SELECT key, sum(freq)::BIGINT AS total, count(*) FILTER (freq <> 0) AS n_samples FROM freq GROUP BY key",
    "generalised_jaccard": f"WITH {FREQ}, {_JACCARD} SELECT id_i, id_j, round(jaccard, 6) AS jaccard FROM jaccard",
    "set_jaccard": f"WITH {FREQ.replace('freq AS (', 'base AS (', 1)}, freq AS (SELECT DISTINCT grp AS sample, key, 1 AS freq FROM base), {_JACCARD} SELECT id_i, id_j, round(jaccard, 6) AS jaccard FROM jaccard",
    "distance_matrix": f"""WITH {FREQ.replace('freq AS (', 'base AS (', 1)}, {BY_GROUP}, {_JACCARD}, ids AS (SELECT DISTINCT sample FROM freq), b AS (SELECT * FROM jaccard UNION ALL SELECT id_j, id_i, jaccard FROM jaccard)
        SELECT x.sample AS id_i, y.sample AS id_j, CASE WHEN x.sample = y.sample THEN 0 ELSE round(1 - coalesce(jaccard, 0), 6) END::DOUBLE AS d FROM ids x CROSS JOIN ids y LEFT JOIN b ON id_i = x.sample AND id_j = y.sample""",
    "matrix_files": f"""WITH {FREQ.replace('freq AS (', 'base AS (', 1)}, {BY_GROUP}, {_JACCARD}, ids AS (SELECT DISTINCT sample FROM freq), b AS (SELECT * FROM jaccard UNION ALL SELECT id_j, id_i, jaccard FROM jaccard)
        SELECT x.sample::INT AS id_i, y.sample::INT AS id_j, CASE WHEN x.sample = y.sample THEN 0 ELSE round(1 - coalesce(jaccard, 0), 6) END::DOUBLE AS d FROM ids x CROSS JOIN ids y LEFT JOIN b ON id_i = x.sample AND id_j = y.sample""",
    "matrix_faults": f"WITH {FREQ}, g AS (SELECT DISTINCT grp FROM freq), b AS (SELECT count(*) = 2 AS there FROM g WHERE grp IN (1, 2)) SELECT 'range' AS fault, 1::BIGINT AS n FROM b WHERE there UNION ALL SELECT 'asymmetric', 2 FROM b WHERE there",
    "similarity_text": "SELECT p_partkey, regexp_replace(regexp_replace((100 - 2 * p_size)::DECIMAL(20,10)::VARCHAR, '0+$', ''), '\\.$', '') AS similarity FROM part",
    "adjusted_rand": """WITH c AS (SELECT lang, source, count(*)::DOUBLE AS n FROM documents GROUP BY ALL), i AS (SELECT sum(n * (n - 1) / 2) AS idx, sum(n) AS t FROM c),
        a AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY lang)), b AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY source)),
        e AS (SELECT idx, sa, sb, sa * sb / (t * (t - 1) / 2) AS ex FROM i, a, b) SELECT round((idx - ex) / ((sa + sb) / 2 - ex), 9) AS ari FROM e""",
    "contact_pairs": f"WITH {ATOMS} SELECT a.struct AS pdb, a.idx::INT AS l_idx, b.idx::INT AS r_idx, round({_d('a', 'b')}, 6) AS distance FROM atoms a JOIN atoms b ON a.struct = b.struct AND a.code <= 5 AND b.code > 5 WHERE {_d('a', 'b')} <= 6",
    "interaction_labels": f"""WITH {ATOMS}, c AS (SELECT a.struct AS pdb, a.idx::INT AS l_idx, min(printf('%.1f', floor({_d('a', 'b')}) / 4)::DOUBLE) AS m FROM atoms a JOIN atoms b ON a.struct = b.struct AND a.code <= 5 AND b.code > 5 WHERE {_d('a', 'b')} <= 12 GROUP BY ALL)
        SELECT pdb, l_idx, m AS min_distance, CASE WHEN m <= 1.5 THEN 'ci' WHEN m <= 2 THEN 'wci' ELSE 'nci' END AS label FROM c""",
    "linked_residues": f"WITH RECURSIVE {_LINKS}, n AS (SELECT struct * 12 + idx AS node, code FROM atoms), r AS (SELECT b AS node FROM e JOIN n x ON x.node = a AND x.code = 1 JOIN n y ON y.node = b AND y.code <> 1 UNION SELECT b FROM r JOIN e ON a = r.node JOIN n y ON y.node = b AND y.code <> 1) SELECT node FROM r",
    "discovery_labels": """WITH f AS (SELECT DISTINCT l_suppkey AS chain, l_partkey % 97 AS seq FROM lineitem), s AS (SELECT DISTINCT o_custkey % 120 AS chain, o_orderkey % 101 AS seq FROM orders)
        SELECT f.chain, f.seq, CASE WHEN s.chain IS NULL THEN 'NCI' ELSE 'CI' END AS label FROM f LEFT JOIN s USING (chain, seq) UNION ALL SELECT chain, seq, 'CI missing' FROM s ANTI JOIN f USING (chain, seq)""",
    "aggregated_residues": f"WITH {_SEQ} SELECT o_custkey, string_agg(seq, ';' ORDER BY num, seq) AS seqs FROM s GROUP BY o_custkey",
    "exploded_residues": f"WITH {_SEQ} SELECT seq, count(*) AS n FROM s GROUP BY seq",
    "parsed_identifiers": f"""WITH {_NAMES} SELECT c_custkey, CASE kind WHEN 0 THEN concat_ws('_', upper(pdb), chain, seq, 'NAG') WHEN 1 THEN concat_ws('_', upper(pdb), chain, seq, 'MAN') WHEN 2 THEN concat_ws('_', upper(pdb), chain, 'NNB') WHEN 3 THEN concat_ws('_', upper(pdb), chain) ELSE 'x-' || c_custkey END AS canon,
        CASE WHEN kind < 2 THEN 'PDB_CHAIN_SEQ_RESIDUE' WHEN kind = 2 THEN 'PDB_CHAIN_GROUP' WHEN kind = 3 THEN 'PDB_CHAIN' ELSE 'RAW' END AS kind, CASE WHEN kind < 3 THEN label ELSE '' END AS label FROM base""",
    "resolved_files": """WITH s AS (SELECT DISTINCT o_custkey % 200 AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'CI' ELSE '' END AS label FROM orders),
        f AS (SELECT DISTINCT o_orderkey % 230 AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'CI' WHEN o_orderkey % 5 = 0 THEN '' ELSE 'NCI' END AS fl FROM orders), c AS (SELECT key, count(*) AS n FROM f GROUP BY key),
        r AS (SELECT s.key, s.label, min(CASE WHEN fl IS NULL THEN 9 WHEN fl = label THEN 0 WHEN fl = '' THEN 1 WHEN label = '' AND n = 1 THEN 2 ELSE 8 END) AS b FROM s LEFT JOIN f USING (key) LEFT JOIN c USING (key) GROUP BY ALL)
        SELECT key, label, CASE WHEN b <= 2 THEN 'resolved' WHEN b = 8 THEN 'ambiguous' ELSE 'missing' END AS status FROM r""",
    "balanced_sizes": "SELECT c_mktsegment, min(count(*)) OVER () AS n FROM customer GROUP BY c_mktsegment",
    "oversampled_sizes": "SELECT lang, max(count(*)) OVER () AS n FROM documents GROUP BY lang",
    "class_weights": "SELECT doc_id, lang, round((SELECT count(*) FROM documents) / ((SELECT count(DISTINCT lang) FROM documents) * n)::DOUBLE, 9) AS weight FROM documents JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) USING (lang)",
    "frequent_classes": "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) >= 60)",
    "legacy_files": """WITH lines AS (SELECT c_custkey AS file, ln, (['HEADER    X', 'data_1ABC', 'JRNL        AUTH', 'note PDBx/mmCIF', 'TITLE', 'REMARK PDBx/mmCIF', 'xyz', 'TER   1', 'CRYST1', '', 'MODEL', 'END'])[(c_custkey * 7 + ln * 3) % 12 + 1] AS line FROM customer, range(4) r(ln)),
        told AS (SELECT *, line[1:6] IN ('HEADER', 'TITLE ', 'COMPND', 'SOURCE', 'KEYWDS', 'EXPDTA', 'AUTHOR', 'REVDAT', 'JRNL  ', 'REMARK', 'SEQRES', 'ATOM  ', 'HETATM', 'TER   ', 'END   ') AS good, line[1:5] = 'data_' OR contains(line, 'PDBx/mmCIF') AS bad FROM lines)
        SELECT file, coalesce(bool_or(good) FILTER (ln = first), false) AS valid FROM (SELECT *, min(ln) FILTER (good OR bad) OVER (PARTITION BY file) AS first FROM told) GROUP BY file""",
    "renamed_files": """WITH names AS (SELECT DISTINCT 'P' || (c_custkey % 50) || '.' || (c_custkey % 7) || '.keys' AS name FROM customer),
        olds AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN 'P' || (c_custkey % 50) || '.' || (c_custkey % 7) ELSE 'P' || (c_custkey % 40) END AS old FROM customer)
        SELECT name, any_value(best) || '_N' || name[length(any_value(best)) + 1:] AS new_name FROM (SELECT name, arg_max(old, length(old)) AS best FROM names LEFT JOIN olds ON name = old OR starts_with(name, old || '.') GROUP BY name) GROUP BY name""",
    "coded_names": "SELECT c_custkey, c_nationkey AS name, coalesce(n_regionkey::VARCHAR, 'N/A') AS code FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 2",
    "half_even_texts": "SELECT c_custkey, printf('%.1f', v) AS one, printf('%.2f', v) AS two, printf('%.3f', v) AS three FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey / 8 WHEN 1 THEN c_custkey / 20 WHEN 2 THEN c_custkey / 200 ELSE c_acctbal::DOUBLE / 10 END AS v FROM customer)",
    "chains_in_order": "SELECT grp, string_agg(CASE WHEN blank THEN '_' ELSE chain END, ',' ORDER BY blank, chain) AS chains FROM (SELECT DISTINCT c_nationkey AS grp, trim(([' ', 'B', 'A', '', 'c'])[c_custkey % 5 + 1]) AS chain, trim(([' ', 'B', 'A', '', 'c'])[c_custkey % 5 + 1]) = '' AS blank FROM customer) GROUP BY grp",
    "split_sizes": "WITH c AS (SELECT lang, count(*) AS n, round(count(*) * 0.25)::BIGINT AS h FROM documents GROUP BY lang) SELECT 'test' AS split, lang, h AS n FROM c UNION ALL SELECT 'val', lang, h FROM c UNION ALL SELECT 'train', lang, n - 2 * h FROM c",
    "class_report": f"WITH {_PRED}, {_REPORT} SELECT class, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM report",
    "metric_summary": f"WITH {_PRED}, {_REPORT} SELECT round((SELECT avg((y = p)::INT) FROM pred), 9) AS accuracy, round(avg(recall) FILTER (support > 0), 9) AS balanced_accuracy, round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM report",
    "confusion": f"WITH {_PRED} SELECT y, p, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY y))::DOUBLE, 9) AS share FROM pred GROUP BY y, p",
    "binary_auc": f"""WITH {_PRED}, s AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM pred GROUP BY score), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM s WINDOW w AS (ORDER BY score DESC))
        SELECT round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 9) AS roc_auc, round(sum(pos * tp / (tp + fp)) / sum(pos), 9) AS average_precision FROM c""",
    "confidence_histogram": f"WITH {_PRED} SELECT least(floor(score / 40 * 30), 29)::INT AS bin, count(*) AS n FROM pred GROUP BY bin",
    "missing_report": "SELECT 'c_mktsegment' AS column, count(*) AS n_missing, true AS all_missing FROM customer UNION ALL SELECT 'balance', count(*) FILTER (c_custkey % 4 = 0), false FROM customer",
}
