import pytest
from pyspark.sql import functions as F

from molkeys.functions import identifiers
from molkeys.operators import labels, search, targets
from molkeys.sources import structures, tables

ATOM = "HETATM{:5d}  {:<3} NAG {}{:4d}    {:8.3f}{:8.3f}{:8.3f}  1.00 20.00           C  "


def samples(df):
    return sorted((r.line, r.protein, r.grp, r.canon, r.fault) for r in df.collect())


def test_search_inputs(spark, tmp_path):
    table = tmp_path / "table.csv"
    table.write_text("Protein Name,Label,Chain,SeqNum\n5wt9_A_102_NAG_ci,CI,,\n5WT9_A_102_NAG_CI,NCI,,\n,,,\n102_5WT9_v_nag,,,\nodd,,,\n7wg3,,M,3\n")
    got = search.read_samples(spark, str(table))
    assert [x[1:] for x in samples(got.where("fault is null"))] == [("5wt9_A_102_NAG", "CI", "5WT9_A_102_NAG", None), ("102_5WT9_v_nag", "", "5WT9_v_102_NAG", None)]
    assert sorted(r.fault for r in got.where("fault is not null").collect()) == ["conflict", "unparsable", "unparsable"]
    with pytest.raises(Exception, match="sample of line"):
        search.strict(got).collect()
    lines = tmp_path / "lines.txt"
    lines.write_text("7WG3_M_NNB_CI;1,2\n\n7wg3_M_nnb_CI,5\n7WG3_M_CI;1\n")
    got = samples(search.read_samples(spark, str(lines), search.CHAIN))
    assert [x[1:4] for x in got] == [("7wg3_M_nnb", "CI", "7WG3_M_NNB"), ("7WG3_M_CI", "", "7WG3_M_CI")]
    assert [r.fault for r in search.read_samples(spark, str(lines), search.RESIDUE).collect()] == ["format"] * 3
    none = spark.createDataFrame([], "line long, protein string")
    assert samples(search.samples_of_rows(none, "line")) == []


def test_search_gives_rows_and_counters(spark):
    wanted = spark.createDataFrame([(0, "5WT9_A_1_NAG", "CI"), (1, "5WT9_A_2_NAG", ""), (2, "5WT9_B_1_NAG", "")], "line long, protein string, label string")
    row = "\t".join(["9", "C1", "1", "C2_D", "1", "C3", "1", *"0" * 13])
    lines = spark.createDataFrame([("5WT9_A_1_NAG", "CI", "a", row), ("5WT9_A_1_NAG", "CI", "a", "short"), ("5WT9_A_2_NAG", "CI", "b", row), ("5WT9_A_2_NAG", "NCI", "c", row)], "key string, file_label string, file string, line string")
    found, *seen = search.search(search.samples_of_rows(wanted, "line"), lines, ["C3", "C2", "C1"], ignore_suffix=True)
    assert [(r.sample, r.key, r.atom2) for r in found.collect()] == [("5WT9_A_1_NAG", 9, "C2_D")]
    assert search.counters(found, *seen).first().asDict() == dict(samples=3, key_files_found=1, key_files_missing=1, ambiguous_key_files=1, rows_read=1, rows_matched=1, malformed_rows=1)
    assert search.search(search.samples_of_rows(wanted, "line"), lines, ["C3", "C2", "C1"])[0].count() == 0


def test_targets_to_records(spark, tmp_path):
    (tmp_path / "lex.csv").write_text("seq,atom,ATOM\n5,C1,C9\n6,C2,C1\n7,C3,NA\n")
    lexical = tables.read_lexical(spark, str(tmp_path / "lex.csv"))
    assert {r.name: r.code for r in lexical.collect()} == {"C1": 6, "C2": 6, "C3": 7, "C9": 5}
    with pytest.raises(tables.ColumnError):
        tables.lexical_map(spark.createDataFrame([("1", 0)], "seq string, line long"))
    text = [ATOM.format(i, f"C{i % 3 + 1}", "A", 7 + i // 3, 1.0 * i, 0.5 * i * i, 0.0) for i in range(6)]
    lines = spark.createDataFrame([("1ABC", i, t) for i, t in enumerate(text)], "pdb string, ln int, line string")
    rows = spark.createDataFrame([(1, "1abc", "A", "NAG", "8;7"), (2, "1abc", "A", "NAG", "8"), (3, "1abc", "a", "NAG", "7"), (4, "1abc", "A", "", "7"), (5, None, "A", "NAG", "7")], "line long, protein string, chain string, name string, seq string")
    one, whole = targets.residue_targets(rows), targets.chain_targets(rows)
    assert sorted(r.identifier for r in one.collect()) == ["1abc_A_7_NAG", "1abc_A_8_NAG", "1abc_A_8_NAG", "1abc_a_7_NAG"]
    assert sorted((r.identifier, r.summary_names, r.summary_seqs) for r in whole.collect()) == [("1abc_A", "NAG,NAG,NAG", "7,8"), ("1abc_a", "NAG", "7")]
    count = lambda t, **k: {r.identifier: r["count"] for r in targets.key_records(targets.target_keys(lines, t, lexical, **k)).groupBy("identifier").count().collect()}
    assert set(count(one)) == {"1abc_A_7_NAG", "1abc_A_8_NAG"} and set(count(whole)) == {"1abc_A"}
    assert count(one, expected=spark.createDataFrame([("NAG", 4)], "res string, expected int")) == {} and count(one, kind="residue") == {}
    record = targets.key_records(targets.target_keys(lines, whole, lexical))
    assert len(record.columns) == 21 and {len(r.seq1) for r in record.collect()} == {5}
    atoms = structures.with_codes(targets.target_atoms(lines, one), lexical)
    summary = targets.run_summary(targets.target_keys(lines, one, lexical), atoms, one).collect()
    assert sorted((r.identifier, r.n_atoms, r.n_triplets, r.line) for r in summary) == [("1abc_A_7_NAG", 3, 1, 1), ("1abc_A_8_NAG", 3, 1, 1)]


def test_names_are_sorted_and_different(spark):
    c = F.array(F.lit(" NAG"), F.lit("BMA"), F.lit(None), F.lit("NAG"), F.lit(""))
    assert spark.range(1).select(identifiers.sorted_names(c).alias("v")).first().v == "BMA, NAG"


def test_lines_are_read_once_and_counted(spark, tmp_path):
    row = "\t".join(["9", "C1", "1", "C2", "1", "C3", "1", *"0" * 13])
    data = [(f"5WT9_A_{i % 9}_NAG", "", f"f{i % 9}", row if i % 4 else "short") for i in range(400)]
    spark.createDataFrame(data, "key string, file_label string, file string, line string").write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    wanted = spark.createDataFrame([(i, f"5WT9_A_{i}_NAG") for i in range(5)], "line long, protein string")
    files = spark.createDataFrame([(f"5WT9_A_{i}_NAG", "", f"f{i}") for i in range(9)], "key string, file_label string, file string")
    found, observed, of_samples = search.search(search.samples_of_rows(wanted, "line"), lines, ["C1", "C2", "C3"], files=files)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "CollectMetrics" in plan
    own = [x for x in data if int(x[2][1:]) < 5]
    got = search.counters(found, observed, of_samples).first()
    assert (got.rows_read, got.rows_matched, got.malformed_rows) == (sum(x[3] == row for x in own), sum(x[3] == row for x in own), sum(x[3] != row for x in own)) and got.key_files_found == 5


def test_lines_keep_their_numbers_and_form(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        (tmp_path / "m.csv").write_text("".join(f"s{i};{','.join(str(abs(i - j) / 100) for j in range(40))}\n" for i in range(40)))
        lines = tables.numbered_lines(spark, str(tmp_path / "m.csv"))
        assert [r.line.split(";")[0] for r in lines.orderBy("ln").collect()] == [f"s{i}" for i in range(40)] and lines.agg(F.max("ln")).first()[0] == 40
        cells = tables.distance_rows(spark, str(tmp_path / "m.csv"))
        assert cells.count() == 1600 and cells.where("round(abs(int(substr(id_i, 2)) - int(substr(id_j, 2))) / 100, 2) <> d").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    known = spark.createDataFrame([("1ABC_A_5_NAG", "I"), ("2ABC_A_7_MAN", "NI")], "identifier string, label string")
    for text, want in {
        "1ABC_A_5_NAG;1,2\n\n7_2abc_A_man;3\n": ["1ABC_A_5_NAG_I;1,2", "7_2abc_A_man_NI;3"],
        'Protein Name,"k,1",k2\n"1ABC_A_5_NAG",1,"a,b"\n2ABC_A_7_MAN,3,4\n': ['Protein Name,"k,1",k2', '"1ABC_A_5_NAG_I",1,"a,b"', "2ABC_A_7_MAN_NI,3,4"],
        "1ABC_A_5_NAG,1\n": ["1ABC_A_5_NAG_I,1"],
    }.items():
        folder = tmp_path / f"out{len(text)}"
        (tmp_path / "g.csv").write_text(text)
        tables.write_numbered(labels.annotate_lines(tables.numbered_lines(spark, str(tmp_path / "g.csv")), known), str(folder))
        assert [x for p in sorted(folder.glob("part-*")) for x in p.read_text().splitlines()] == want
    bad = spark.createDataFrame([(1, "1ABC_A_5_NAG;1"), (2, "3ABC_A_1_NAG;1"), (3, "none")], "ln long, line string")
    with pytest.raises(Exception, match="line 2: no single label of 3ABC_A_1_NAG"):
        labels.annotate_lines(bad.where("ln < 3"), known).collect()
    with pytest.raises(Exception, match="line 3 has no semicolon"):
        labels.annotate_lines(bad, known, strict=False).collect()
    assert sorted(r.status for r in labels.annotate_lines(bad.where("ln < 3"), known, strict=False).collect()) == ["matched", "unmatched"]
    rows = spark.createDataFrame([("1ABC_A_5_NAG", 1), ("9ABC_A_5_NAG", 2)], "identifier string, v int")
    assert [tuple(r) for r in labels.annotate(rows.where("v = 1"), known).collect()] == [("1ABC_A_5_NAG_I", 1)]
    with pytest.raises(Exception, match="no single label"):
        labels.annotate(rows, known).collect()
    assert [tuple(r) for r in labels.unmatched(rows, known).collect()] == [("9ABC_A_5_NAG", "unmatched")]


def test_an_identifier_is_split_once(spark):
    from molkeys.plans import catalogue

    # nested uses of a parse multiply its parts, and the work of each row with them
    rows = spark.createDataFrame([("1ABC_A_12_nag_ci",), ("12_1abc_A_NAG",), ("1abc_A",), (None,)], "i string")
    out = rows.select(identifiers.parse_identifier(F.col("i")).alias("p")).select("p.kind", "p.pdb", "p.seq", "p.label")
    assert out._jdf.queryExecution().analyzed().toString().count("split(") == 1
    assert [tuple(r) for r in out.collect()] == [("PDB_CHAIN_SEQ_RESIDUE", "1ABC", "12", "CI"), ("PDB_CHAIN_SEQ_RESIDUE", "1ABC", "12", ""), ("PDB_CHAIN", "1ABC", None, ""), ("RAW", None, None, "")]
    plan = catalogue.parsed_identifiers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
