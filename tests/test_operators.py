from pyspark.sql import functions as F

from molkeys.functions import identifiers as ids
from molkeys.operators import labels, models, residues, similarity
from molkeys.sources import structures, tables
from molkeys.streaming.structures import stream_keys


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_identifiers(spark):
    for text, canon, label in [("5WT9_A_102_NAG_CI", "5WT9_A_102_NAG", "CI"), ("102_5WT9_A_NAG", "5WT9_A_102_NAG", ""), ("7WG3_M_NNBMMM", "7WG3_M_NNBMMM", ""), ("7WG3_M", "7WG3_M", ""), ("odd", "odd", "")]:
        p = ids.parse_identifier(F.lit(text))
        assert (one(spark, ids.canonical(p, F.lit(text))), one(spark, p["label"])) == (canon, label)
    assert one(spark, ids.ligand_code(F.lit("NAG,NAG,BMA,MAN,MAN"))) == "NNBMM"
    assert one(spark, ids.split_list(F.lit("49;58.0;476A"))) == ["49", "58", "476A"]
    assert one(spark, ids.split_list(F.lit("10;11; 102"))) == ["10", "11", "102"]
    assert [one(spark, ids.similarity(F.lit(d).cast("decimal(20,10)"))) for d in ("0.821", "0.000", "1")] == ["17.9", "100", "0"]
    assert [one(spark, ids.interaction_label(F.lit(d))) for d in (1.5, 1.6, 2.0, 2.1)] == ["ci", "wci", "wci", "nci"]
    assert one(spark, ids.sorted_join(F.array(*map(F.lit, ["10", "9", "9A"])))) == "9;10;9A"
    assert one(spark, ids.sorted_join(F.array(*map(F.lit, ["10", "9", "9A"])), ids.insertion_key)) == "9;9A;10"


LINE = "HETATM 1234  C1  NAG A 102      11.104   6.134  -6.504  1.00 20.00           C  "
LINK = "LINK         ND2 ASN G  58                 C1  NAG G 102     1555   1555  1.44  "


def test_structure_lines(spark, tmp_path):
    other = LINE.replace(" C1 ", " C2 ")
    text = [LINE, other.replace("C2  NAG", "C2 BNAG"), LINE.replace("           C  ", "           H  "), LINK, "MODEL        2", LINE.replace("102", "103"), "ENDMDL"]
    (tmp_path / "pdb1abc.ent").write_text("\n".join(text))
    lines = structures.lines_of(spark, str(tmp_path / "*.ent"))
    got = structures.key_atoms(lines).select("pdb", "label", "res", "chain", "seq", "x").collect()
    assert [tuple(r) for r in got] == [("1ABC", "C1", "NAG", "A", "102", 11.104)]
    assert structures.contact_atoms(lines).count() == 4 - 1
    edge = structures.link_edges(lines).first()
    assert (edge.a.res, edge.a.seq, edge.b.res, edge.b.seq) == ("ASN", "58", "NAG", "102")


def test_columns_are_resolved():
    import pytest

    assert tables.resolve(["Protein", "chain"], "chain", ["chain", "Chain"]) == "chain"
    assert tables.resolve(["Carb ID"], "seq", ["carbid"], rule="letters") == "Carb ID"
    with pytest.raises(tables.ColumnError):
        tables.resolve(["chain", "Chain_ID"], "chain", ["chain", "chain_id"], rule="alias")


def test_links_and_choice(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a long, b long")
    allowed = spark.createDataFrame([(2,), (3,), (5,)], "node long")
    got = residues.linked(edges, spark.createDataFrame([(1,)], "node long"), allowed)
    assert sorted(r.node for r in got.collect()) == [2, 3]


def test_average_linkage_and_rand(spark):
    d = {(a, b): (0.0 if a == b else 0.1 if (a < 2) == (b < 2) else 0.9) for a in range(4) for b in range(4)}
    m = spark.createDataFrame([(a, b, x) for (a, b), x in d.items()], "id_i long, id_j long, d double")
    got = {r.id: r.cluster for r in similarity.average_linkage(m, 2).collect()}
    assert got[0] == got[1] != got[2] == got[3]
    same = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "x int, y string")
    assert similarity.adjusted_rand(same, "x", "y").first().ari == 1.0


def test_splits_keep_groups_and_sizes(spark):
    rows = spark.range(300).select("id", (F.col("id") % 3).alias("label"), (F.col("id") % 20).alias("grp"))
    report = labels.split_report(labels.grouped_split(rows, "label", "grp", tries=16), "label", "grp").collect()
    assert {r.split for r in report} == {"train", "val", "test"} and all(r.n_shared_groups == 0 for r in report)
    assert labels.balanced_sample(rows.where("label < 2 or id < 60"), "label", "id").groupBy("label").count().select("count").distinct().count() == 1


def test_preprocessing_uses_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, 5.0, 0.0), (3.0, 5.0, 1.0), (None, 5.0, 1.0)], "a double, b double, label double")
    state = models.fit_preprocessor(train, ["a", "b"], scaler="none")
    assert state.kept == ["a"] and state.medians["a"] == 2.0
    assert models.prepare(spark.createDataFrame([(None,)], "a double"), state).first().features[0] == 2.0


def test_keys_of_a_stream(spark, tmp_path):
    schema = "s long, atoms array<struct<code:int,x:double,y:double,z:double>>"
    atoms = [(109, 0.0, 0.0, 0.0), (106, 1.4, 0.0, 0.0), (106, 2.0, 1.5, 0.0)]
    spark.createDataFrame([(1, atoms)], schema).write.parquet(str(tmp_path / "in"))
    q = stream_keys(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), ["s"])
    q.awaitTermination(60)
    assert [r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [713374156]
