"""Key directories: names, pieces, pruning, duplicates, commit and abort."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from molkeys.functions.identifiers import canonical, parse_identifier
from molkeys.operators import labels
from molkeys.sources import key_directory as kd

NAMES = ["5wt9_A_102_nag_CI", "102_5WT9_A_NAG", "7WG3_M_nnb_x_NCI", "7wg3_M_nnb", "7WG3_m", "odd", "5WT9_A_102", " 5WT9 _A_-3B_MAN", "A_B_C_D_WCI"]


def test_names_follow_the_column_rules(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "n string")
    p = parse_identifier(F.col("n"))
    want = {r.n: (r.kind, r.canon, r.label) for r in rows.select("n", p["kind"].alias("kind"), canonical(p, F.col("n")).alias("canon"), p["label"].alias("label")).collect()}
    assert {n: kd.name_parts(n) for n in NAMES} == want


@pytest.fixture()
def folder(tmp_path):
    for name, body in {"1ABC_A_5_NAG_CI": "a\nbb\r\n\nccc", "1ABC_A_5_NAG": "x\n", "2ABC_B": "q\n" * 50, "odd": "no\n"}.items():
        (tmp_path / f"{name}{kd.KEYS}").write_bytes(body.encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / f"3ABC_C_nnb{kd.KEYS}").write_text("deep\n")
    return tmp_path


@pytest.mark.parametrize("size", [1, 3, 7, 1 << 20])
def test_pieces_give_each_line_once(spark, folder, size):
    got = [tuple(r) for r in kd.read_lines(spark, str(folder), bytes=size, recursive=True).orderBy("file", "at").select("identifier", "label", "at", "text").collect()]
    ci = [("1ABC_A_5_NAG", "CI", 0, "a"), ("1ABC_A_5_NAG", "CI", 2, "bb"), ("1ABC_A_5_NAG", "CI", 6, ""), ("1ABC_A_5_NAG", "CI", 7, "ccc")]
    assert [r for r in got if r[1]] == ci and [r[2] for r in got if r[0] == "2ABC_B"] == list(range(0, 100, 2))
    assert {r[0] for r in got} == {"1ABC_A_5_NAG", "2ABC_B", "3ABC_C_NNB"}
    assert {r.kind for r in kd.read_lines(spark, f"file://{folder}", mode="chain").collect()} == {"PDB_CHAIN"}


def test_filters_prune_files(spark, folder):
    reader = kd.PrunedKeyReader({"path": str(folder), "bytes": "1000"})
    left = list(reader.pushFilters([EqualTo(("label",), "CI"), In(("identifier",), ("1ABC_A_5_NAG", "2ABC_B")), GreaterThan(("at",), 3)]))
    files = {f.path for p in reader.partitions() for f, *_ in p.pieces}
    assert [type(f) for f in left] == [GreaterThan] and [os.path.basename(f) for f in files] == [f"1ABC_A_5_NAG_CI{kd.KEYS}"]
    spark.conf.set(kd.PUSHDOWN, "true")
    try:
        one = kd.read_lines(spark, str(folder), bytes=1).where("identifier = '1ABC_A_5_NAG' and label = '' and at >= 0")
        # a task for each byte of the one file that is left
        assert one.rdd.getNumPartitions() == 2 and [r.text for r in one.collect()] == ["x"]
    finally:
        spark.conf.unset(kd.PUSHDOWN)
    assert kd.read_lines(spark, str(folder), bytes=1).where("identifier = '1ABC_A_5_NAG' and label = ''").count() == 1


def test_two_files_of_a_sample_are_an_error(spark, folder):
    (folder / f"5_1ABC_A_NAG{kd.KEYS}").write_text("y\n")
    with pytest.raises(Exception, match="two key files of 1ABC_A_5_NAG"):
        kd.read_lines(spark, str(folder)).collect()
    files = spark.createDataFrame([("k", "CI", "f1"), ("k", "CI", "f2"), ("k", "", "f3"), ("m", "", "f4")], "key string, file_label string, file string")
    samples = spark.createDataFrame([("k", "CI"), ("m", "")], "key string, label string")
    with pytest.raises(Exception, match="two key files"):
        labels.resolve_files(samples, files).collect()
    assert labels.resolve_files(samples, files.where("file <> 'f2'")).count() == 2


def test_written_files_are_read_back(spark, tmp_path):
    freq = spark.range(200).selectExpr("concat(id % 7 + 1, 'ABC_A_', id % 7, '_NAG') as identifier", "if(id % 7 < 3, 'CI', '') as label", "id - 100 as key", "id as freq")
    path = f"file://{tmp_path}/keys"
    os.makedirs(tmp_path / "keys")
    kd.write_frequencies(freq, path)
    rows = lambda df: sorted(map(tuple, df.select("identifier", "label", "key", "freq").collect()))
    assert rows(kd.read_frequencies(spark, path)) == rows(freq)
    assert sorted(os.listdir(tmp_path / "keys")) == sorted({f"{r.identifier}{'_CI' if r.label else ''}{kd.FREQUENCIES}" for r in freq.collect()})
    with pytest.raises(Exception, match="more than one file"):
        kd.write_frequencies(freq.where("key > 0"), path)
    assert rows(kd.read_frequencies(spark, path)) == rows(freq)
    kd.write_frequencies(freq.where("key > 0"), path, mode="overwrite")
    assert rows(kd.read_frequencies(spark, path)) == rows(freq.where("key > 0"))


def test_failed_writes_leave_nothing(spark, tmp_path):
    bad = spark.range(20).selectExpr("concat('1ABC_', id % 2) as identifier", "'' as label", "if(id = 19, raise_error('stop'), 'x') as text")
    os.makedirs(tmp_path / "keys")
    with pytest.raises(Exception, match="stop"):
        kd.write_lines(bad, str(tmp_path / "keys"), ["text"])
    assert os.listdir(tmp_path / "keys") == []
