"""The ids of every row against the library, with rare units and the decoded text."""

import random

import pytest
import sentencepiece

from molkeys.llm import lattice, queries

TEXTS = ["a b", "b a", "a b", " lead", "  ", "x▁y", "12 ünï 🙂\nlines \n\n here", "rareword otherrare a b " * 3, "x" * 200 + " end", "", None]


@pytest.mark.parametrize("common", [300_000, 3, 0])
def test_rows_are_encoded_and_decoded(spark, common, monkeypatch):
    monkeypatch.setattr(lattice, "COMMON", common)
    path = queries.tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i // 2 if i < 10 else None, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lattice.encode_summary(docs, lattice.load_model(path)).collect()
    want = [(str(d), sp.encode(t or ""), sp.decode(sp.encode(t or "")) == (t or "")) for d, t in rows]
    assert sorted((str(r.doc_id), r.ids, r.exact) for r in got) == sorted(want)
    assert [r.exact for r in got].count(False) == 1 and all(r.n_tokens == len(r.ids) for r in got)
    hashes = {tuple(r.ids): r.ids_hash for r in got}
    assert len(set(hashes.values())) == len(hashes) and hashes[()] == 0


def test_rows_of_a_unigram_model_take_the_best_path(spark, monkeypatch):
    monkeypatch.setattr(lattice, "COMMON", 1)
    pieces = [("▁", 0, -3.0), ("▁a", 1, -2.0), ("a", 2, -2.5), ("b", 3, -2.5), ("ab", 4, -1.0), ("▁ab", 5, -4.5)]
    model = lattice.Model(pieces, 300, 3, "unigram")
    ranks = {p: (i, s) for p, i, s in pieces}
    rows = [(i, t) for i, t in enumerate(["ab abab", "a b é ab", "", None, "ab ab"])]
    got = lattice.encode_summary(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    want = {i: lattice.best_path("▁" + t.replace(" ", "▁"), ranks, 3, 300) if t else [] for i, t in rows}
    assert {r.doc_id: r.ids for r in got} == want and all(r.exact for r in got)


def test_open_units_are_folded_together_in_one_python_pass(spark, monkeypatch):
    # units whose better pieces hold worse ones, of all lengths, among them those that are folded once more
    monkeypatch.setattr(lattice, "COMMON", 0)
    path = queries.tokenizer_file("piece_bpe_32k.model")
    sp, draw = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(3)
    model = lattice.load_model(path)
    parts = [p.replace("▁", "") for p, _, _ in draw.sample(model.pieces, 3000)] + list("abetinsé")
    texts = [" ".join("".join(draw.choices(parts, k=draw.randint(1, 9)))[: draw.randint(1, 70)] for _ in range(40)) for _ in range(60)]
    out = lattice.encode_summary(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), model)
    plan = out._jdf.queryExecution().toString()
    assert {r.doc_id: r.ids for r in out.collect()} == {i: sp.encode(t) for i, t in enumerate(texts)}
    # neither edges nor joins go back to Spark between the join with the pieces and the rows
    assert plan.split("== Physical Plan ==")[1].count("MapInArrow") == 1 and "aggregate(" not in plan.split("== Physical Plan ==")[1]
