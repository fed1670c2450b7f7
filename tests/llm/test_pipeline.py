"""Each stage on nulls, repeats, clashing columns and empty tables; filters against brute force."""

import random
import re

import corpus_pipeline
import pytest

from molkeys.llm import toxic_crf

SF = "/root/testdata/sf0.001"
RNG = random.Random(3)
WORDS = [f"{a}{b}" for a in "the ing ent or an is de la qu st".split() for b in "a er on th es un".split()]
CLASH = "original string, score double, spans string, nth int, count long, row_key string, ks string, row long, own string, n long, at int, unit string"


def text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    base, long = text(80), text(4000)
    texts = [(1, base), (1, base), (2, base + " more"), (1, text(50)), (None, base), (None, text(40)), (5, None), (6, None), (7, ""), (8, "  "), (9, long), (10, long), (11, "x " + item + " y"), (None, item), (12, 'password = "hunter2-P@ssw0rd!" and so on ' + text(30)), (13, text(3))]
    rows = [(i, t, "en", "src", len(t or ""), "o", 0.5, "s", 1, 2, "k", "ks", 3, "own", 4, 5, "u") for i, t in texts]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


@pytest.mark.parametrize("k", range(5))
def test_stages_keep_columns_and_take_empty_tables(spark, docs, k):
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    if k < 4:
        assert out.columns == docs.columns
        assert {tuple(r)[5:] for r in out.collect()} == {tuple(r)[5:] for r in docs.collect()}
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), SF).count() == 0


def test_toxicity_keeps_clean_rows_of_all_kinds(spark, docs):
    out = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))


def test_toxicity_of_held_out_documents(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.1").select("doc_id").collect()}
    labels = {r.doc_id: r.toxic for r in known.where(toxic_crf.held_out("doc_id")).collect()}
    clean, toxic = ([d for d, x in labels.items() if x == y] for y in (0, 1))
    assert sum(d in kept for d in clean) >= 0.97 * len(clean) and sum(d in kept for d in toxic) <= 0.2 * len(toxic)
    scores = {r.doc_id: r.score for r in toxic_crf.score(docs, toxic_crf.train(docs, known), "doc_id").collect()}
    wins = sum((scores[a] > scores[b]) + 0.5 * (scores[a] == scores[b]) for a in toxic for b in clean)
    assert wins >= 0.95 * len(toxic) * len(clean)


def shingles(t):
    w = re.findall(r"[^ \t\n\v\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_one_row_of_each_group_stays(spark, docs):
    for df in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in df.collect()), key=lambda r: (r[0], r[1], str(r[2])))
        sets, group = [shingles(r[2]) for r in rows], list(range(len(rows)))
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and group[i] != group[j]:
                    low, high = sorted((group[i], group[j]))
                    group = [low if g == high else g for g in group]
        want = sorted((d or 0) if not none else -1 for i, (none, d, _) in enumerate(rows) if group[i] == i)
        got = sorted(-1 if r.doc_id is None else r.doc_id for r in corpus_pipeline.one_of_each_group(spark, df, SF).collect())
        assert got == want


def test_contaminated_rows_go_by_their_own_text(spark, docs):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[p : p + 10]) for p in range(len(w) - 9)} or ({tuple(w)} if w else set())
    want = [(r.doc_id, r.text) for r in docs.collect() if not any(tuple(w[p : p + len(g)]) == g for w in [words(r.text)] for g in windows for p in range(len(w) - len(g) + 1))]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) == docs.count() - 2


def test_secrets_are_redacted_and_nothing_else(spark, docs):
    got = sorted(((str(r.doc_id), str(r.text), r.n_chars) for r in corpus_pipeline.redact_secrets(spark, docs, SF).collect()))
    want = sorted((str(r.doc_id), str(r.text).replace("hunter2-P@ssw0rd!", "[SECRET]"), len((r.text or "").replace("hunter2-P@ssw0rd!", "[SECRET]")) if r.text is not None else None) for r in docs.collect())
    assert got == want


def test_all_rows_are_encoded(spark, docs):
    out = corpus_pipeline.encode_pieces(spark, docs, SF).collect()
    assert len(out) == docs.count() and all(r.exact and r.n_tokens == len(r.ids) for r in out)
