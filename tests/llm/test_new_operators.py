"""Filter audit, lexical search and entropy mixing against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from molkeys.llm import entropy_mix, filter_audit, lexical_index
from molkeys.llm.common import scratch_path

RNG = random.Random(11)
VOCAB = [f"{a}{b}" for a in "ka lo mi Nu pe".split() for b in "r st na T e".split()]
LONG = " ".join(RNG.choice(VOCAB) for _ in range(4000))


def text():
    kind = RNG.random()
    if kind < 0.1:
        return RNG.choice([None, "", " \t\n", "#", "\x0b", "日本 語", "ÀB-c9"])
    n = RNG.choice([3, 50, 199, 200, 250])
    words = [RNG.choice(VOCAB if RNG.random() < 0.5 else VOCAB[:6]) for _ in range(n)]
    if kind < 0.3:
        words[0] = "a$b"
    return RNG.choice([" ", "\n", " "]).join(words)


POOL = [text() for _ in range(40)] + [LONG, LONG.upper()]
ROWS = [(i if i % 17 else None, RNG.choice(POOL), RNG.choice(["s1", "s1", "s2", None, ""]), i) for i in range(160)]
ROWS += ROWS[20:24] + [(5, LONG, "s1", -1), (5, LONG, "s2", -1)]
LABELS = [(i, RNG.choice([0, 1, None]), RNG.choice([0, 1])) for i in range(0, 160, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string, part long").repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def failing(text, doc_id, low):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    return [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)), doc_id is not None and doc_id > low[text]]


def test_audit_equals_brute_force(spark, docs, none):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    low = {}
    for d, t, *_ in ROWS:
        if d is not None:
            low[t or ""] = min(d, low.get(t or "", d))
    good = {d for d, q, _ in LABELS if q == 1 and d is not None}
    toxic = {d for d, _, x in LABELS if x == 1 and d is not None}
    parts = defaultdict(list)
    for d, t, s, _ in ROWS:
        parts[s or ""].append((failing(t, d, low), d in good, d in toxic))
    want = {}
    for part, rows in parts.items():
        sums = Counter()
        for order in permutations(range(5)):
            left, gone = rows, []
            for step, i in enumerate(order, 1):
                out = [r for r in left if r[0][i]]
                left = [r for r in left if not r[0][i]]
                sums[i] += len(out)
                want[part, "".join("ABCDE"[j] for j in order), step] = [len(left), len(out), sum(r[0][i] for r in gone), sum(sum(r[0]) == 1 and r[0][i] for r in rows), sum(r[1] for r in out), sum(r[2] for r in out), i]
                gone = gone + out
        for key, v in want.items():
            if key[0] == part:
                v[-1] = sums[v[-1]]
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(docs, labels).collect()}
    assert got == want and len(got) == 600 * 3
    assert filter_audit.audit(none, labels).count() == 0
    assert filter_audit.audit(docs, labels.where("false")).where("good_lost + toxic_lost > 0").count() == 0


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


QUERIES = [("q1", "KAR lost, peT! unknown"), ("q2", None), ("q3", "---"), ("q4", LONG[:300]), ("q4", "mie mie"), (None, "日本 Àb 9"), ("q5", "nothing like it"), ("q6", "kar")]


@pytest.mark.parametrize("shard, block", [(4 << 20, 8 << 20), (2000, 40)])
def test_search_equals_brute_force(spark, docs, none, shard, block, monkeypatch):
    monkeypatch.setattr(lexical_index, "SHARD_BYTES", shard)
    monkeypatch.setattr(lexical_index, "BLOCK_BYTES", block)
    read = [(d, Counter(terms(t))) for d, t, *_ in ROWS]
    N, L = sum(bool(c) for _, c in read), sum(sum(c.values()) for _, c in read)
    df = Counter(t for _, c in read for t in c)
    asked = defaultdict(set)
    for q, t in QUERIES:
        asked[q] |= set(terms(t))
    want = {}
    for q, ts in asked.items():
        found = []
        for d, c in read:
            m = 10 + 90 * sum(c.values()) * N // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if score > 0:
                found.append((-score, d is None, d))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        want |= {(q, i): (d, -s) for i, (s, _, d) in enumerate(found[:10], 1)}
    items = spark.createDataFrame(QUERIES, "item_id string, text string")
    got = lexical_index.search_once(docs, items)
    assert {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in got.collect()} == want and got.count() == len(want)
    if block > 1000:
        assert lexical_index.search_once(none, items).count() == 0 == lexical_index.search_once(docs, items.where("false")).count()


def test_an_index_is_searched_again(spark, docs):
    index = lexical_index.build(docs, scratch_path(spark, "index"))
    again = lexical_index.Index(spark, index.path, index.n_docs, index.n_terms)
    items = spark.createDataFrame(QUERIES, "item_id string, text string")
    one = lexical_index.search(again, items, k=3)
    assert one.groupBy("item_id").count().where("count > 3").count() == 0 and one.where("item_id = 'q4'").count() == 3
    assert [r.doc_id for r in one.where("item_id = 'q6'").orderBy("rank").collect()] == [r.doc_id for r in lexical_index.search(index, items).where("item_id = 'q6' and rank <= 3").orderBy("rank").collect()]


def poured(sizes, share=1.5, weights=(5, 2, 1)):
    """Targets by pouring: sources that are full leave, the rest share what is left, until none is above."""
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    full, left = {}, dict(sizes)
    while True:
        rest = share * sum(sizes.values()) - sum(full.values())
        given = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        above = [s for s in left if given[s] >= 2 * sizes[s]]
        if not above:
            return full | given
        full |= {s: 2.0 * sizes[s] for s in above}
        left = {s: n for s, n in left.items() if s not in full}
        if not left:
            return full


@pytest.mark.parametrize("bucket", [2048, 3])
def test_mix_meets_its_targets(spark, docs, none, bucket):
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = Counter()
    for _, t, s, _ in ROWS:
        sizes[s] += words(t)
    got = entropy_mix.mix(docs, bucket=bucket).collect()
    assert len(got) == len(ROWS)
    want, taken, least = poured(sizes), Counter(), {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((d or -1, words(t)) for d, t, *_ in ROWS)
    assert all(abs(taken[s] - want[s]) <= 210 for s in sizes)  # less than the words of a common document
    key = lambda rows: sorted((r.doc_id or -1, r.size, r.source or "", r.taken) for r in rows)
    assert key(entropy_mix.mix(docs.repartition(3), bucket=bucket).collect()) == key(got)
    assert entropy_mix.mix(none).count() == 0


def test_mix_rates_follow_sizes_and_whole_sources_double(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 30)), "a" if i < 4000 else "b") for i in range(4300)] + [(9000 + i, None, "c") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = entropy_mix.mix(df, share=0.6).toPandas()
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.target - by.taken) <= 1).all()
    a = got[got.source == "a"].groupby("size").copies.mean()
    rate = -math.log(a[10]) / 10
    assert all(abs(a[z] - math.exp(-rate * z)) < 0.02 for z in a.index) and rate > 0
    assert set(entropy_mix.mix(df, share=2.0).where("size > 0").toPandas().copies) == {2}
    assert entropy_mix.mix(df.where("source = 'c'")).toPandas().taken.tolist() == [0] * 5
