"""Catalogue queries cover whole tables with the operators' own defaults."""

import zlib

from molkeys.operators import labels, models
from molkeys.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_label_join_equals_brute_force(spark):
    names = {r.c_custkey: r.identifier for r in catalogue._names(spark, SF).collect()}
    canon = {r.c_custkey: r.canon for r in catalogue.parsed_identifiers(spark, SF).collect()}
    known = {}
    for key, name in names.items():
        p = name.split("_")
        other = "_".join([p[2], p[0], p[1], p[3]]) if key % 5 == 0 else name
        if zlib.crc32(other.encode()) % 4:
            known.setdefault(canon[key], set()).add("NCI" if key % 2 else "CI")
    want = {}
    for key, name in names.items():
        found = known.get(canon[key], set())
        want[name] = (min(found) if len(found) == 1 else None, ["unmatched", "matched", "ambiguous"][len(found)])
    got = {r.identifier: (r.label, r.status) for r in catalogue.label_join(spark, SF).collect()}
    assert got == want and {k % 5 for k in names} == set(range(5))


def test_models_take_all_components_and_defaults(spark, monkeypatch):
    seen, splits = [], []
    fit, split = models.train, labels.grouped_split
    monkeypatch.setattr(models, "train", lambda rows, state, model: (seen.append((state, model)), fit(rows, state, model))[1])
    monkeypatch.setattr(labels, "grouped_split", lambda *a, **k: (splits.append(k), split(*a, **k))[1])
    n = labels.stratified_split(catalogue._features(spark, SF), "label", "vec_id").where("split = 'test'").count()
    assert catalogue.logistic_predictions(spark, SF).count() == catalogue.forest_predictions(spark, SF).count() == n
    (a, logistic), (b, forest) = seen
    assert len(a.kept) == len(b.kept) == 64 and logistic.getMaxIter() == 200
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (500, 15)
    assert sum(r.n_rows for r in catalogue.grouped_split(spark, SF).collect()) == 200 and splits == [{}]
