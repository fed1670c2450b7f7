"""Preparation, saved models, calibration, boosting with history, quantiles, neighbours and balance."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import Observation
from pyspark.sql import functions as F

from molkeys.operators import balance, labels, models, neighbours, quantiles
from molkeys.operators.preparation import Preparation

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, float(i % 3), *(float(x) for x in RNG.normal(2 * (i % 3), 1.0, 3)), float(RNG.integers(0, 4))) for i in range(240)]
    df = spark.createDataFrame(data, "id long, label double, a double, b double, c double, d double")
    return labels.stratified_split(df, "label", "id").withColumn("flat", F.lit(7.0))


def test_quantiles_equal_percentile(spark):
    data = [(None if i % 11 == 0 else float("nan") if i % 13 == 0 else math.exp(random.Random(i).uniform(-9, 9)), float(i % 7), 4.0, None) for i in range(1500)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double").repartition(6)
    shares = [0.0, 0.25, 0.5, 0.77, 1.0]
    for few in (4096, 20):
        got = {(r.column, r.share): r.value for r in quantiles.exact_quantiles(df, list("abcd"), shares, bins=64, few=few).collect()}
        want = {(c, p): float(np.quantile([r[i] for r in data if r[i] is not None and r[i] == r[i]], p)) for i, c in enumerate("abc") for p in shares}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_medians_of_many_columns(spark):
    names = [f"f{i}" for i in range(600)]
    df = spark.range(40).select(*[((F.col("id") * (i + 3)) % 41).cast("double").alias(n) for i, n in enumerate(names)])
    got = {r.column: r.value for r in quantiles.exact_quantiles(df, names, [0.5]).collect()}
    assert got == {n: float(np.median([(k * (i + 3)) % 41 for k in range(40)])) for i, n in enumerate(names)}


@pytest.mark.parametrize("scaler", ["standard", "robust"])
def test_a_saved_pipeline_scores_alike(spark, rows, tmp_path, scaler):
    train = rows.where("split = 'train'")
    state = models.fit_preprocessor(train, ["a", "b", "c", "d", "flat"], log=True, scaler=scaler)
    model = models.train(train, state, models.classifier("logistic_regression", penalty="l2", C=1.0, n=train.count()))
    models.save(model, str(tmp_path / "m"))
    again = models.load(str(tmp_path / "m"))
    new = rows.drop("d").withColumn("more", F.lit(1))
    pick = lambda m: [tuple(r) for r in models.predict(new, m).orderBy("id").select("id", "prediction", "probabilities", "is_correct").collect()]
    assert isinstance(again, PipelineModel) and pick(again) == pick(model)
    assert again.stages[0].kept == ["a", "b", "c", "d"] and again.stages[0].report(spark).first().zero_variance == ["flat"]
    x = np.log1p(np.clip([r.a for r in train.select("a").collect()], 0, None))
    center, scale = (x.mean(), x.std()) if scaler == "standard" else (np.median(x), np.quantile(x, 0.75) - np.quantile(x, 0.25))
    got = {r.id: r.features[0] for r in state.transform(rows).select("id", "features").collect()}
    assert all(got[r.id] == pytest.approx((math.log1p(max(r.a, 0)) - center) / scale) for r in rows.collect())
    each = {r.split: r for r in models.evaluate_splits(models.predict(rows, again)).collect()}
    assert set(each) == {"train", "val", "test"} and sum(r.n for r in each.values()) == 240 and each["test"].accuracy > 0.6
    assert [r.feature for r in models.importances(again).collect()][-1] == "d" and models.class_coefficients(again).count() == 12


@pytest.mark.parametrize("kind, params", [("logistic_regression", {"maxIter": 3}), ("random_forest", {"numTrees": 3, "maxDepth": 3}), ("svm", {"maxIter": 3})])
def test_models_score_after_an_observation(spark, rows, kind, params):
    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("n")).collect()
    two = rows.where("label < 2")
    model = models.train(two, Preparation(["a", "b"], scaler="none").fit(two), models.classifier(kind, **params))
    assert seen.get == {"n": 3} and len(models.predict(two, model).select("id", "prediction").collect()) == two.count()


def test_forests_are_grown_by_all_cores(spark, rows, monkeypatch):
    seen, fit = [], models.Pipeline.fit
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, data: (seen.append(data), fit(self, data))[1])
    one = spark.range(2000).select("id", (F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 7).cast("double").alias("a")).coalesce(1)
    model = models.train(one, Preparation(["a"], scaler="none").fit(one), models.classifier("random_forest", numTrees=3, maxDepth=3))
    assert seen[0].rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and seen[0].count() == 2000 and model.stages[-1].getNumTrees == 3


def test_large_forests_are_grown_and_kept_in_parts(spark, rows, tmp_path, monkeypatch):
    kept, save = [], models.RandomForestClassificationModel.save
    monkeypatch.setattr(models, "NODES", 200)
    monkeypatch.setattr(models.RandomForestClassificationModel, "save", lambda self, path: (kept.append((self.getNumTrees, self.totalNumNodes)), save(self, path))[1])
    names = ["a", "b", "c", "d"]
    state = Preparation(names, scaler="none").fit(rows)
    model = models.train(rows, state, models.classifier("random_forest", numTrees=20, maxDepth=4))
    forest = model.stages[-1]
    assert len(kept) > 2 and max(n for _, n in kept) <= 200 and sum(t for t, _ in kept) == 20 == forest.getNumTrees
    models.save(model, str(tmp_path / "m"))
    again = models.load(str(tmp_path / "m"))
    got = {r.id: r for r in models.predict(rows.withColumn("x", F.lit(1)), again).collect()}
    assert len(got) == rows.count() and {"x", "split", "confidence", "is_correct"} <= set(next(iter(got.values())).asDict())
    # the trees of all parts, one by one
    trees = [t for p in forest.parts() for t in p.trees]
    for r in state.transform(rows).sort("id").limit(20).collect():
        votes = np.sum([t.predictProbability(r.features).toArray() for t in trees], 0)
        assert got[r.id].rawPrediction.toArray() == pytest.approx(votes) and got[r.id].probabilities == pytest.approx(list(votes / 20)) and got[r.id].prediction == votes.argmax()
    alike = models.predict(rows, model).collect()
    assert {r.id: r.probabilities for r in alike} == {i: r.probabilities for i, r in got.items()} and sum(r.is_correct for r in alike) > 150
    assert models.predict(rows.where("id < 0"), again).count() == 0
    want = np.mean([t.featureImportances.toArray() for t in trees], 0)
    assert forest.featureImportances.toArray() == pytest.approx(want) and {r.feature: r.importance for r in models.importances(again).collect()} == pytest.approx(dict(zip(names, want)))
    # parts differ, and thresholds decide as they do in one forest
    assert len({str(t.toDebugString) for t in trees}) == 20
    one = models.train(rows, state, models.classifier("random_forest", numTrees=20, maxDepth=4).setThresholds([1.0, 0.0, 1.0]))
    assert {r.prediction for r in models.predict(rows, one).where(F.col("probabilities")[1] > 0).select("prediction").collect()} == {1.0}


def test_penalties_are_checked():
    for bad in ({"penalty": "l3"}, {"penalty": "elasticnet"}, {"penalty": "l2", "l1_ratio": 0.5, "n": 5}, {"penalty": "l1", "C": 0, "n": 5}, {"penalty": "elasticnet", "l1_ratio": 2.0, "n": 5}):
        with pytest.raises(ValueError):
            models.penalty(bad)
    assert models.penalty({"penalty": "none"}) == {} and models.penalty({"penalty": "l1", "C": 2.0, "n": 10}) == {"regParam": 0.05, "elasticNetParam": 1.0}


def test_calibrated_support_vectors(spark, rows, tmp_path):
    train = rows.where("split <> 'test'")
    model, folds = models.calibrated_svm(train, Preparation(["a", "b", "c", "d"]).fit(train), "id", folds=3, maxIter=20)
    assert folds.count() == train.count() and folds.groupBy("fold").count().count() == 3
    models.save(model, str(tmp_path / "m"))
    out = models.predict(rows.where("split = 'test'"), models.load(str(tmp_path / "m"))).collect()
    assert all(sum(r.probabilities) == pytest.approx(1) and r.prediction == int(np.argmax(r.probabilities)) for r in out)
    assert sum(r.is_correct for r in out) / len(out) > 0.6
    # each curve's mean is that of its targets, before the curves are scaled to sum to one
    scores = np.array([r.rawPrediction for r in folds.select("rawPrediction").collect()])
    hits = Counter(int(r.label) for r in folds.select("label").collect())
    for c, (slope, offset) in enumerate(zip(model.stages[-1].getOrDefault("slopes"), model.stages[-1].getOrDefault("offsets"))):
        n, k = len(scores), hits[c]
        target = (k * (k + 1) / (k + 2) + (n - k) / (n - k + 2)) / n
        assert np.mean(1 / (1 + np.exp(-(slope * scores[:, c] + offset)))) == pytest.approx(target, abs=1e-4)
    table = models.calibration_table(folds, bins=4).collect()
    assert sum(r.n for r in table) == 3 * len(scores) and all(0 <= r.share <= 1 for r in table)


def test_boosting_stops_and_tells(spark, rows, tmp_path):
    data = rows.withColumn("held", F.col("split") == "val")
    state = Preparation(["a", "b", "c", "d"], scaler="none").fit(data)
    model, history = models.boost(data, state, "held", maxIter=12, maxDepth=2, stepSize=0.5)
    lines = history.collect()
    assert {r["class"] for r in lines} == {0, 1, 2} and all(Counter(r["class"] for r in lines)[c] <= 12 for c in range(3))
    one = [r.train for r in lines if r["class"] == 0]
    assert one[-1] < one[0] and models.predict(data, model).where("is_correct").count() > 140
    two, history = models.boost(data.where("label < 2"), state, "held", maxIter=4, maxDepth=2)
    models.save(two, str(tmp_path / "m"))
    assert history.count() <= 4 and models.predict(data.where("label < 2"), models.load(str(tmp_path / "m"))).where("is_correct").count() > 110


POINTS = [(i, f"c{i % 2}" if i < 90 else "c2", [float(x) for x in np.round(RNG.normal(3 * (i % 4), 1, 2), 1)]) for i in range(100)] + [(200 + i, "c0", [1.0, 1.0]) for i in range(30)] + [(300, "lone", [0.0, 0.0])]


def brute_nearest(points, k):
    out = {}
    for i, c, v in points:
        near = sorted((math.dist(v, w), j) for j, e, w in points if e == c and j != i)
        out |= {(i, r): (j, d) for r, (d, j) in enumerate(near[:k], 1)}
    return out


@pytest.mark.parametrize("block, pivots", [(1024, 256), (7, 256), (5, 1)])
def test_neighbours_equal_brute_force(spark, block, pivots):
    df = spark.createDataFrame(POINTS, "id long, cls string, v array<double>").repartition(4)
    want = brute_nearest(POINTS, 4)
    got = {(r.id, r["rank"]): (r.neighbour, r.distance) for r in neighbours.nearest(df, df, 4, "id", "v", "cls", block, pivots).collect()}
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1]) for x in want)
    some = df.where("id < 40")
    assert neighbours.nearest(some, df, 4, "id", "v", "cls", block, pivots).count() == 160
    assert neighbours.nearest(df.where("id < 0"), df, 4, "id", "v").count() == 0


def test_neighbours_of_copies_and_no_copies_for_pairs_of_blocks(spark):
    # one vector forty times, keys as texts, and one that is not finite; nothing travels once for each pair of blocks
    points = [(str(i), "a", [1.0, -0.0 if i % 2 else 0.0]) for i in range(40)] + [(f"x{i}", "a", [float(i), 5.0]) for i in range(30)]
    df = spark.createDataFrame([*points, ("nan", "a", [float("nan"), 1.0])], "id string, cls string, v array<double>").repartition(3)
    out = neighbours.nearest(df, df, 3, "id", "v", "cls", 8)
    want = brute_nearest(points, 3)
    got = {(r.id, r["rank"]): (r.neighbour, r.distance) for r in out.collect()}
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1]) for x in want)
    assert "CoGroups" not in out._jdf.queryExecution().toString()


def test_smote_interpolates_between_neighbours(spark):
    points = [p for p in POINTS if p[1] != "lone"]
    df = spark.createDataFrame(points, "id long, cls string, v array<double>")
    out = balance.smote(df, "cls", "id", "v", k=3).collect()
    sizes = Counter(r.cls for r in out)
    assert set(sizes.values()) == {max(Counter(c for _, c, _ in points).values())} and sum(r.copy == 0 for r in out) == len(points)
    assert len({(r.id, r.copy) for r in out}) == len(out)
    near, at = brute_nearest(points, 3), {i: np.array(v) for i, _, v in points}
    for r in out:
        if r.copy:
            # on the segment to one of the three nearest
            gaps = [abs(np.linalg.norm(np.array(r.v) - at[r.id]) + np.linalg.norm(np.array(r.v) - at[j]) - d) for j, d in (near[r.id, q] for q in (1, 2, 3))]
            assert min(gaps) < 1e-9
    with pytest.raises(ValueError):
        balance.smote(spark.createDataFrame(POINTS, "id long, cls string, v array<double>"), "cls", "id", "v")


@pytest.mark.parametrize("rule", ["all", "mode"])
def test_contradicted_rows_go(spark, rule):
    df = spark.createDataFrame(POINTS, "id long, cls string, v array<double>")
    near, cls = brute_nearest([(i, "", v) for i, _, v in POINTS], 3), {i: c for i, c, _ in POINTS}
    votes = {i: [cls[near[i, r][0]] for r in (1, 2, 3)] for i in cls}
    if rule == "all":
        want = {i for i in cls if set(votes[i]) == {cls[i]}}
    else:
        want = {i for i in cls if min((-n, c) for c, n in Counter(votes[i]).items())[1] == cls[i]}
    assert {r.id for r in balance.edited(df, "cls", "id", "v", rule=rule).collect()} == want
    assert balance.smote_edited(df.where("cls <> 'lone'"), "cls", "id", "v").where("copy > 0").count() > 0
