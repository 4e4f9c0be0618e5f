"""Surrogates against the exact process and plain loops."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from matquarry.operators import attribution, surrogate


def rows(n=160, seed=1, noise=0.02):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * (1, 3)
    return [(i, float(a), float(b), float(math.exp(math.sin(a) - 0.2 * b + noise * rng.normal()))) for i, (a, b) in enumerate(x)]


def table(spark, made):
    return spark.createDataFrame(made, "id int, a double, b double, k double")


def test_all_rows_as_points_give_the_exact_process(spark):
    made = rows(80)
    data = surrogate._modelled(table(spark, made).repartition(3), ["a", "b"], "k", "id").withColumn("fold", F.lit(0))
    shift, scale = map(np.array, surrogate.standardisation(data, ["a", "b"]))
    points = (surrogate.inducing_points(data, ["a", "b"], 500) - shift) / scale
    assert len(points) == 80
    setting = surrogate.Setting(2.0, 3.0, 1e-2)
    model = surrogate._solved(spark, points, [(surrogate._sums(data, ["a", "b"], points, [(2.0, 3.0)], shift, scale, 2)[0, 0], setting)], shift, scale)[0]
    x, y = np.array([r[1:3] for r in made]), np.log([r[3] for r in made])
    exact = surrogate.Expert.fit((x - shift) / scale, y, 2.0, 1e-2, 3.0)
    asked = np.random.default_rng(3).normal(size=(50, 2)) * 2
    mu, variance, _ = exact.predict((asked - shift) / scale)
    got_mu, got_variance = model.predict(asked)
    assert np.allclose(mu, got_mu, atol=1e-3) and np.allclose(variance, got_variance, atol=1e-3)


def test_cross_validation_equals_a_plain_loop(spark):
    made = rows(60)
    found = surrogate.tune(table(spark, made), ["a", "b"], "k", "id", (2.0,), (1.0,), (1e-2,), folds=3, m=500).collect()
    assert sum(r["n"] for r in found) == 60 and len(found) == 3
    folded = surrogate.exact_folds(surrogate._modelled(table(spark, made), ["a", "b"], "k", "id"), "id", 3).toPandas()
    x = (folded[["a", "b"]] - folded[["a", "b"]].mean()) / folded[["a", "b"]].std(ddof=0)
    for r in found:
        test = folded["fold"] == r["fold"]
        model = surrogate.Expert.fit(x[~test].to_numpy(), folded["__y"][~test].to_numpy(), 2.0, 1e-2, 1.0)
        e = model.predict(x[test].to_numpy())[0] - folded["__y"][test]
        assert r["rmse"] == pytest.approx(float(np.sqrt((e * e).mean())), rel=0.02) and r["mae"] == pytest.approx(float(abs(e).mean()), rel=0.02)


def test_training_chooses_and_reports(spark):
    trained = surrogate.train(table(spark, rows(300)), ["a", "b"], "k", "id", (0.05, 2.0), (4.0,), (1e-2,), folds=4, m=100)
    report = trained.report.collect()
    assert len(report) == 1 and report[0]["n_test"] == 30 and report[0]["n_train"] == 270 and report[0]["r2_log"] > 0.9 and report[0]["cv_r2"] > 0.9
    assert trained.setting.length == 2.0 and trained.validated.count() == 8
    asked = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, float("nan"), 1.0)], "id int, a double, b double")
    got = {r["id"]: r for r in surrogate.predict(asked, trained.model, ["a", "b"], "id").collect()}
    assert got[1]["k_lower"] < got[1]["k_pred"] < got[1]["k_upper"] and abs(got[1]["mu_log"]) < 0.3
    assert got[2]["mu_log"] is None and got[3]["mu_log"] is None
    with pytest.raises(ValueError):
        surrogate.train(table(spark, [(1, 1.0, 1.0, -1.0)]), ["a", "b"], "k", "id")


def brute_shapley(nodes, x, n):
    """Shapley values of one tree by all subsets of features."""
    def value(known, at=0):
        node = nodes[at]
        if node["leftChild"] < 0:
            return node["prediction"]
        f, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
        if f in known:
            return value(known, node["leftChild"] if x[f] <= cut else node["rightChild"])
        return sum(value(known, c) * nodes[c]["rawCount"] / node["rawCount"] for c in (node["leftChild"], node["rightChild"]))

    out = []
    for i in range(n):
        rest = [f for f in range(n) if f != i]
        total = 0.0
        for k in range(n):
            w = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
            total += sum(w * (value({*s, i}) - value(set(s))) for s in combinations(rest, k))
        out.append(total)
    return out


@pytest.mark.parametrize("method", ["random_forest", "gradient_boosting"])
def test_attributions_equal_all_subsets(spark, method, tmp_path):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 4))
    made = [(i, *map(float, r), float(r[0] * r[1] + (r[2] > 0) + 0.1 * r[3])) for i, r in enumerate(x)]
    df = spark.createDataFrame(made, "id int, a double, b double, c double, d double, y double")
    assembled = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="v").transform(df)
    kind = {"featuresCol": "v", "labelCol": "y", "maxDepth": 3, "seed": 1}
    model = (RandomForestRegressor(numTrees=3, **kind) if method == "random_forest" else GBTRegressor(maxIter=3, **kind)).fit(assembled)
    explained = attribution.explain(df, model, ["a", "b", "c", "d"], "id").toPandas()
    guessed = {r["id"]: r["prediction"] for r in model.transform(assembled).collect()}
    assert all(r.prediction == pytest.approx(guessed[r.id]) for r in explained.itertuples())
    model.save(str(tmp_path / "m"))
    trees = {}
    for r in spark.read.parquet(str(tmp_path / "m/data")).select("treeID", "nodeData.*").collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    weights = list(model.treeWeights)
    share = sum(weights) if method == "random_forest" else 1.0
    for i in (0, 7, 50):
        want = sum(w / share * np.array(brute_shapley(trees[t], x[i], 4)) for t, w in enumerate(weights))
        assert np.allclose(explained[explained["id"] == i].set_index("feature").loc[["a", "b", "c", "d"], "attribution"], want)
    ranked = attribution.importance(spark.createDataFrame(explained)).collect()
    assert sorted(r["rank"] for r in ranked) == [1, 2, 3, 4]


def test_rows_without_features_are_not_explained(spark):
    made = [(i, float(i % 7), float(i % 3), float(1 + i % 7)) for i in range(60)] + [(60, None, 1.0, 2.0), (61, float("nan"), 1.0, 2.0), (62, 1.0, 1.0, 0.0)]
    found = surrogate.explain_rows(table(spark, made), ["a", "b"], "k", "id", "random_forest")
    assert {r["id"] for r in found.select("id").collect()} == set(range(60))
    top = surrogate.rank_features(table(spark, made), ["a", "b"], "k", "id", "random_forest").where("rank = 1").first()
    assert top["feature"] == "a"
