"""Flat scores against Spark's own, class weights, calibration of fitted margins, searches."""

import ast
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import ml, trees

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """A fraud label that depends on three columns, of which some values are missing or tied."""
    rng, out = random.Random(4), []
    for i in range(900):
        a, b, c = rng.gauss(0, 1), float(rng.randrange(6)), rng.random()
        label = float(a + 0.4 * b + c * c + rng.gauss(0, 0.6) > 2.4)
        out.append((i, None if i % 31 == 0 else a, math.nan if i % 37 == 0 else b, c, label, i % 3))
    df = spark.createDataFrame(out, "id long, a double, b double, c double, label double, fold int")
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def full(rows):
    """The rows with missing values filled, as fits want them; scoring takes any."""
    return rows.fillna(-999.0, NAMES).cache()


@pytest.mark.parametrize("depth", [1, 6, 8])  # 8: more than 64 leaves
def test_flat_margins_are_sparks(rows, full, depth):
    model = ml.boosted_trees(NAMES, maxIter=4, maxDepth=depth, minInstancesPerNode=1).fit(full)
    forest = trees.exported(model)
    if depth == 8:
        assert max(len(t.values) for t in forest.trees) > 64
    margin = trees.margin(forest, NAMES)
    scored = model.transform(rows.withColumn("flat", margin))
    got = scored.select("flat", trees.probability(F.col("flat")).alias("p"), ml.probability(scored).alias("want")).collect()
    assert len(got) == 900 and all(abs(r.p - r.want) < 1e-12 for r in got)
    rest = model.transform(rows).select("rawPrediction").collect()
    assert np.allclose(sorted(r.flat for r in got), sorted(r.rawPrediction[1] for r in rest), atol=1e-12)


def test_trees_without_a_split(rows, full):
    same = full.withColumn("label", F.lit(1.0))
    model = ml.boosted_trees(NAMES, maxIter=2).fit(same)
    assert not trees.exported(model).trees[0].splits
    flat = rows.select(trees.probability(trees.margin(trees.exported(model), NAMES)).alias("p"))
    want = model.transform(rows).select(ml.probability(rows).alias("p"))
    assert {round(r.p, 12) for r in flat.collect()} == {round(r.p, 12) for r in want.collect()}
    assert rows.limit(0).select(trees.margin(trees.exported(model), NAMES)).count() == 0
    with pytest.raises(ValueError):
        trees.margin(trees.exported(model), ["a"])


def test_class_weights(spark):
    df = spark.createDataFrame([(1.0,)] + [(0.0,)] * 9, "label double")
    assert sorted(r.weight for r in ml.class_weighted(df).collect()) == [1.0] * 9 + [9.0]
    one_class = df.where("label = 1").unionAll(df.where("label = 1"))
    assert [r.weight for r in ml.class_weighted(one_class).collect()] == [1.0, 1.0]
    assert ml.class_weighted(df.limit(0)).count() == 0
    assert [r.weight for r in ml.class_weighted(df.select(F.lit(None).cast("double").alias("label")).limit(1)).collect()] == [1.0]


def test_calibration_of_fitted_margins(full):
    model = ml.boosted_trees(NAMES, maxIter=5, maxDepth=4).fit(full.where("fold = 2"))
    with_margin = full.withColumn("margin", trees.margin(trees.exported(model), NAMES))
    slope, intercept = ml.platt_fit(with_margin.where("fold = 1"))
    sample = [(r.margin, r.label) for r in with_margin.where("fold = 1").select("margin", "label").collect()]
    m, y = np.array([s[0] for s in sample]), np.array([s[1] for s in sample])
    pos, neg = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target, w = np.where(y == 1, pos, neg), np.zeros(2)
    x = np.stack([m, np.ones_like(m)], axis=1)
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (target - p))
    assert abs(slope - w[0]) < 1e-3 * abs(w[0]) and abs(intercept - w[1]) < 1e-3 * max(1, abs(w[1]))
    held = with_margin.where("fold = 0").withColumns({"score": trees.probability(F.col("margin")), "calibrated": ml.sigmoid(F.col("margin"), slope, intercept)})
    r = ml.calibration_compare(held, "label", "score", "calibrated").first()
    assert r.brier_after < r.brier_before


def test_search_side_by_side_is_the_same_as_in_turn(full):
    grid = {"maxDepth": [1, 2], "maxIter": [1, 3]}
    in_turn = ml.random_search(full, NAMES, grid, 3, 3, parallelism=1).collect()
    assert ml.random_search(full, NAMES, grid, 3, 3, parallelism=4).collect() == in_turn and len(in_turn) == 3
    first = in_turn[0]
    params = dict(ast.literal_eval(first.params))
    auc = []
    for f in range(3):
        model = ml.boosted_trees(NAMES, **params).fit(full.where(F.col("fold") != f))
        held = model.transform(full.where(F.col("fold") == f))
        auc.append(ml.ranking_metrics(held.withColumn("score", ml.probability(held)), "label", "score").first().auc)
    assert abs(first.auc - np.mean(auc)) < 0.02


def test_folds_side_by_side(full):
    one, four = (ml.cross_validated(full, NAMES, 3, parallelism=p, maxIter=2, maxDepth=2).collect() for p in (1, 4))
    assert one == four and [r.metric for r in one] == ["auc", "precision", "recall", "f1"]
    assert all(len(r.scores) == 3 for r in one)


def test_tasks_keep_their_order_and_errors(spark):
    assert ml.side_by_side([lambda i=i: i for i in range(9)], 3) == list(range(9))

    def fails():
        raise KeyError("x")

    with pytest.raises(KeyError):
        ml.side_by_side([fails], 2)


def test_fits_have_few_tasks(spark, full, monkeypatch):
    many = spark.range(1_000).repartition(64)
    assert ml.fit_rows(many).rdd.getNumPartitions() == 1 and ml.fit_rows(many).count() == 1_000
    monkeypatch.setattr(ml, "FEWEST", 10)
    assert ml.fit_rows(many).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(ml, "MOST", 50)
    assert ml.fit_rows(many).rdd.getNumPartitions() == 20
    monkeypatch.undo()
    seen, fit = [], ml.GBTClassifier._fit
    monkeypatch.setattr(ml.GBTClassifier, "_fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    ml.cross_validated(full.repartition(40), NAMES, 3, maxIter=1, maxDepth=1)
    ml.random_search(full.repartition(40), NAMES, {"maxDepth": [1], "maxIter": [1]}, 1, 3)
    assert seen == [1] * 6


def large(monkeypatch, n=100):
    monkeypatch.setattr(ml, "ALIKE", n)
    seen, fit = [], ml.GBTClassifier._fit
    monkeypatch.setattr(ml.GBTClassifier, "_fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    return seen


def test_bins_are_even_and_keep_single_values(rows):
    df = rows.select("a", "b", F.when(F.col("id") % 3 == 0, -999.0).otherwise(F.col("c")).alias("c"))
    cut = ml.bins(df, NAMES)
    got = cut.transform(df)
    assert all(len(s) <= ml.BINS + 1 for s in cut.getSplitsArray())
    sizes = {c: {r[0]: r[1] for r in got.groupBy(f"{c}_bin").count().collect()} for c in NAMES}
    assert len(sizes["b"]) == 7 and sizes["b"][6.0] == 25  # six values, and the missing above them
    assert max(sizes["a"].values()) <= 40 and len(sizes["a"]) == ml.BINS + 1
    alone, others = ({r[0] for r in got.where(f"c {op} -999").select("c_bin").collect()} for op in ("=", "<>"))
    assert len(alone) == 1 and not alone & others
    assert ml.bins(rows.select(F.lit(1.0).alias("a"), F.lit(None).cast("double").alias("b")), ["a", "b"]).getSplitsArray() == [[-math.inf, 0.0, math.inf]] * 2


@pytest.mark.parametrize("weight", [None, "weight"])
def test_rows_alike_fit_the_same_trees(full, monkeypatch, weight):
    """Thirty copies of rows on a grid, without subsampling: as many trees as of all rows, each with the same leaves."""
    grid = full.select(*(F.floor(F.col(c) * 3).cast("double").alias(c) for c in NAMES), "label", (F.col("label") * 2 + 1).alias("weight"))
    rows = grid.crossJoin(full.sparkSession.range(30).select("id")).drop("id").cache()
    given = {"maxIter": 3, "maxDepth": 3, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}
    monkeypatch.setattr(ml, "UNITS", 1_000)
    whole = ml.fit_trees(rows, NAMES, weight=weight, **given)
    seen = large(monkeypatch)
    summed = ml.fit_trees(rows, NAMES, weight=weight, **given)
    assert seen[0] < 3_000 and len(summed.stages) == 3 and len(whole.stages) == 2
    scored = [m.transform(rows).select(*NAMES, ml.probability(rows).alias("p")).distinct().collect() for m in (whole, summed)]
    one, two = ({tuple(r[c] for c in NAMES): r.p for r in s} for s in scored)
    assert max(abs(one[k] - two[k]) for k in one) < 1e-9 and len(one) == len(two)


def test_flat_margins_of_binned_fits(rows, full, monkeypatch):
    seen = large(monkeypatch)
    model = ml.fit_trees(full, NAMES, maxIter=4)
    assert len(seen) == 1 and len(model.stages) == 3
    scored = model.transform(rows.withColumn("flat", trees.margin(trees.exported(model), NAMES)))
    got = scored.select("flat", trees.probability(F.col("flat")).alias("p"), ml.probability(scored).alias("want")).collect()
    assert len(got) == 900 and all(abs(r.p - r.want) < 1e-12 for r in got)


def test_large_searches_score_all_rows(full, monkeypatch):
    grid = {"maxDepth": [2], "maxIter": [3]}
    rows = full.select(F.round("a").alias("a"), "b", F.round("c", 1).alias("c"), "label", "fold")
    small, folds = ml.random_search(rows, NAMES, grid, 1, 3).first(), ml.cross_validated(rows, NAMES, 3, maxIter=3, maxDepth=2, subsamplingRate=1.0, featureSubsetStrategy="all").collect()
    seen = large(monkeypatch)
    assert abs(ml.random_search(rows, NAMES, grid, 1, 3).first().auc - small.auc) < 0.05
    again = ml.cross_validated(rows, NAMES, 3, maxIter=3, maxDepth=2, subsamplingRate=1.0, featureSubsetStrategy="all").collect()
    assert max(abs(x - y) for a, b in zip(folds, again, strict=True) for x, y in zip(a.scores, b.scores, strict=True)) < 1e-9
    assert len(seen) == 6 and max(seen) <= 600
    ml.cross_validated(rows, NAMES, 3, maxIter=1, maxDepth=1, minInstancesPerNode=5)
    assert seen[-3:] == [600] * 3
