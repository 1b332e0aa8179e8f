"""Feature engineering, fits, calibration, ranking metrics, drift and comparison."""

from __future__ import annotations

import itertools
import json
import math
import random
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Bucketizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import stored
from . import ranks, tables
from .routing import confusion


# Features.
def card_time(dt: Column) -> dict[str, Column]:
    day, hour = F.floor(dt / 86400), F.floor(dt % 86400 / 3600)
    return {"tx_day": day, "tx_hour": hour, "tx_weekday": day % 7, "is_weekend": (day % 7 >= 5).cast("int"), "is_night": ((hour >= 22) | (hour < 6)).cast("int")}


def calendar(us: Column) -> dict[str, Column]:
    """hour_of_day, day_of_week (Monday 0), is_weekend and is_business_hours (9 to 17 on weekdays)
    of microseconds since 1970, a Thursday."""
    hour, day = F.floor(F.pmod(us, F.lit(86_400_000_000)) / 3_600_000_000), F.pmod(F.floor(us / 86_400_000_000) + 3, F.lit(7))
    return {"hour_of_day": hour, "day_of_week": day, "is_weekend": (day >= 5).cast("int"), "is_business_hours": (hour.between(9, 17) & (day < 5)).cast("int")}


def flag_code(x: Column) -> Column:
    """T and F to 1 and 0, missing to -1."""
    return F.when(x == "T", 1).when(x == "F", 0).otherwise(-1)


def indexer(columns: list[str]) -> StringIndexer:
    """Lexicographic codes, fitted on the rows given; unseen values get a code of their own.
    Fill NULLs with 'missing' before."""
    return StringIndexer(inputCols=columns, outputCols=[f"{c}_code" for c in columns], stringOrderType="alphabetAsc", handleInvalid="keep")


def sparse_columns(df: DataFrame, columns: list[str], most: float = 0.95) -> list[str]:
    """Columns with more than that share of NULLs; one row reaches the driver."""
    row = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns)).first()
    return [c for c in columns if (row[c] or 0.0) > most]


def drop_and_fill(df: DataFrame, gone: list[str], fill: float = -999.0) -> DataFrame:
    numeric = [n for n, kind in df.dtypes if n not in gone and kind in ("int", "bigint", "float", "double")]
    return df.drop(*gone).fillna(fill, subset=numeric)


def interactions(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Products of columns that both exist."""
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs if a in df.columns and b in df.columns})


# Fits.
#: Rows that are worth a task of a fit, and rows that a task takes at most where cores are few.
FEWEST, MOST = 50_000, 2_000_000
#: Rows above which a fit takes those alike as one, and as how many these count at least together.
ALIKE, UNITS = 2_000_000, 1_000_000
#: Bins of a feature that a fit tells apart, as many as Spark's trees take.
BINS = 32


def fit_rows(df: DataFrame) -> DataFrame:
    """All rows of df, dealt evenly to as many tasks as there are cores to use. A fit runs hundreds of
    jobs over its rows, and each task of each reports to the driver: what counts is the tasks and
    not the files that the rows came from."""
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(-(-n // FEWEST), 2 * cores), -(-n // MOST)))


def boosted_trees(features: list[str], label: str = "label", weight: str | None = None, **params) -> Pipeline:
    given = {"maxDepth": 6, "stepSize": 0.1, "maxIter": 100, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42} | params
    trees = GBTClassifier(featuresCol="features", labelCol=label, **given, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), trees])


def bins(df: DataFrame, features: list[str]) -> Bucketizer:
    """Bins of the features, from all rows of df, as Spark's trees cut them: every value by itself
    where there are at most BINS, else quantiles, with a bin of its own for a value that fills more
    than one. Missing values get a bin above all."""
    near = df.agg(*(F.approx_count_distinct(c).alias(c) for c in features)).first()
    few = [c for c in features if near[c] <= 2 * BINS]
    values = df.agg(*(F.sort_array(F.collect_set(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")))).alias(c) for c in few)).first() if few else {}
    rest = [c for c in features if c not in few or len(values[c]) > BINS]
    shares = [k / BINS for k in range(BINS)]
    ends = dict(zip(rest, df.select(*(F.col(c).cast("double").alias(c) for c in rest)).approxQuantile(rest, shares, 0.001), strict=True)) if rest else {}
    cuts = []
    for c in features:
        if c in ends:
            q = ends[c]
            found = {v for v in q if v > q[0]} | {math.nextafter(v, math.inf) for v in q if q.count(v) > 1}
        else:
            found = {(a + b) / 2 for a, b in itertools.pairwise(values[c])}
        cuts.append([-math.inf, *(sorted(found) or [0.0]), math.inf])
    return Bucketizer(inputCols=features, outputCols=[f"{c}_bin" for c in features], splitsArray=cuts, handleInvalid="keep")


def cells(binned: DataFrame, columns: list[str], weight: Column | None = None) -> DataFrame:
    """columns, n and weight of all rows: those equal in the columns as one. Bins lose their mark as
    categories, since they are in order."""
    w = F.lit(1.0) if weight is None else weight
    return binned.groupBy(*(F.col(c).alias(c, metadata={}) for c in columns)).agg(F.sum(F.col("n") if "n" in binned.columns else F.lit(1)).alias("n"), F.sum(w.cast("double")).alias("weight"))


def units(alike: DataFrame, rows: int) -> DataFrame:
    """Cells dealt to units of at most a millionth of all rows, each with its share of the weight, since a tree
    draws its part of the rows by units."""
    parts = F.ceil(F.col("n") / max(1, -(-rows // UNITS))).cast("int")
    return alike.withColumn("_parts", parts).select(*(c for c in alike.columns if c not in ("n", "weight")), (F.col("weight") / F.col("_parts")).alias("weight"), F.explode(F.sequence(F.lit(1), F.col("_parts")))).drop("col")


def _summable(rows: int, params: dict[str, list]) -> bool:
    """Whether a fit with any of these values of its parameters may take rows alike as one: not where leaves
    have a least number of rows, which has to be counted, or more bins are asked for."""
    return rows > ALIKE and max(params.get("minInstancesPerNode", [1])) <= 1 and max(params.get("maxBins", [BINS])) <= BINS


def binned_trees(cut: Bucketizer, label: str = "label", **params) -> Pipeline:
    return boosted_trees(cut.getOutputCols(), label, "weight", **{"maxBins": BINS + 1} | params)


def fit_trees(df: DataFrame, features: list[str], label: str = "label", weight: str | None = None, **params) -> PipelineModel:
    """Boosted trees fitted on all rows of df. A tree tells rows apart by bin and label only, so of a large
    table, rows equal in these are summed to weighted ones first: a fit's hundreds of passes then
    go over at most a million more than there are bins met together, whatever the rows."""
    n = df.count()
    if not _summable(n, {p: [v] for p, v in params.items()}):
        return boosted_trees(features, label, weight, **params).fit(fit_rows(df))
    df = stored(df.select(*features, label, *([weight] if weight else [])), "fit")
    cut = bins(df, features)
    alike = cells(cut.transform(df), [*cut.getOutputCols(), label], F.col(weight) if weight else None)
    model = binned_trees(cut, label, **params).fit(fit_rows(stored(units(alike, n), "fit-cells")))
    return PipelineModel([cut, *model.stages])


def class_weighted(df: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    """df with a weight: the number of 0 labels over that of 1 labels for rows labelled 1, else 1
    (1 for all where a label is missing altogether)."""
    count = lambda v: F.sum((F.col(label) == v).cast("double"))
    ratio = df.agg(F.try_divide(count(0), count(1)).alias("_ratio"))
    both = df.crossJoin(F.broadcast(ratio))  # one row
    return both.withColumn(weight, F.when((F.col(label) == 1) & (F.col("_ratio") > 0), F.col("_ratio")).otherwise(1.0)).drop("_ratio")


def probability(scored: DataFrame) -> Column:
    return vector_to_array("probability")[1]


def side_by_side(tasks: list, parallelism: int) -> list:
    """Results of driver-side tasks, in order, that many at a time: small fits leave executors idle
    between their jobs, so the jobs of several fill them."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        return pool.map(lambda run: run(), [inherit(t) for t in tasks])


def _of_folds(train: DataFrame, features: list[str], label: str, params: dict[str, list], name: str) -> tuple[DataFrame, Bucketizer | None, int]:
    """Rows of a search over folds, stored once for all its fits: as they are, or, of a large table,
    summed by bins, label and fold, with n and weight; the bins, if so; how many rows there are."""
    ready = stored(train.select(*features, label, "fold"), name)
    n = ready.count()
    if not _summable(n, params):
        return ready, None, n
    cut = bins(ready, features)
    return stored(cells(cut.transform(ready), [*cut.getOutputCols(), label, "fold"]), f"{name}-cells"), cut, n


def random_search(train: DataFrame, features: list[str], grid: dict[str, list], n: int, k: int, label: str = "label", seed: int = 42, parallelism: int = 4) -> DataFrame:
    """params (text) and mean auc (without bins) of n parameter sets drawn from the grid, over the
    folds 0 to k - 1 of column fold. Features are assembled once, fits run side by side. Rows of
    the same bins have the same score, so those of a large table are scored once for all."""
    sets = [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
    drawn = random.Random(seed).sample(sets, min(n, len(sets)))
    rows, cut, many = _of_folds(train, features, label, grid, "search-folds")
    assemble, trees = (binned_trees(cut, label) if cut else boosted_trees(features, label)).getStages()
    ready = assemble.transform(rows)
    if cut:
        own = [*cut.getOutputCols(), label]
        fits = [stored(assemble.transform(units(cells(rows.where(F.col("fold") != f), own, F.col("weight")), many)).select("features", label, "weight"), "search-fit") for f in range(k)]
        auc = BinaryClassificationEvaluator(labelCol=label, weightCol="weight", numBins=0)
    else:
        ready = stored(ready.select("features", label, "fold"), "search-rows")
        fits = [ready.where(F.col("fold") != f) for f in range(k)]
        auc = BinaryClassificationEvaluator(labelCol=label, numBins=0)

    def one(chosen: dict, f: int) -> float:
        fitted = trees.fit(fit_rows(fits[f]), {trees.getParam(p): v for p, v in chosen.items()})
        return auc.evaluate(fitted.transform(ready.where(F.col("fold") == f)))

    scores = side_by_side([partial(one, chosen, f) for chosen in drawn for f in range(k)], parallelism)
    means = np.array(scores).reshape(len(drawn), k).mean(axis=1)
    rows = [(str(sorted(chosen.items())), float(mean)) for chosen, mean in zip(drawn, means, strict=True)]
    return train.sparkSession.createDataFrame(rows, "params string, auc double")


def platt_fit(scored: DataFrame, label: str = "label", margin: str = "margin") -> tuple[float, float]:
    """Slope and intercept of a sigmoid over the margin, with smoothed targets: each row twice,
    weighted by its target and what is left of it. Rows of the same margin and label go into the fit as one."""
    scored = stored(scored.groupBy(F.col(margin).alias("m"), F.col(label).alias("label")).agg(F.count("*").alias("k")), "margins")
    n = scored.agg(F.sum(F.when(F.col("label") == 1, F.col("k"))), F.sum(F.when(F.col("label") == 0, F.col("k")))).first()
    positive, negative = n[0] or 0, n[1] or 0
    pos, neg = (positive + 1) / (positive + 2), 1 / (negative + 2)
    target = F.when(F.col("label") == 1, pos).otherwise(neg)
    both = scored.select("m", F.inline(F.array(F.struct(F.lit(1.0).alias("y"), (target * F.col("k")).alias("w")), F.struct(F.lit(0.0).alias("y"), ((1 - target) * F.col("k")).alias("w")))))
    data = VectorAssembler(inputCols=["m"], outputCol="features").transform(both)
    fit = LogisticRegression(labelCol="y", weightCol="w", regParam=0.0, standardization=False).fit(data)
    return float(fit.coefficients[0]), float(fit.intercept)


def sigmoid(margin: Column, slope: float, intercept: float) -> Column:
    return 1 / (1 + F.exp(-(F.lit(slope) * margin + F.lit(intercept))))


def importances(model: PipelineModel, features: list[str], spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values, strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def cross_validated(train: DataFrame, features: list[str], k: int = 5, label: str = "label", parallelism: int = 4, **params) -> DataFrame:
    """metric, scores, mean, std (population) and band of auc, precision, recall and f1: one fit
    for each of the folds 0 to k - 1 of column fold, scored on the rows of that fold; fits run
    side by side. Rows of the same bins have the same score, so those of a large table are scored
    once and counted as many."""
    ready, cut, many = _of_folds(train, features, label, {p: [v] for p, v in params.items()}, "cv-folds")

    def one(f: int) -> list[float]:
        rest, own = ready.where(F.col("fold") != f), ready.where(F.col("fold") == f)
        if cut:
            rest = stored(units(cells(rest, [*cut.getOutputCols(), label], F.col("weight")), many), "cv-fit")
        model = (binned_trees(cut, label, **params) if cut else boosted_trees(features, label, **params)).fit(fit_rows(rest))
        held = stored(model.transform(own).select(label, probability(train).alias("score"), "prediction", F.col("n") if cut else F.lit(1).alias("n")), "cv-scores")
        counts = confusion(held, F.col("prediction") == 1, F.col(label) == 1, rows=F.col("n")).first()
        return [ranking_metrics(held, label, "score", rows=F.col("n")).first()["auc"] or 0.0, *(float(counts[m] or 0.0) for m in ("precision", "recall", "f1"))]

    found = zip(*side_by_side([partial(one, f) for f in range(k)], parallelism), strict=True)
    rows = [(m, list(s), float(np.mean(s)), float(np.std(s))) for m, s in zip(("auc", "precision", "recall", "f1"), found, strict=True)]
    return train.sparkSession.createDataFrame(rows, "metric string, scores array<double>, mean double, std double").withColumn("band", stability(F.col("std")))


def stability(std: Column) -> Column:
    return F.when(std < 0.02, "very stable").when(std < 0.05, "stable").otherwise("unstable")


# Saved models.
def save_model(model: PipelineModel, features: list[str], metadata: dict, root: str, stamp: str) -> None:
    """A fitted pipeline, its features in order and its metadata, in a folder of its stamp. The
    metadata come last: a folder without them is no model yet."""
    spark = SparkSession.active()
    path = f"{root}/model={stamp}"
    model.write().overwrite().save(f"{path}/pipeline")
    spark.createDataFrame(list(enumerate(features)), "place int, feature string").coalesce(1).write.mode("overwrite").json(f"{path}/features")
    spark.createDataFrame([(stamp, json.dumps(metadata, sort_keys=True))], "stamp string, metadata string").write.mode("overwrite").json(f"{root}/metadata/stamp={stamp}")


def newest_model(spark: SparkSession, root: str) -> tuple[PipelineModel, list[str], dict]:
    """The model with the last stamp, its features in order and its metadata."""
    last = spark.read.schema("stamp string, metadata string").json(f"{root}/metadata/*").orderBy(F.desc("stamp")).first()
    path = f"{root}/model={last.stamp}"
    features = [r.feature for r in spark.read.schema("place int, feature string").json(f"{path}/features").orderBy("place").collect()]
    return PipelineModel.load(f"{path}/pipeline"), features, json.loads(last.metadata)


# Ranking metrics.
def ranking_metrics(df: DataFrame, label: str = "label", score: str = "score", rows: Column | None = None) -> DataFrame:
    """One row: auc, average_precision, brier, log_loss, precision_at_half_recall. Labels are
    counted by score, and running counts go through ranges of the scores. rows: how many a row
    of df stands for, if not one."""
    y = F.col(label).cast("double")
    p = F.greatest(F.lit(2.2e-16), F.least(F.lit(1 - 2.2e-16), F.col(score)))
    k = F.lit(1) if rows is None else rows
    mean = lambda x: F.avg(x) if rows is None else F.try_divide(F.sum(x * k), F.sum(F.when(x.isNotNull(), k)))
    plain = df.agg(mean(F.pow(F.col(score) - y, 2)).alias("brier"), mean(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))
    by = df.groupBy((-F.col(score).cast("double")).alias("down")).agg(F.sum(y * k).alias("p"), F.sum((1 - y) * k).alias("n"))
    t = ranks.running(by, [], "down", ["p", "n"])
    tp, fp = F.col("p_upto"), F.col("n_upto")
    t = t.withColumns({"precision": tp / (tp + fp), "recall": F.try_divide(tp, "p_all")})
    gap = F.abs(F.col("recall") - 0.5)
    out = t.agg(
        F.sum(F.col("n") * (tp - F.col("p")) + 0.5 * F.col("p") * F.col("n")).alias("a"),
        F.max(F.col("p_all") * F.col("n_all")).alias("pn"),
        F.sum(F.try_divide("p", "p_all") * F.col("precision")).alias("average_precision"),
        F.min_by("precision", F.struct(gap, -F.col("down"))).alias("at_half"),
        F.min(gap).alias("_gap"),
    )
    half = F.when(F.col("_gap") <= 0.5, F.col("at_half")).otherwise(1.0).alias("precision_at_half_recall")
    return out.crossJoin(F.broadcast(plain)).select(F.try_divide("a", "pn").alias("auc"), "average_precision", "brier", "log_loss", half)  # one row each


def calibration_compare(df: DataFrame, label: str, before: str, after: str) -> DataFrame:
    m = lambda c, tag: ranking_metrics(df, label, c).select(F.col("brier").alias(f"brier_{tag}"), F.col("log_loss").alias(f"log_loss_{tag}"))
    both = m(before, "before").crossJoin(F.broadcast(m(after, "after")))  # one row each
    return both.withColumn("brier_improvement_pct", F.coalesce(F.try_divide(F.col("brier_before") - F.col("brier_after"), F.col("brier_before")) * 100, F.lit(0.0)))


def model_compare(df: DataFrame, label: str, a: str, b: str, threshold: float = 0.5) -> DataFrame:
    """One row: metrics of both scores, a point for the strictly better, the winner."""
    def side(score: str, tag: str) -> DataFrame:
        c = confusion(df, F.col(score) >= threshold, F.col(label) == 1)
        auc = ranking_metrics(df, label, score).select("auc")
        both = c.crossJoin(F.broadcast(auc))  # one row each
        return both.select(*(F.col(x).alias(f"{x}_{tag}") for x in ("precision", "recall", "f1", "auc", "fpr", "fp")))

    both = side(a, "a").crossJoin(F.broadcast(side(b, "b")))
    higher, lower = ("precision", "recall", "f1", "auc"), ("fpr", "fp")
    point = lambda x, y: sum((F.col(f"{m}_{x}") > F.col(f"{m}_{y}")).cast("int") for m in higher) + sum((F.col(f"{m}_{x}") < F.col(f"{m}_{y}")).cast("int") for m in lower)
    out = both.withColumns({"points_a": point("a", "b"), "points_b": point("b", "a")})
    winner = F.when(F.col("points_a") > F.col("points_b"), "a").when(F.col("points_b") > F.col("points_a"), "b").otherwise("tie")
    return out.withColumns({"winner": winner, "fpr_reduction_pct": F.coalesce(F.try_divide(F.col("fpr_a") - F.col("fpr_b"), F.col("fpr_a")) * 100, F.lit(0.0))})


# Drift.
def ks_p_value(d: Column, n: Column) -> Column:
    """Asymptotic, for n the effective number of rows."""
    lam = d * F.sqrt(n)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(d == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))


def ks_two_sample(base: DataFrame, new: DataFrame, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """feature, d, p_value, drifted. Running shares over the distinct values of each feature, in
    ranges of the values."""
    long = lambda df, k: tables.unpivoted(df, columns).withColumn("side", F.lit(k))
    by = long(base, 0).unionAll(long(new, 1)).groupBy("feature", "x").agg(F.sum(1 - F.col("side")).alias("a"), F.sum("side").alias("b"))
    run = ranks.running(by, ["feature"], "x", ["a", "b"])
    gap = F.abs(F.try_divide("a_upto", "a_all") - F.try_divide("b_upto", "b_all"))
    d = run.groupBy("feature").agg(F.max(gap).alias("d"), F.max("a_all").alias("na"), F.max("b_all").alias("nb"))
    out = d.withColumn("p_value", ks_p_value(F.col("d"), F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))))
    return out.select("feature", "d", "p_value", (F.col("p_value") < alpha).alias("drifted"))


# Hart's rational approximation of the normal distribution, numerator and
# denominator from the highest power down.
ABOVE = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
BELOW = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(z: Column) -> Column:
    """Share of the standard normal distribution up to z, to 14 places."""
    far = F.abs(z)
    powers = lambda terms: reduce(lambda sum_, term: sum_ * far + F.lit(term), terms[1:], F.lit(terms[0]))
    fraction = reduce(lambda sum_, k: far + F.lit(float(k)) / sum_, (4, 3, 2, 1), far + F.lit(0.65))
    bell = F.exp(-far * far / 2)
    tail = F.when(far < 7.07106781186547, bell * powers(ABOVE) / powers(BELOW)).otherwise(bell / fraction / 2.506628274631)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def ks_normal(new: DataFrame, baseline: DataFrame, alpha: float = 0.05) -> DataFrame:
    """feature, d, p_value, drifted: new values against a normal distribution of the baseline's
    mean and std (a row for each feature, so few). All features in one pass, through ranges of
    their values. Features that new lacks are left out, and those whose baseline has no spread or
    that have no value. p_value is asymptotic with Stephens' correction for small samples: of 60 rows
    it is off by up to 0.02, by 0.002 below 0.1."""
    of = {r.feature for r in baseline.where("std > 0").select("feature").collect()}
    columns = [c for c in new.columns if c in of]
    if not columns:
        return new.sparkSession.createDataFrame([], "feature string, d double, p_value double, drifted boolean")
    run = ranks.running(tables.unpivoted(new, columns).groupBy("feature", "x").agg(F.count("*").alias("k")), ["feature"], "x", ["k"])
    at = run.join(baseline.where("std > 0").select("feature", "mean", "std"), "feature")
    expected, n = normal_cdf((F.col("x") - F.col("mean")) / F.col("std")), F.col("k_all")
    gap = F.greatest(F.abs(expected - F.col("k_upto") / n), F.abs(expected - (F.col("k_upto") - F.col("k")) / n))
    d = at.groupBy("feature").agg(F.max(gap).alias("d"), F.max("k_all").cast("double").alias("n"))
    root = F.sqrt("n")
    out = d.withColumn("p_value", ks_p_value(F.col("d"), F.pow(root + 0.12 + 0.11 / root, 2)))
    return out.select("feature", "d", "p_value", (F.col("p_value") < alpha).alias("drifted"))


def drift_summary(tests: DataFrame) -> DataFrame:
    """One row: tested, drift_score (share of drifted features, NULL if none was tested), level."""
    share = F.avg(F.col("drifted").cast("double"))
    return tests.agg(F.count("*").alias("tested"), share.alias("drift_score")).withColumn("level", F.when(F.col("drift_score") > 0.3, "high").when(F.col("drift_score") > 0.1, "moderate").otherwise("low"))
