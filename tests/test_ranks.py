"""Ranks, running sums, quantiles and drift tests against plain Python."""

import math
import random

import numpy as np
from pyspark.ml.stat import KolmogorovSmirnovTest
from pyspark.sql import functions as F

from riskloom.operators import ml, ranks
from riskloom.streaming.jobs import _trailing


def data(n=3000):
    rng = random.Random(4)
    return [(k, rng.choice(["a", "a", "b", None]), 7.0 if rng.random() < 0.33 else rng.gauss(0, 100)) for k in range(n)]


def test_ranked_and_quantiles(spark):
    rows = data()
    df = spark.createDataFrame(rows, "id long, g string, x double")
    got = {r.id: (r["rank"], r.rank_all) for r in ranks.ranked(df, ["g"], F.col("x"), [F.col("x"), F.col("id")]).collect()}
    for g in ("a", "b", None):
        own = sorted((x, k) for k, h, x in rows if h == g)
        assert all(got[k] == (i + 1, len(own)) for i, (_, k) in enumerate(own))
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    for r in ranks.quantiles(df, ["g"], "x", shares).collect():
        own = [x for _, h, x in rows if h == r.g]
        assert np.allclose(r.q, np.quantile(own, shares))
    assert np.allclose(ranks.quantiles(df, [], "x", shares).first().q, np.quantile([x for *_, x in rows], shares))


def test_running_sums(spark):
    rows = [(g, float(k), k % 3) for g in "ab" for k in range(1000)]
    df = spark.createDataFrame(rows, "g string, x double, n int")
    for r in ranks.running(df, ["g"], "x", ["n"]).collect():
        assert r.n_upto == sum(k % 3 for k in range(int(r.x) + 1)) and r.n_all == 999


def test_ranking_metrics_are_exact(spark):
    rng = np.random.default_rng(2)
    s, y = np.round(rng.random(800), 9) * 1e-6 + 0.5, rng.random(800) < 0.3  # scores that six places would merge
    m = ml.ranking_metrics(spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "score double, label int")).first()
    better = (s[y][:, None] > s[~y][None, :]).mean() + 0.5 * (s[y][:, None] == s[~y][None, :]).mean()
    assert abs(m.auc - better) < 1e-9


def test_one_sample_drift(spark):
    rng = np.random.default_rng(5)
    x = np.sort(rng.normal(3, 2, 400))
    cdf = np.array([0.5 * (1 + math.erf((v - 3) / (2 * math.sqrt(2)))) for v in x])
    n = np.arange(1, 401) / 400
    want = max(np.abs(cdf - n).max(), np.abs(cdf - n + 1 / 400).max())
    base = spark.createDataFrame([("x", 3.0, 2.0), ("moved", 3.0, 2.0), ("absent", 0.0, 1.0), ("flat", 1.0, 0.0)], "feature string, mean double, std double")
    df = spark.createDataFrame([(float(v), float(v) + 4, 1.0) for v in x], "x double, moved double, flat double")
    got = {r.feature: r for r in ml.ks_normal(df, base).collect()}
    assert set(got) == {"x", "moved"} and abs(got["x"].d - want) < 1e-9 and not got["x"].drifted and got["moved"].drifted
    assert tuple(ml.drift_summary(ml.ks_normal(df, base)).first()) == (2, 0.5, "high")
    assert ml.drift_summary(ml.ks_normal(df, base.where("feature = 'absent'"))).first().drift_score is None


def test_normal_distribution(spark):
    z = [-40.0, -9.0, -7.08, -7.0, -3.5, -1e-9, 0.0, 0.3, 2.0, 7.0, 7.08, 9.0, 40.0]
    df = spark.createDataFrame([(v,) for v in z], "z double")
    for r in df.select("z", ml.normal_cdf(F.col("z")).alias("p")).collect():
        want = 0.5 * math.erfc(-r.z / math.sqrt(2))
        assert abs(r.p - want) < 1e-14 and (r.z < -37 or abs(r.p - want) <= 1e-6 * want)


def test_one_sample_drift_is_sparks_test(spark):
    """d to rounding, for small samples, ties and many features; p, which is exact there and asymptotic
    here, to 0.02 and where a drift is decided to 0.002."""
    rng = np.random.default_rng(8)
    x = np.stack([np.round(rng.normal(0.1 * k, 1, 60), 1 + k % 3) for k in range(6)], axis=1)
    names = [f"f{k}" for k in range(6)]
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], ", ".join(f"{n} double" for n in names))
    got = {r.feature: r for r in ml.ks_normal(df, spark.createDataFrame([(n, 0.0, 1.0) for n in names], "feature string, mean double, std double")).collect()}
    for n in names:
        want = KolmogorovSmirnovTest.test(df.select(F.col(n).alias("x")), "x", "norm", 0.0, 1.0).first()
        assert abs(got[n].d - want.statistic) < 1e-12 and abs(got[n].p_value - want.pValue) < (0.002 if want.pValue < 0.1 else 0.02)


def test_trailing_sums_move_with_time():
    rng = random.Random(6)
    pairs = sorted({(float(rng.randrange(300)), round(rng.random(), 4)) for _ in range(500)})
    times = sorted(t for t, _ in pairs)
    counts, sums = _trailing(pairs, times, 20.0)
    for t, n, s in zip(times, counts, sums, strict=True):
        inside = [p for p in pairs if t - 20 < p[0] <= t]
        assert n == len({p[0] for p in inside}) and s == round(sum(p[1] for p in inside), 2)
