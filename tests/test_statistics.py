import numpy as np
import pytest

from plansieve.operators import diagnostics as dg
from plansieve.operators import ensemble as en


def frames(spark, values, enacted, metric="efficiency_gap"):
    e = spark.createDataFrame([(metric, i, float(v)) for i, v in enumerate(values)], "metric string, plan_id long, value double")
    return e, spark.createDataFrame([(metric, float(enacted)), ("absent", 1.0)], "metric string, value double")


def walks(spark, chains):
    return spark.createDataFrame([("m", c, i, float(v)) for c, x in enumerate(chains) for i, v in enumerate(x)], "metric string, chain_id int, sample_idx int, value double")


def test_small_distribution(spark):
    e, v = frames(spark, [1, 2, 2, 3, 10], 3)
    o = en.outlier_analysis(e, v).collect()
    assert len(o) == 1 and o[0]["percentile"] == 70.0 and o[0]["p_value_two_sided"] == pytest.approx(0.6)
    assert o[0]["ensemble_std"] == pytest.approx(np.std([1, 2, 2, 3, 10])) and o[0]["direction"] == "neutral"
    assert en.percentile_midrank(e, v).first()["percentile"] == 70.0
    assert en.percentile_weak(e, v).first()["percentile"] == 80.0
    assert en.two_sided_p_value(e, v).first()["p_value_two_sided"] == pytest.approx(0.6)


@pytest.mark.parametrize(
    "metric, at, label",
    [
        ("cut_edge_ratio", 99, "less_compact"), ("mst_diameter", 1, "more_compact"), ("modularity", 99, "more_compact"), ("reock", 1, "less_compact"),
        ("efficiency_gap", 99, "republican_favoring"), ("mean_median", 1, "democratic_favoring"), ("efficiency_gap", 95, "neutral"), ("other", 99, "neutral"),
    ],
)
def test_directions(spark, metric, at, label):
    from pyspark.sql import functions as F

    assert spark.range(1).select(en.direction(F.lit(metric), F.lit(float(at)))).first()[0] == label


def test_severity_and_summary(spark):
    o = spark.createDataFrame([("a", 0.0), ("b", 0.01), ("c", 0.5)], "metric string, p_value_two_sided double")
    assert en.severity(o).first()["severity"] == pytest.approx(2.1003433319)
    assert en.severity(o.limit(0)).first()["severity"] == 0.0
    out = en.outlier_analysis(*frames(spark, range(10), 3))
    s = en.with_severity_row(en.summary_table(out, "PA"), out, "PA").collect()
    assert [r["metric"] for r in s] == ["efficiency_gap", "_composite_severity"] and np.isnan(s[1]["percentile"])


def test_bootstrap_goldens():
    assert en.bootstrap_interval(9, range(1, 11), 200, seed=7) == pytest.approx((0.4, 0.0, 1.0))
    for s, n, v, seed in ((0, 500, 2.0, 1), (1, 500, 0.0, 1), (99, 300, 1.5, 7)):
        x = np.random.default_rng(s).normal(size=n)
        p, lo, hi = got = en.bootstrap_interval(v, x, seed=seed)
        assert 0 <= lo <= p <= hi <= 1 and got == en.bootstrap_interval(v, x, seed=seed)
    p, lo, hi = en.bootstrap_interval(10, np.random.default_rng(2).normal(size=2000), 500, seed=3)
    assert p < 0.005 and hi - lo < 0.01
    x = np.random.default_rng(3).normal(size=2000)
    assert en.bootstrap_interval(np.median(x), x, seed=4)[0] > 0.5
    assert en.bootstrap_interval(0.42, np.full(100, 0.42)) == (1.0, 1.0, 1.0) and en.bootstrap_interval(1.0, np.full(100, 0.42)) == (0.0, 0.0, 0.0)
    assert np.isnan(en.bootstrap_interval(1.0, [])).all()


def test_bootstrap_frame(spark):
    row = en.bootstrap_p_value(*frames(spark, range(1, 11), 9), n_boot=200, seed=7).first()
    assert (row["p"], row["lo"], row["hi"]) == pytest.approx((0.4, 0.0, 1.0))


def test_histogram_edges(spark):
    h = {r["bin"]: r["n"] for r in en.histogram(frames(spark, [0, 1, 2, 3, 10], 0)[0], 5).collect()}
    assert h == {0: 2, 1: 2, 4: 1}
    assert en.histogram(frames(spark, [2, 2], 0)[0], 5).collect()[0]["bin"] == 0


def test_rhat(spark):
    r = lambda c: dg.gelman_rubin(walks(spark, c)).first()["rhat"]
    assert r([[1, 2, 3, 4], [2, 3, 4, 7]]) == pytest.approx(1.1641577032)
    x = np.random.default_rng(0).normal(size=200)
    assert r([x, x, x]) == pytest.approx(1.0) and r([x, x + 5]) > 1.5 and r([[1, 1], [2, 2]]) == 1.0
    assert 0.95 < r(np.random.default_rng(0).normal(size=(4, 500))) < 1.05
    for bad in ([x], [[1], [2]], [[1, 2], [1, 2, 3]]):
        with pytest.raises(Exception, match="R-hat"):
            r(bad)


WAVE = [1, 2, 3, 4, 5, 6, 5, 4, 3, 2, 1, 2, 3, 4, 5, 6]


def test_autocorrelation(spark):
    got = [r["rho"] for r in dg.autocorrelation(walks(spark, [WAVE]), 4).orderBy("lag").collect()]
    assert got == pytest.approx([1, 0.65625, 0.1875, -0.28125, -0.625]) and dg.acf(WAVE, 4) == pytest.approx(got)
    flat = [r["rho"] for r in dg.autocorrelation(walks(spark, [[1.0] * 6]), 3).orderBy("lag").collect()]
    assert flat == [1, 0, 0, 0]
    with pytest.raises(Exception, match="max_lag"):
        dg.autocorrelation(walks(spark, [[1, 2]]), 2).collect()
    with pytest.raises(ValueError):
        dg.acf([1, 2], 2)


def test_autocorrelation_of_noise_and_ar1():
    x = np.random.default_rng(1).normal(size=10_000)
    assert (abs(dg.acf(x, 50)[1:]) < 3 / 100 + 0.01).all()
    rng = np.random.default_rng(2)
    y = np.zeros(5000)
    for i in range(1, 5000):
        y[i] = 0.9 * y[i - 1] + rng.normal()
    assert dg.acf(y, 5) == pytest.approx([0.9**k for k in range(6)], abs=0.06)


def test_effective_size(spark):
    assert dg.ess(WAVE) == pytest.approx(5.9534883721)
    assert 750 < dg.ess(np.random.default_rng(3).normal(size=1000)) < 1100
    assert dg.ess(np.ones(1000)) == 1000 and dg.ess([1.0]) == 1 and dg.ess([1.0, 5.0, 2.0]) == 3
    rng = np.random.default_rng(4)
    y = np.zeros(5000)
    for i in range(1, 5000):
        y[i] = 0.9 * y[i - 1] + rng.normal()
    assert 100 < dg.ess(y) < 700
    assert dg.pooled_ess(walks(spark, [WAVE, WAVE])).first()["ess"] == pytest.approx(2 * 5.9534883721)


def test_thinning_and_worst(spark):
    steps = spark.range(20).withColumnRenamed("id", "step")
    assert [(r["step"], r["sample_idx"]) for r in dg.burn_and_thin(steps, 5, 4).orderBy("step").collect()] == [(5, 0), (9, 1), (13, 2), (17, 3)]
    r = spark.createDataFrame([("a", 1.2), ("b", float("nan"))], "metric string, rhat double")
    s = spark.createDataFrame([("a", 50.0), ("b", float("nan"))], "metric string, ess double")
    assert dg.worst(r, s).first().asDict() == {"max_rhat": 1.2, "min_ess": 50.0}
