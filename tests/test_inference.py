import math

import numpy as np
import pytest
from helpers import by
from data import two_points

from plumbline.functions import distributions as d
from plumbline.operators import inference


# The known intervals come from critical values that a solver found to within 1e-9, so the
# interval ends are compared to 1e-9 standard errors and a little more.


@pytest.fixture(scope="module")
def patients(spark):
    values = two_points(768, 120.89453125, 31.97261819513622)
    return spark.createDataFrame([(v,) for v in values], "Glucose double").cache()


@pytest.fixture(scope="module")
def outcomes(spark):
    rows = [("1", v) for v in two_points(268, 141.25746269, 31.93962206)]
    rows += [("0", v) for v in two_points(494, 110.05668016, 26.16852905)] + [("O", 100.0)] * 6
    return spark.createDataFrame(rows, "Outcome string, Glucose double").cache()


def test_one_sample_t(patients):
    found = inference.one_sample_test(patients, "Glucose", "t", 120).first()
    assert (found["n"], found["df"]) == (768, 767)
    assert found["statistic"] == pytest.approx(0.7753502397592414, rel=1e-12)
    assert found["p_value"] == pytest.approx(0.43837170991267804, rel=1e-11)
    assert [found["ci_low"], found["ci_high"]] == pytest.approx([118.6297224514571, 123.1593400485429], abs=2e-9)
    assert not found["reject_null"]
    greater = inference.one_sample_test(patients, "Glucose", "t", 120, "greater").first()["p_value"]
    less = inference.one_sample_test(patients, "Glucose", "t", 120, "less").first()["p_value"]
    assert greater == pytest.approx(0.21918585495633902, rel=1e-11)
    assert less == pytest.approx(1 - 0.21918585495633902, rel=1e-11)


def test_one_sample_z(patients):
    found = inference.one_sample_test(patients, "Glucose", "z", 120).first()
    assert found["p_value"] == pytest.approx(0.43813273004476994, rel=1e-11)
    assert [found["ci_low"], found["ci_high"]] == pytest.approx([118.63329633558247, 123.15576616441753], rel=1e-12)


def test_two_samples(outcomes):
    """The moments are known to eight decimals, and so are the results."""
    found = inference.two_sample_test(outcomes, "Glucose", "Outcome", "1", "0").first()
    assert (found["n_a"], found["n_b"]) == (268, 494)
    assert found["statistic"] == pytest.approx(13.692050599791772, rel=1e-8)
    assert found["df"] == pytest.approx(463.58104309644114, rel=1e-8)
    assert found["p_value"] == pytest.approx(4.46396e-36, rel=1e-5)
    assert [found["ci_low"], found["ci_high"]] == pytest.approx([26.722820431905753, 35.67874461734191], abs=4e-8)
    assert found["cohen_d"] == pytest.approx(1.1013227487052222, rel=1e-8)
    z = inference.two_sample_test(outcomes, "Glucose", "Outcome", 1, 0, "z").first()
    assert z["p_value"] == pytest.approx(1.13267e-42, rel=1e-5)


def test_binomial(spark):
    trials = spark.range(100).selectExpr("id < 60 AS hit")
    p = {a: inference.binomial_test(trials, "hit", 0.5, a).first() for a in d.ALTERNATIVES}
    assert p["two-sided"]["p_value"] == pytest.approx(0.05688793364098078, rel=1e-10)
    assert p["greater"]["p_value"] == pytest.approx(0.02844396682049044, rel=1e-10)
    assert p["less"]["p_value"] == pytest.approx(0.9823998998911476, rel=1e-10)
    assert [p["two-sided"]["ci_low"], p["two-sided"]["ci_high"]] == pytest.approx(
        [0.5020025867910618, 0.6905987135675411], rel=1e-12
    )
    assert p["greater"]["ci_high"] == 1.0 and p["less"]["ci_low"] == 0.0
    with pytest.raises(ValueError):
        inference.binomial_test(trials, "hit", 1.0)


def exact_binomial(k, n, p):
    pmf = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
    return min(1.0, sum(q for q in pmf if q <= pmf[k] * (1 + 1e-7)))


@pytest.mark.parametrize("n, p", [(1, 0.5), (7, 0.3), (20, 0.5), (33, 0.9), (50, 0.02)])
def test_binomial_by_summing(n, p):
    for k in range(n + 1):
        assert d.binomial_p(k, n, p, "two-sided") == pytest.approx(exact_binomial(k, n, p), abs=1e-12), k


def simpson(f, a, b, n=20000):
    x = np.linspace(a, b, n + 1)
    y = f(x)
    return (b - a) / (3 * n) * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())


@pytest.mark.parametrize("df", [1.0, 2.5, 9.0, 100.0, 463.58, 1e4, 1e7])
def test_student_tail_by_integration(df):
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    density = lambda x: scale * (1 + x * x / df) ** (-(df + 1) / 2)
    for t in (0.0, 0.3, 1.0, 2.2, 4.5):
        upper = float(d.student_upper(np.array([t]), np.array([df]))[0])
        assert upper == pytest.approx(0.5 - simpson(density, 0.0, t), abs=2e-9)
        assert float(d.student_upper(np.array([-t]), np.array([df]))[0]) == pytest.approx(1 - upper)
    q = d.student_quantile(0.975, np.array([df]))
    assert float(d.student_upper(q, np.array([df]))[0]) == pytest.approx(0.025, rel=1e-9)


def test_quantiles_at_known_points():
    assert float(d.student_quantile(0.975, np.array([1.0]))[0]) == pytest.approx(12.706204736432095, rel=1e-10)
    assert float(d.student_quantile(0.975, np.array([1e9]))[0]) == pytest.approx(d.normal_quantile(0.975), rel=1e-8)
    assert d.normal_upper(np.array([30.0]))[0] == pytest.approx(4.906713927148187e-198, rel=1e-10)


def test_groups_at_once_and_degenerate_groups(spark):
    df = spark.createDataFrame(
        [("a", v) for v in [1.0, 2.0, 4.0]] + [("one", 3.0), ("none", None), ("flat", 5.0), ("flat", 5.0)],
        "k string, v double",
    )
    found = by(inference.one_sample_test(df, "v", "t", 0.0, by=["k"]), "k")
    single = inference.one_sample_test(df.filter("k = 'a'"), "v").first()
    assert found["a"]["p_value"] == single["p_value"]
    assert all(found[k]["p_value"] is None for k in ("one", "none", "flat"))
    absent = inference.two_sample_test(df, "v", "k", "a", "absent").first()
    assert absent["n_b"] == 0 and absent["p_value"] is None


def test_bad_arguments(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    for bad in ({"test": "f"}, {"alternative": "more"}, {"alpha": 1.5}):
        with pytest.raises(ValueError):
            inference.one_sample_test(df, "v", **bad)
    with pytest.raises(TypeError):
        inference.one_sample_test(df, "k")
    with pytest.raises(ValueError):
        inference.sample_means(df, "v", 0)
    with pytest.raises(ValueError):
        inference.sample_means(df.filter("false"), "v")


def test_sampling_is_seeded_and_unbiased(spark, sliced):
    df = spark.range(1000).selectExpr("CAST(id % 50 AS DOUBLE) AS v")
    first = inference.sampling_distribution(df, "v", 25, 400, seed=1).first()
    again = inference.sampling_distribution(df.repartition(3), "v", 25, 400, seed=1).first()
    other = inference.sampling_distribution(df, "v", 25, 400, seed=2).first()
    assert first["mean_of_means"] == pytest.approx(again["mean_of_means"], rel=1e-12)
    assert first["mean_of_means"] != other["mean_of_means"]
    assert abs(first["mean_of_means"] - 24.5) < 4 * first["theoretical_se"] / 20
    assert first["std_of_means"] == pytest.approx(first["theoretical_se"], rel=0.15)


def test_several_metrics_at_once(spark):
    """The same rows as one call for each metric, and an adjusted p-value."""
    df = spark.range(300).selectExpr(
        "id % 7 + IF(id % 2 = 0, 0.9, 0) AS a", "CAST(id % 11 AS DOUBLE) AS `b c`", "IF(id < 0, id, NULL) AS none",
        "IF(id % 2 = 0, 'x', 'y') AS arm", "id % 3 AS k",
    )
    found = {(r["metric"], r["k"]): r for r in inference.two_sample_tests(df, ["a", "b c", "none"], "arm", "x", "y", by=["k"]).collect()}
    assert len(found) == 9
    for name in ("a", "b c", "none"):
        for r in inference.two_sample_test(df, name, "arm", "x", "y", by=["k"]).collect():
            own = found[name, r["k"]]
            assert own["p_value"] == (None if r["p_value"] is None else pytest.approx(r["p_value"])) and own["n_a"] == r["n_a"]
            assert own["p_adjusted"] == (None if r["p_value"] is None else pytest.approx(min(1, 6 * r["p_value"])))
    one = {r["metric"]: r for r in inference.one_sample_tests(df, ["a", "b c"], mu=3.0).collect()}
    assert one["a"]["statistic"] == pytest.approx(inference.one_sample_test(df, "a", mu=3.0).first()["statistic"])
    with pytest.raises(ValueError, match="rename"):
        inference.one_sample_tests(df.withColumnRenamed("k", "value"), ["a"], by=["value"])
    with pytest.raises(ValueError):
        inference.one_sample_tests(df, [])
