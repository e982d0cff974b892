import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.operators import profiling as P

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def column(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


SERIES = {
    "plain": np.random.default_rng(1).normal(size=997),
    "third_equal": np.concatenate([np.full(400, 3.25), np.random.default_rng(2).normal(size=800)]),
    "wide": np.random.default_rng(3).lognormal(0, 8, size=500),
    "one": np.array([4.0]),
    "equal": np.full(50, -2.0),
    "two": np.array([1.0, 2.0]),
    "huge": np.array([-1.7e308, 0.0, 1.0, 2.0, 1.7e308]),
}


@pytest.mark.parametrize("name", SERIES)
@pytest.mark.parametrize("keep", [2, 10_000])
def test_quantiles_match_linear_interpolation(spark, name, keep):
    df = column(spark, [*SERIES[name], None, float("nan")])
    got = P.exact_quantiles(df, "x", PROBS, keep, accuracy=1000)
    with np.errstate(over="ignore"):
        expected = np.quantile(SERIES[name], PROBS)
    if name != "huge":
        assert got == pytest.approx(list(expected), rel=1e-12)
    else:
        assert got[3] == 1.0


def test_quantiles_of_nothing(spark):
    assert P.exact_quantiles(column(spark, [None]), "x", (0.5,)) == [None]


@pytest.mark.parametrize("keep", [2, 10_000])
def test_describe(spark, keep):
    x = SERIES["third_equal"]
    row = P.describe(column(spark, [*x, None, float("nan")]), "x", keep).first()
    q = np.quantile(x, (0.25, 0.5, 0.75))
    assert row["count"] == len(x)
    assert (row["mean"], row["std"]) == pytest.approx((x.mean(), x.std(ddof=1)))
    assert (row["p25"], row["p50"], row["p75"]) == pytest.approx(tuple(q))
    assert (row["min"], row["max"]) == (x.min(), x.max())


@pytest.mark.parametrize(
    "x",
    [
        np.arange(0, 31) / 10.0,
        np.random.default_rng(5).integers(0, 50, 500) * 0.1,
        np.full(9, 2.0),
        np.log1p(np.arange(1, 200)),
    ],
)
@pytest.mark.parametrize("bins", [3, 30, 40])
def test_histogram_matches_numpy(spark, x, bins):
    rows = P.histogram(column(spark, [*x, None]), F.col("x"), bins).orderBy("bin").collect()
    counts, edges = np.histogram(x, bins=bins)
    assert [r["n"] for r in rows] == list(counts)
    assert [r["low"] for r in rows] == pytest.approx(list(edges[:-1]))
    assert [r["high"] for r in rows] == pytest.approx(list(edges[1:]))


def test_histogram_by_group_shares_edges(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 1.0), (1, 10.0), (1, None)], "g int, x double")
    rows = P.histogram(df, F.col("x"), 10, by=["g"]).orderBy("g", "bin").collect()
    assert [(r["g"], r["bin"], r["n"]) for r in rows] == [(0, 0, 1), (0, 1, 1), (1, 9, 1)]


def test_null_profile_and_counts(spark):
    df = spark.createDataFrame(
        [("a", None, "x"), ("a", None, None), (None, None, "x"), ("b", "q", "x")],
        "p string, q string, r string",
    )
    rows = [tuple(r) for r in P.null_profile(df).collect()]
    assert rows == [("q", 3), ("p", 1), ("r", 1)]
    assert [tuple(r) for r in P.value_counts(df, "p").collect()] == [("a", 2), ("b", 1)]
    shares = {r["value"]: (r["display"], r["n"], r["share"]) for r in P.value_shares(df, "p", 1).collect()}
    assert shares == {"a": ("a", 2, 2 / 3), "b": ("b", 1, 1 / 3)}
    assert tuple(P.scan_profile(df, ["p"]).first()) == (4, 3, 2)


def test_value_shares_has_no_window(spark):
    df = spark.createDataFrame([("a",)], "p string")
    plan = P.value_shares(df, "p")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan


def test_flag_totals(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None)], "a double, b double")
    got = {r["name"]: r["total"] for r in P.flag_totals(df, {"a": "A", "b": "B"}).collect()}
    assert got == {"A": 2, "B": 0}


def test_heavy_tails_need_few_passes(spark):
    x = np.exp(np.random.default_rng(4).uniform(-600, 600, 60_000))
    df = column(spark, x)
    df.persist().count()
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("passes", "quantiles")
    try:
        got = P.exact_quantiles(df, "x", (0.25, 0.5, 0.75), keep=500)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        df.unpersist()
    assert got == pytest.approx(list(np.quantile(x, (0.25, 0.5, 0.75))), rel=1e-12)
    # A pass is one or two jobs (adaptive execution runs the shuffle of a pass by itself).
    assert len(jobs.getJobIdsForGroup("passes")) <= 2 * 4 + 2


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, None), (3.0, "c")], "x double, t string")
    assert {r["column_name"]: r["n_missing"] for r in P.null_profile(df).collect()} == {"x": 2, "t": 1}
    rows = P.histogram(df, F.col("x"), 2).orderBy("bin").collect()
    assert [(r["low"], r["high"], r["n"]) for r in rows] == [(1.0, 2.0, 1), (2.0, 3.0, 1)]
    assert tuple(P.scan_profile(df, ["t"], approximate=True).first()) == (4, 2, 3)
