import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.functions import decisions as D
from gradus.operators import thresholds as T

GRID = np.arange(0.05, 0.95, 0.01)


def frame(spark, p, y):
    rows = [([float(v) for v in a], int(b)) for a, b in zip(p, y)]
    return spark.createDataFrame(rows, "probabilities array<double>, y int")


def plain(p, y, t):
    """Scores of the rule, row by row: class 0 from the threshold on, else the likelier other class."""
    hits = called = support = right = 0
    for (first, second, third), truth in zip(p, y):
        if first >= t:
            choice = 0
        elif second >= third:
            choice = 1
        else:
            choice = 2
        called += choice == 0
        support += truth == 0
        hits += choice == 0 == truth
        right += choice == truth
    precision = hits / called if called else 0.0
    recall = hits / support if support else 0.0
    both = called + support
    return precision, recall, 2 * hits / both if both else 0.0, right / len(y)


def sample(n=400, seed=0):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([1, 1, 1], n)
    return p, rng.integers(0, 3, n)


def test_grid_is_the_floating_point_range(spark):
    df = spark.range(90).select(T.grid_value(F.col("id")).alias("t")).orderBy("t")
    assert [r["t"] for r in df.collect()] == list(GRID)


def test_reached_counts_grid_values(spark):
    rng = np.random.default_rng(1)
    p0 = [0.0, 1.0, 0.63, 0.05, 0.94, *GRID, *np.nextafter(GRID, 0), *np.nextafter(GRID, 1), *rng.random(500)]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p0)], "i int, p double")
    got = [r[0] for r in df.orderBy("i").select(T.reached(F.col("p"))).collect()]
    assert got == [int((GRID <= v).sum()) for v in p0]


@pytest.mark.parametrize("seed", range(3))
def test_sweep_matches_ninety_passes(spark, seed):
    p, y = sample(seed=seed)
    p[:90, 0] = GRID  # exactly on the grid
    rows = T.threshold_sweep(frame(spark, p, y)).orderBy("seuil").collect()
    assert [r["seuil"] for r in rows] == [round(float(t), 3) for t in GRID]
    for r, t in zip(rows, GRID):
        assert tuple(r)[1:] == pytest.approx(plain(p, y, t))


def test_sweep_without_class_zero_or_rows(spark):
    p, y = sample(20)
    rows = T.threshold_sweep(frame(spark, p, np.full(20, 1))).collect()
    assert len(rows) == 90 and all(r["rappel"] == 0 and r["f1"] == 0 for r in rows)
    assert T.threshold_sweep(frame(spark, p, y).limit(0)).agg(F.sum("accuracy")).first()[0] == 0


def test_sweep_by_key_reads_once(spark):
    p, y = sample(60)
    df = frame(spark, p, y).withColumn("k", F.when(F.rand(3) < 0.5, "a").otherwise("b")).persist()
    both = T.threshold_sweep(df, by=["k"])
    for key in ("a", "b"):
        alone = T.threshold_sweep(df.filter(F.col("k") == key)).orderBy("seuil").collect()
        assert [tuple(r)[1:] for r in both.filter(F.col("k") == key).orderBy("seuil").collect()] == [tuple(r) for r in alone]
    plan = T.threshold_sweep(df.drop("k"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") <= 1 or plan.count("Scan ExistingRDD") <= 1
    df.unpersist()


def test_picks(spark):
    p, y = sample(500, 7)
    df = frame(spark, p, y)
    sweep = T.threshold_sweep(df).persist()
    table = [plain(p, y, t) for t in GRID]
    best = int(np.argmax([r[2] for r in table]))
    assert T.best_f1_threshold(sweep).first()["seuil"] == round(float(GRID[best]), 3)
    able = [i for i, r in enumerate(table) if r[1] >= 0.8]
    top = max(able, key=lambda i: (table[i][0], -i))
    assert T.best_recall_threshold(sweep).first()["seuil"] == round(float(GRID[top]), 3)
    assert T.best_recall_threshold(sweep, 1.01).count() == 0
    assert T.nearest_threshold(sweep, 0.333).first()["seuil"] == 0.33
    assert T.pr_curve(sweep).count() == 90
    summary = {r["rule"]: r for r in T.threshold_summary(df).collect()}
    assert set(summary) == {"baseline", "max_f1", "min_recall"}
    decided = p.argmax(axis=1)
    assert summary["baseline"]["accuracy"] == pytest.approx((decided == y).mean())
    assert summary["baseline"]["seuil"] is None
    assert {r["rule"] for r in T.threshold_summary(df, recall=1.01).collect()} == {"baseline", "max_f1"}
    sweep.unpersist()


def test_decision_ties(spark):
    p = np.array([[0.2, 0.4, 0.4], [0.4, 0.4, 0.2], [0.63, 0.3, 0.07], [0.1, 0.2, 0.7], [0.62, 0.19, 0.19]])
    df = frame(spark, p, [0] * 5).withColumn("i", F.monotonically_increasing_id())
    col = F.col("probabilities")
    rows = df.select("i", D.argmax_class(col).alias("a"), D.threshold_class(col, 0.63).alias("t")).orderBy("i").collect()
    assert [r["a"] for r in rows] == [1, 0, 0, 2, 0]
    assert [r["t"] for r in rows] == [1, 1, 0, 2, 1]
