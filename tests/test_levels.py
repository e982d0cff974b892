import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.operators import groups as G
from gradus.operators import levels as L


def sizes_frame(spark, sizes):
    return spark.createDataFrame(
        [(f"g{i}", int(s)) for i, s in enumerate(sizes)],
        "consolidated_commune string, nombre_pdc_commune bigint",
    )


def brute(sizes, k):
    """Least error over all ways to cut the sorted distinct sizes."""
    x = np.log1p(np.array(sizes, dtype=float))
    distinct = sorted(set(sizes))
    best = math.inf
    for cut in itertools.combinations(distinct[:-1], min(k, len(distinct)) - 1):
        level = np.searchsorted(np.array(cut), np.array(sizes), side="left")
        error = sum(((x[level == c] - x[level == c].mean()) ** 2).sum() for c in set(level))
        best = min(best, error)
    return best / (x.var() or 1.0)


@pytest.mark.parametrize("seed", range(4))
def test_exact_with_own_slices(spark, seed):
    sizes = np.random.default_rng(seed).geometric(0.15, 200)
    fits = L.fit_levels(sizes_frame(spark, sizes), (2, 3, 4))
    for k, fit in fits.items():
        assert fit.inertia == pytest.approx(brute(list(sizes), k))
        assert sum(fit.counts) == 200 and sum(fit.points) == sizes.sum()


@pytest.mark.parametrize("seed", range(6))
def test_exact_after_splitting_slices(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = np.unique(rng.integers(1, 10 ** rng.integers(2, 7), 40))
    sizes = np.concatenate([sizes, rng.choice(sizes, 60)])
    fits = L.fit_levels(
        sizes_frame(spark, sizes), (2, 3, 4), own_slice=2, per_doubling=1, split_budget=6
    )
    for k, fit in fits.items():
        assert fit.inertia == pytest.approx(brute(list(map(int, sizes)), k), rel=1e-9)


def test_large_sizes(spark):
    sizes = [1, 2, 3, 10**6, 10**6 + 1, 10**12, 10**12 + 7]
    fit = L.fit_levels(sizes_frame(spark, sizes))[3]
    assert fit.uppers == (3, 10**6 + 1)
    assert fit.counts == (3, 2, 2)


def test_fewer_sizes_than_levels(spark):
    fit = L.fit_levels(sizes_frame(spark, [5, 5, 9]), (3,))[3]
    assert fit.k == 2 and fit.uppers == (5,) and fit.inertia == pytest.approx(0.0, abs=1e-9)
    one = L.fit_levels(sizes_frame(spark, [4, 4]), (2, 3))[3]
    assert one.k == 1 and one.uppers == ()
    far = L.fit_levels(sizes_frame(spark, [100_000, 100_001]), (3,), own_slice=2, per_doubling=1)[3]
    assert far.k == 2 and far.uppers == (100_000,)


def test_no_groups(spark):
    with pytest.raises(ValueError):
        L.fit_levels(sizes_frame(spark, [1]).limit(0))


def test_null_group_is_not_a_group(spark):
    rows = [("a",)] * 3 + [("b",)] * 9 + [("c",)] * 30 + [(None,)] * 50
    points = spark.createDataFrame(rows, "consolidated_commune string")
    labelled = L.label_points(points)
    got = {tuple(r) for r in labelled.distinct().collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}
    assert labelled.count() == 42


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("limit", [0, 1000])
def test_join_with_hot_group(spark, how, limit):
    """A third of the points in one group and many without a group, on both routes."""
    rows = [("hot", i) for i in range(400)] + [(None, i) for i in range(300)]
    rows += [(f"g{i % 100}", i) for i in range(500)]
    points = spark.createDataFrame(rows, "consolidated_commune string, i int")
    sizes = G.group_sizes(points)
    groups = L.label_groups(sizes, L.fit_levels(sizes)[3])
    got = L.join_labels(points, groups, how=how, broadcast_limit=limit, hot_share=10)
    expected = points.join(groups.drop(L.SIZE), "consolidated_commune", how)
    columns = ["consolidated_commune", "i", "label"]
    order = [F.col(c).asc_nulls_first() for c in columns]
    assert got.columns == columns
    assert got.orderBy(*order).collect() == expected.select(*columns).orderBy(*order).collect()


def test_hot_points_are_spread(spark):
    points = spark.range(4000).select(
        F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("g"), F.col("id"))).alias("consolidated_commune"),
        "id",
    )
    sizes = G.group_sizes(points)
    groups = L.label_groups(sizes, L.fit_levels(sizes)[3])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = L.join_labels(points, groups, broadcast_limit=0, hot_share=100)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [join_key" in plan
        parts = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 1400


def test_numeric_group_column(spark):
    points = spark.range(100).select((F.col("id") % 7).alias("g"), "id")
    sizes = G.group_sizes(points, "g")
    groups = L.label_groups(sizes, L.fit_levels(sizes)[3])
    assert L.join_labels(points, groups, "g", broadcast_limit=0).count() == 100


def test_rank_clusters(spark):
    df = spark.createDataFrame([(7, 1.0), (7, 3.0), (3, 9.0), (5, 0.5)], "c int, v double")
    got = {(r["c"], r["label"]) for r in L.rank_clusters(df, "c", "v").collect()}
    assert got == {(5, 0), (7, 1), (3, 2)}


def test_library_kmeans_is_never_better(spark):
    sizes = np.random.default_rng(11).geometric(0.12, 400)
    frame = sizes_frame(spark, sizes)
    exact = L.fit_levels(frame)[3]
    labels, cost = L.kmeans_labels(frame, n_init=5)
    assert exact.inertia <= cost + 1e-6
    assert cost <= exact.inertia * 1.01
    means = [r[1] for r in labels.groupBy("label").agg(F.avg(L.SIZE)).orderBy("label").collect()]
    assert means == sorted(means) and len(means) == 3


def test_silhouette_matches_pairs(spark):
    sizes = np.concatenate([np.random.default_rng(4).geometric(0.2, 60), [500]])
    frame = sizes_frame(spark, sizes)
    fits = L.fit_levels(frame, (2, 3, 5))
    got = {r["k"]: r["silhouette"] for r in L.silhouette(frame, (2, 3, 5)).collect()}
    x = np.log1p(sizes.astype(float))
    for k, fit in fits.items():
        level = np.searchsorted(np.array(fit.uppers), sizes, side="left")
        scores = []
        for i in range(len(x)):
            own = level == level[i]
            if own.sum() == 1:
                scores.append(0.0)
                continue
            a = np.abs(x[own] - x[i]).sum() / (own.sum() - 1)
            b = min(np.abs(x[level == c] - x[i]).mean() for c in set(level) - {level[i]})
            scores.append((b - a) / max(a, b) if max(a, b) else 0.0)
        assert got[k] == pytest.approx(np.mean(scores))


def test_elbow_falls(spark):
    frame = sizes_frame(spark, np.random.default_rng(9).geometric(0.1, 300))
    values = [r["inertia"] for r in L.elbow(frame).orderBy("k").collect()]
    assert len(values) == 7 and values == sorted(values, reverse=True)


def test_standardize(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = L.standardize(df, ["a", "b"]).orderBy("a").collect()
    assert [(r["a_z"], r["b_z"]) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]


def test_group_operators(spark):
    df = spark.createDataFrame(
        [("a", "1", 1.0, 2.0, 0, 10.0), ("a", None, 3.0, None, 0, 20.0), ("b", "2", 5.0, 6.0, 2, None), (None, "3", 9.0, 9.0, 1, 3.0)],
        "consolidated_commune string, id_pdc_itinerance string, latitude double, longitude double, label int, puissance_nominale double",
    )
    assert {tuple(r) for r in G.group_sizes(df).collect()} == {("a", 2), ("b", 1)}
    assert {tuple(r) for r in G.group_profile(df).collect()} == {("a", 1, 2.0, 2.0), ("b", 1, 5.0, 6.0)}
    assert [tuple(r) for r in G.group_centroids(df).collect()] == [("a", 2.0, 2.0), ("b", 5.0, 6.0)]
    assert [tuple(r) for r in G.centroid_of(df, "b").collect()] == [("b", 5.0, 6.0)]
    assert {tuple(r) for r in G.class_stats(df).collect()} == {(0, 1, 2.0, 2), (2, 1, 1.0, 1)}
    assert {tuple(r) for r in G.map_bubbles(df, F.col("label")).collect()} == {("a", 2.0, 2.0, 2, 0), ("b", 5.0, 6.0, 1, 2)}
    assert tuple(G.kpis(df).first()) == (4, 2, 11.0, None)
