"""Rows whose id or feature is missing or repeated go through every step."""

import pytest
from pyspark.sql import functions as F

from gradus import schema as S
from gradus.functions.cleaning import nan_as_null
from gradus.operators import knn as K
from gradus.operators import levels as L
from gradus.operators.models import KnnModel
from gradus.plans.pipeline import missing_counts, treat_missing

FEATURES = ["a", "b"]
SCHEMA = "id string, row_key bigint, a double, b double, label int"


def rows(n=90):
    own = [None, "same", "same", *[f"p{i}" for i in range(n)]]
    return [(own[i] if i % 4 else None, i, float(i % 7), float(i % 5), i % 3) for i in range(n)]


@pytest.mark.parametrize("route", [{}, dict(broadcast_bytes=0, pivots=4, block_rows=20)])
def test_every_row_is_scored(spark, route):
    train = spark.createDataFrame([(f"t{i}", i, float(i % 9), float(i % 4), i % 3) for i in range(120)], SCHEMA)
    test = spark.createDataFrame([*rows(), ("x", 900, None, 1.0, 0), ("y", 901, float("nan"), 1.0, 0)], SCHEMA)
    model = KnnModel.fit(train, "row_key", FEATURES, k=5)
    got = model.score(test, **route).orderBy("row_key").collect()
    assert [r["row_key"] for r in got] == [*range(90), 900, 901]
    assert all((r["prediction"] is None) == (r["row_key"] >= 900) for r in got)
    again = model.score(test).orderBy("row_key").collect()
    assert [(r["prediction"], r["probabilities"]) for r in got] == [(r["prediction"], r["probabilities"]) for r in again]


def test_both_neighbour_routes_keep_repeated_ids(spark):
    test = spark.createDataFrame([(1, [0.0]), (1, [9.0]), (None, [5.0])], "id bigint, vec array<double>")
    train = spark.createDataFrame([(i, [float(i)], 0) for i in range(12)], "id bigint, vec array<double>, label int")
    here = K.knn_join(test, train, "vec", "id", "id", k=3)
    there = K.knn_join(test, train, "vec", "id", "id", k=3, broadcast_bytes=0, pivots=3, block_rows=4)
    assert here.count() == there.count() == 9
    assert sorted(map(str, here.collect())) == sorted(map(str, there.select(here.columns).collect()))
    holed = test.withColumn("vec", F.array(F.lit(None).cast("double")))
    with pytest.raises(Exception, match="a feature is missing"):
        K.knn_join(holed, train, "vec", "id", "id", k=3).collect()


def test_missing_values_have_one_policy(spark):
    points = spark.createDataFrame([(1.0, 2), (None, 3), (float("nan"), None), (3.0, 4)], "a double, b int")
    assert tuple(missing_counts(points, FEATURES).first()) == (4, 2, 2, 1)
    assert treat_missing(points, "drop", FEATURES).count() == 2
    filled = treat_missing(points, "fill", FEATURES)
    assert sorted(map(tuple, filled.collect())) == [(1.0, 2), (2.0, 3), (2.0, 3), (3.0, 4)]
    assert filled.dtypes == points.dtypes
    with pytest.raises(ValueError, match="2 of 4"):
        treat_missing(points, "error", FEATURES)
    with pytest.raises(ValueError, match="policy"):
        treat_missing(points, "guess", FEATURES)


def test_label_join_is_the_same_on_both_routes(spark):
    names = ["a", "b", "long " * 1000, None]
    points = spark.createDataFrame([(i, names[i % 4], float(i)) for i in range(40)], "id int, g string, x double")
    groups = spark.createDataFrame(
        [(g, 10, i % 3) for i, g in enumerate(names[:3])], f"g string, {L.SIZE} bigint, {S.TARGET} int"
    )
    for how in ("inner", "left"):
        here = L.join_labels(points, groups, "g", how=how)
        there = L.join_labels(points, groups, "g", how=how, broadcast_limit=0, hot_share=3)
        assert here.columns == there.columns == ["id", "g", "x", S.TARGET]
        assert sorted(map(str, here.collect())) == sorted(map(str, there.collect()))


def test_nan_is_null(spark):
    row = spark.createDataFrame([(float("nan"), 1.0, "x")], "a double, b double, c string")
    got = row.select(*[nan_as_null(F.col(c), t).alias(c) for c, t in row.dtypes]).first()
    assert tuple(got) == (None, 1.0, "x")
