import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradus import schema as S
from gradus.operators import splitting as X


def frame(spark, counts, shuffle_seed=0):
    rows = [c for c, n in counts.items() for _ in range(n)]
    np.random.default_rng(shuffle_seed).shuffle(rows)
    return spark.createDataFrame([(f"id{i}", int(c)) for i, c in enumerate(rows)], "id string, label int")


def test_golden_quotas():
    assert X.split_quotas({0: 495, 1: 2643, 2: 2549}) == {0: 99, 1: 529, 2: 510}
    assert X.split_quotas({0: 13, 1: 70, 2: 67}) == {0: 3, 1: 14, 2: 13}
    assert X.split_quotas({0: 10**12 + 1, 1: 3}) == {0: 200000000000, 1: 1}


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 9), st.integers(1, 10**6), min_size=1, max_size=6))
def test_quota_properties(counts):
    quotas = X.split_quotas(counts)
    n = sum(counts.values())
    n_test = math.ceil(0.2 * n)
    assert sum(quotas.values()) == n_test
    for c, q in quotas.items():
        assert abs(q - counts[c] * n_test / n) < 1


@pytest.mark.parametrize("bucket_rows", [100_000, 20, 1])
def test_sizes_and_sides(spark, bucket_rows):
    df = frame(spark, {0: 13, 1: 70, 2: 67})
    split = X.fit_split(df, "id", bucket_rows=bucket_rows).apply(df)
    got = {(r["label"], r["split"]): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert got == {(0, "test"): 3, (0, "train"): 10, (1, "test"): 14, (1, "train"): 56, (2, "test"): 13, (2, "train"): 54}
    assert tuple(X.split_overlap(split, ["id"]).first()) == (0, 0)


def test_every_route_gives_the_same_split(spark):
    df = frame(spark, {0: 300, 1: 30, 2: 500})
    sides = [
        {r["id"] for r in X.fit_split(df, "id", bucket_rows=b).apply(df).filter("split = 'test'").collect()}
        for b in (100_000, 50, 3)
    ]
    assert sides[0] == sides[1] == sides[2] and len(sides[0]) == 166


def test_repeatable_and_seeded(spark):
    df = frame(spark, {0: 40, 1: 60})
    again = frame(spark, {0: 40, 1: 60}).repartition(7)
    pick = lambda d, seed: {r["id"] for r in X.fit_split(d, "id", seed=seed).apply(d).filter("split = 'test'").collect()}
    assert pick(df, 42) == pick(again, 42)
    assert pick(df, 42) != pick(df, 43)


def test_applying_is_narrow(spark):
    df = frame(spark, {0: 40, 1: 60})
    plan = X.fit_split(df, "id").apply(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_null_labels_and_nothing(spark):
    df = spark.createDataFrame([("a", None)], "id string, label int")
    assert X.fit_split(df, "id").apply(df).first()["split"] == "train"


def test_balanced_weights(spark):
    df = frame(spark, {0: 1, 1: 3, 2: 4})
    weights = {r["label"]: r["weight"] for r in X.class_weights(df).collect()}
    assert weights == pytest.approx({0: 8 / 3, 1: 8 / 9, 2: 8 / 12})
    rows = X.with_class_weight(df)
    assert rows.count() == 8
    assert rows.agg(F.sum("weight")).first()[0] == pytest.approx(8)


def test_labels_outside_the_classes_raise(spark):
    df = frame(spark, {0: 1, 7: 5})
    with pytest.raises(Exception, match="label not in the classes: 7"):
        X.with_class_weight(df).collect()
    assert X.with_class_weight(df, classes=(0, 7)).count() == 6


@pytest.mark.parametrize("ids", ["missing", "repeated", "mixed"])
def test_rows_without_an_own_id_are_split_by_their_key(spark, ids):
    def own(i):
        return {"missing": None, "repeated": f"p{i % 3}", "mixed": None if i % 2 else f"p{i}"}[ids]

    rows = [(own(i), i, i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "id string, row_key bigint, label int")
    split = X.fit_split(df, "id", bucket_rows=10, row_key="row_key").apply(df)
    assert split.filter("split = 'test'").groupBy("label").count().orderBy("label").collect() == [
        (0, 10), (1, 10), (2, 10)
    ]
    assert split.count() == 150
    if ids != "repeated":
        with pytest.raises(ValueError, match="row key"):
            X.fit_split(df, "id")
    else:
        with pytest.raises(ValueError, match="row key"):
            X.fit_split(df.filter("label = 0 or row_key < 6"), "id")


def test_weight_of_absent_class(spark):
    weights = {r["label"]: r["weight"] for r in X.class_weights(frame(spark, {1: 2, 2: 6}), classes=S.LEVELS).collect()}
    assert weights == pytest.approx({1: 2.0, 2: 8 / 12})
