import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.operators import models as M

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        label = int(rng.choice(3, p=[0.15, 0.4, 0.45]))
        a = round(float(rng.normal(label * 2.0, 1.0)), 1)
        rows.append((f"p{i}", a, float(rng.integers(0, 2)), 5.0, label))
    df = spark.createDataFrame(rows, "id string, a double, b double, c double, label int").persist()
    yield df
    df.unpersist()


def accuracy(scored):
    return scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]


def newton_softmax(x, y, w, ridge, steps=60):
    """Weighted multinomial regression, summed loss, penalty on the slopes only."""
    n, d = x.shape
    x1 = np.hstack([x, np.ones((n, 1))])
    theta = np.zeros((3, d + 1))
    target = np.eye(3)[y]
    penalty = np.diag([ridge] * d + [1e-9])
    for _ in range(steps):
        z = x1 @ theta.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = ((p - target) * w[:, None]).T @ x1 + theta @ penalty
        hess = np.zeros((3 * (d + 1), 3 * (d + 1)))
        for i in range(3):
            for j in range(3):
                q = w * p[:, i] * ((i == j) - p[:, j])
                block = (x1 * q[:, None]).T @ x1 + (penalty if i == j else 0)
                hess[i * (d + 1):(i + 1) * (d + 1), j * (d + 1):(j + 1) * (d + 1)] = block
        theta -= np.linalg.lstsq(hess, grad.ravel(), rcond=None)[0].reshape(theta.shape)
    z = x1 @ theta.T
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def test_logistic_matches_summed_loss(spark, points):
    scored = M.fit_logistic(points, FEATURES).score(points).orderBy("id").collect()
    x = np.array([[r["a"], r["b"], r["c"]] for r in scored])
    sd = x.std(axis=0)
    x = (x - x.mean(axis=0)) / np.where(sd == 0, 1, sd)
    y = np.array([r["label"] for r in scored])
    w = (len(y) / (3 * np.bincount(y)))[y]
    expected = newton_softmax(x, y, w, 1.0)
    got = np.array([r["probabilities"] for r in scored])
    assert np.abs(got - expected).max() < 1e-8
    assert [r["prediction"] for r in scored] == list(got.argmax(axis=1))


def test_gradient_at_the_coefficients_is_zero_in_sql(spark, points, tmp_path):
    model = M.fit_logistic(points, FEATURES)
    model.save(str(tmp_path / "lr"))
    points.write.parquet(str(tmp_path / "points"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW points AS SELECT * FROM '{tmp_path}/points/*.parquet'")
    db.execute(f"CREATE VIEW coefficients AS SELECT * FROM '{tmp_path}/lr/coefficients/*.parquet'")
    gradient = db.execute("""
        WITH long AS (UNPIVOT (SELECT id, label, a, b, c, 1.0::DOUBLE AS "(intercept)" FROM points)
                      ON a, b, c, "(intercept)" INTO NAME feature VALUE v),
        z AS (SELECT id, label, feature, class, coefficient, (v - mean) / deviation AS x FROM long JOIN coefficients USING (feature)),
        logit AS (SELECT id, label, class, sum(coefficient * x) AS s FROM z GROUP BY ALL),
        share AS (SELECT *, exp(s) / sum(exp(s)) OVER (PARTITION BY id) AS p FROM logit),
        w AS (SELECT label, sum(count(*)) OVER ()::DOUBLE / (count(*) OVER () * count(*)) AS w FROM points GROUP BY label)
        SELECT class, feature, sum(w * (p - (share.label = class)::INT) * x)
          + any_value(CASE WHEN feature = '(intercept)' THEN 0 ELSE coefficient END) AS g
        FROM share JOIN w USING (label) JOIN z USING (id, class) GROUP BY ALL""").fetchall()
    assert len(gradient) == 12 and max(abs(g) for *_, g in gradient) < 1e-6


def test_logistic_odd_tables(spark, points):
    two = M.fit_logistic(points.filter("label != 1"), FEATURES)
    assert all(r.probabilities[1] == 0 and abs(sum(r.probabilities) - 1) < 1e-12 for r in two.score(points).collect())
    one = M.fit_logistic(points.filter("label = 2"), FEATURES)
    assert one.score(points).filter("prediction != 2").count() == 0
    # Large values far from 0, and a feature that tells the classes apart.
    far = points.withColumns({"a": F.col("a") * 1e-3 + 1e6, "b": F.col("label") * 1e9})
    scored = M.fit_logistic(far, FEATURES).score(far)
    assert accuracy(scored) > 0.99
    with pytest.raises(ValueError, match="no training rows"):
        M.fit_logistic(points.limit(0), FEATURES)


def test_all_models_beat_the_majority(spark, points):
    majority = 0.47
    for model in (M.fit_logistic(points, FEATURES), M.BoostedModel.fit(points, FEATURES, rounds=5, depth=3)):
        scored = model.score(points)
        assert scored.columns == [*points.columns, "probabilities", "prediction"]
        assert accuracy(scored) > majority + 0.1
        sums = scored.agg(F.max(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda s, v: s + v) - 1))).first()[0]
        assert sums < 1e-9
    knn = M.KnnModel.fit(points, "id", FEATURES)
    assert accuracy(knn.score(points)) > majority + 0.1


def test_same_seed_same_boosted_predictions(spark, points):
    runs = [
        M.BoostedModel.fit(points.repartition(n), FEATURES, rounds=3, depth=2).score(points).orderBy("id").collect()
        for n in (1, 1)
    ]
    assert [r["probabilities"] for r in runs[0]] == [r["probabilities"] for r in runs[1]]


def test_importances(spark, points):
    ranked = M.BoostedModel.fit(points, FEATURES, rounds=3, depth=2).importances()
    assert ranked[0][0] == "a" and dict(ranked)["c"] == 0.0
    assert math.isclose(sum(v for _, v in ranked), 1.0, rel_tol=1e-6)


def test_save_and_load(spark, points, tmp_path):
    fitted = {
        "lr": M.fit_logistic(points, FEATURES),
        "gbt": M.BoostedModel.fit(points, FEATURES, rounds=2, depth=2),
        "knn": M.KnnModel.fit(points, "id", FEATURES),
    }
    for name, model in fitted.items():
        path = str(tmp_path / name)
        model.save(path)
        again = M.load_model(spark, path)
        rows = [
            M.score_with(m, points.limit(50)).orderBy("id").collect() for m in (model, again)
        ]
        assert len(rows[0]) == 50
        assert [r["probabilities"] for r in rows[0]] == [r["probabilities"] for r in rows[1]]


def test_load_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        M.load_model(spark, str(tmp_path / "missing"))
    other = tmp_path / "other"
    other.mkdir()
    (other / "model.bin").write_text("x")
    with pytest.raises(ValueError):
        M.load_model(spark, str(other))


def test_missing_values(spark, points):
    holed = points.withColumn("a", F.when(F.col("id") != "p0", F.col("a")))
    with pytest.raises(Exception):
        M.fit_logistic(holed, FEATURES)
    assert M.fit_logistic(holed, FEATURES, handle_invalid="skip").score(points.limit(5)).count() == 5
    assert M.BoostedModel.fit(holed, FEATURES, rounds=1, depth=1).score(holed).count() == 600


def test_registry(tmp_path):
    models = M.registry(str(tmp_path))
    assert list(models) == ["logistic_regression", "knn", "xgboost"]
    assert models["xgboost"].threshold == 0.63
    with pytest.raises(ValueError):
        M.check_registry({})
    with pytest.raises(ValueError):
        M.check_registry({"x": M.Registered("x", "", "", None)})
