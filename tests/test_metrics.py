import random

import pytest
from pyspark.sql import functions as F

from gradus import schema as S
from gradus.operators import metrics as M


def pairs(spark, y, p):
    return spark.createDataFrame(list(zip(y, p)), "y int, p int")


def scores(spark, y, p):
    return M.classification_metrics(pairs(spark, y, p)).first().asDict()


def plain(y, p):
    """The five scores from their definitions."""
    labels = sorted(set(y) | set(p))
    out = []
    for c in labels:
        hits = sum(a == b == c for a, b in zip(y, p))
        called, support = p.count(c), y.count(c)
        precision = hits / called if called else 0.0
        recall = hits / support if support else 0.0
        out.append((precision, recall, 2 * hits / (called + support), support))
    n = len(labels)
    return {
        "accuracy": sum(a == b for a, b in zip(y, p)) / len(y),
        "f1_weighted": sum(r[2] * r[3] for r in out) / len(y),
        "f1_macro": sum(r[2] for r in out) / n,
        "precision_macro": sum(r[0] for r in out) / n,
        "recall_macro": sum(r[1] for r in out) / n,
    }


def drawn(n, truth, called, seed):
    """Labels drawn from two lists of classes, the second often taking the first's value."""
    draw = random.Random(seed)
    y = [draw.choice(truth) for _ in range(n)]
    return y, [v if draw.random() < 0.5 and v in called else draw.choice(called) for v in y]


MIXED = drawn(40, [0, 1, 2], [0, 1, 2], 1)
#: A class that is never called, one that is only called, one class alone, a class with a row in fifty.
CASES = [
    MIXED,
    drawn(30, [0, 1, 2], [0, 2], 2),
    drawn(30, [1, 2], [0, 1, 2], 3),
    drawn(12, [2], [2], 4),
    drawn(12, [1], [0], 5),
    drawn(100, [0] * 49 + [1], [0, 1], 6),
]


@pytest.mark.parametrize("y,p", CASES)
def test_against_definitions(spark, y, p):
    got = scores(spark, y, p)
    assert list(got) == S.METRICS
    assert all(isinstance(v, float) and 0 <= v <= 1 for v in got.values())
    assert got == pytest.approx(plain(y, p))


def test_confusion_matrix(spark):
    rows = M.confusion_matrix(pairs(spark, [0, 0, 1, 2], [0, 1, 1, 0])).orderBy("truth").collect()
    assert [tuple(r) for r in rows] == [(0, 1, 1, 0, 0), (1, 0, 1, 0, 0), (2, 1, 0, 0, 0)]


def test_confusion_matrix_is_square_and_loses_nothing(spark):
    rows = spark.createDataFrame(
        [("a", 0, 2), ("a", 0, 7), ("a", 9, 0), ("b", 1, 1), ("b", None, None)], "m string, y int, p int"
    )
    got = M.confusion_matrix(rows, by=["m"]).collect()
    assert {tuple(r) for r in got} == {
        ("a", 0, 0, 0, 1, 1), ("a", 1, 0, 0, 0, 0), ("a", 2, 0, 0, 0, 0), ("a", None, 1, 0, 0, 0),
        ("b", 0, 0, 0, 0, 0), ("b", 1, 0, 1, 0, 0), ("b", 2, 0, 0, 0, 0), ("b", None, 0, 0, 0, 1),
    }


def test_unknown_labels_raise(spark):
    rows = spark.createDataFrame([(0,), (3,)], "label int")
    with pytest.raises(Exception, match="label not in the classes: 3"):
        M.label_shares(rows).collect()
    assert M.label_shares(rows, labels=(0, 3)).count() == 2


def test_checks_count_nan(spark):
    rows = spark.createDataFrame([(0, float("nan")), (1, None), (2, 1.0)], "label int, x double")
    got = {r.check_name: r.n_bad for r in M.quality_checks(rows, features=["x"]).collect()}
    assert got["null_x"] == 2


def test_full_report(spark):
    y, p = MIXED
    rows = {r["row"]: r for r in M.full_report(pairs(spark, y, p)).collect()}
    assert set(rows) == {"0", "1", "2", "accuracy", "macro avg", "weighted avg"}
    expected = plain(y, p)
    assert rows["macro avg"]["f1"] == pytest.approx(expected["f1_macro"])
    assert rows["weighted avg"]["f1"] == pytest.approx(expected["f1_weighted"])
    assert rows["accuracy"]["support"] == 40 and rows["1"]["support"] == y.count(1)


def test_evaluate_many_models_in_one_count(spark):
    frames = {k: pairs(spark, y, p) for k, (y, p) in {"a": MIXED, "b": CASES[4]}.items()}
    table = M.evaluate_models(M.stack_predictions(frames), {"a": ("A", "pa"), "b": ("B", "pb"), "c": ("C", "pc")})
    assert table.columns == S.METRICS_SCHEMA.fieldNames()
    rows = {r["model_key"]: r for r in table.collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"]["model_name"] == "A" and rows["b"]["model_path"] == "pb"
    assert {c: rows["a"][c] for c in S.METRICS} == pytest.approx(plain(*MIXED))
    long = M.metrics_long(table)
    assert long.count() == 10
    display = M.metrics_display(table)
    assert display.columns == ["Modèle", *S.METRICS]
    assert {r["accuracy"] for r in display.collect()} == {f"{plain(*MIXED)['accuracy']:.4f}", "0.0000"}


def test_no_models(spark):
    with pytest.raises(ValueError):
        M.stack_predictions({})
    with pytest.raises(ValueError):
        M.evaluate_models(pairs(spark, [0], [0]), {})


def test_best_model_skips_nan(spark):
    table = spark.createDataFrame(
        [("b", "B", "", 0.1, 0.5, 0.1, 0.1, 0.1), ("a", "A", "", 0.1, 0.5, 0.1, 0.1, 0.1),
         ("c", "C", "", 0.1, float("nan"), 0.1, 0.1, 0.1), ("d", "D", "", 0.1, None, 0.1, 0.1, 0.1)],
        S.METRICS_SCHEMA,
    )
    assert M.best_model(table).first()["model_key"] == "a"


def test_quality(spark):
    df = spark.createDataFrame([(0, 1.0), (5, None), (None, 2.0)], "label int, x double")
    checks = {r["check_name"]: (r["n_bad"], r["passed"]) for r in M.quality_checks(df, features=["x"]).collect()}
    assert checks == {"rows_missing": (0, True), "label_unknown": (2, False), "null_x": (1, False)}
    with pytest.raises(ValueError, match="label_unknown: 2"):
        M.require_quality(df, features=["x"])
    with pytest.raises(ValueError, match="rows_missing"):
        M.require_quality(df.limit(0), features=["x"])
    M.require_quality(df.filter(F.col("label") == 0), features=["x"])


def test_label_shares(spark):
    df = spark.createDataFrame([(0,), (1,), (1,)], "label int")
    got = {r["label"]: (r["n"], r["share"]) for r in M.label_shares(df).collect()}
    assert got == {0: (1, 1 / 3), 1: (2, 2 / 3)}
