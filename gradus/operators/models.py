"""Registered classifiers: fit, save, load, score.

All models take the feature contract, emit ``probabilities`` (array, one entry per class) and
``prediction``, and are saved and loaded by path.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus import schema as S
from gradus.functions.decisions import threshold_class
from gradus.operators.boosting import INFO as BOOSTED_INFO
from gradus.operators.boosting import BoostedModel
from gradus.operators.knn import (
    BROADCAST_BYTES,
    complete,
    few_points,
    knn_predict,
    only_useful,
    vote_here,
)
from gradus.operators.logistic import INFO as LOGISTIC_INFO
from gradus.operators.logistic import LogisticModel, newton
from gradus.operators.logistic import complete as complete_row
from gradus.operators.splitting import known_label
from gradus.session import write_out

WEIGHT = "class_weight"
MODEL_INFO = "knn_info"
ROWS_PER_TASK = 25_000  # distinct training rows that are worth a task of their own


@contextmanager
def _collapsed(
    train: DataFrame, features: Sequence[str], label: str, classes: Sequence[int]
) -> Iterator[tuple[DataFrame, list[int], int]]:
    """Equal training rows as one persisted row with ``copies`` and the sum of their balanced weights,
    the classes that they have, and the number of partitions.

    A weighted loss over the collapsed rows is the loss over all rows, so every later pass of
    a fit reads the distinct rows only. Flags and codes repeat massively in a registry.
    """
    rows = train.withColumn(label, known_label(label, classes)).groupBy(label, *features).agg(
        F.count(F.lit(1)).alias("copies")
    ).persist()
    try:
        sums = rows.groupBy(label).agg(F.sum("copies"), F.count(F.lit(1))).collect()
        if not sums:
            raise ValueError("no training rows")
        per_class = {r[0]: r[1] for r in sums}
        tasks = math.ceil(sum(r[2] for r in sums) / ROWS_PER_TASK)
        total = sum(per_class.values())
        weight = {c: total / (len(per_class) * n) for c, n in per_class.items()}
        factor = F.create_map(*[F.lit(v) for pair in weight.items() for v in pair])[F.col(label)]
        # A fit is many short passes: a small table in many partitions is mostly scheduling.
        yield rows.coalesce(tasks).withColumn(WEIGHT, F.col("copies") * factor), sorted(per_class), tasks
    finally:
        rows.unpersist()


def _scale(rows: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Population mean and deviation of collapsed rows (1 for a constant column), and the number of rows.

    The sums are taken around some row's values, so that the variance does not vanish in the
    rounding of large numbers.
    """
    some = rows.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).first()
    moments = []
    for c, shift in zip(features, some):
        gap = F.col(c).cast("double") - F.lit(shift)
        moments += [F.sum(gap * F.col("copies")), F.sum(gap * gap * F.col("copies"))]
    n, *sums = rows.agg(F.sum("copies"), *moments).first()
    mean, square = np.array(sums[0::2]) / n, np.array(sums[1::2]) / n
    deviation = np.sqrt(np.maximum(square - mean * mean, 0.0))
    # What is left of a constant's variance by rounding is no variance.
    deviation[deviation <= 1e-12 * np.maximum(1.0, np.abs(mean))] = 0.0
    return np.array(some) + mean, np.where(deviation > 0, deviation, 1.0), n


class KnnModel:
    """Training rows that can be neighbours, as a table; scoring is a join on z-scores.

    The query rows are scaled with the training mean and deviation, stored with the model.
    """

    def __init__(self, rows: DataFrame, info: dict):
        self.rows, self.info = rows, info

    @classmethod
    def fit(cls, train: DataFrame, id_column: str, features: Sequence[str] = tuple(S.FEATURES),
            label: str = S.TARGET, k: int = 7, classes: Sequence[int] = S.LEVELS) -> KnnModel:
        kept = train.select(F.col(id_column).alias("train_id"), F.col(label).cast("int").alias("label"), *features)
        rows = write_out(only_useful(kept, features, "train_id", k), "knn-rows")
        whole = complete(F.array(*[F.col(c).cast("double") for c in features]))
        *stats, holed = kept.agg(
            *[f(c) for c in features for f in (F.avg, F.stddev_pop)], F.count_if(~whole)
        ).first()
        if holed:
            raise ValueError(f"{holed} training rows miss a feature")
        info = {
            "features": list(features), "k": k, "classes": list(classes),
            "means": [float(stats[2 * i]) for i in range(len(features))],
            "deviations": [float(stats[2 * i + 1]) or 1.0 for i in range(len(features))],
        }
        return cls(rows, info)

    def _vector(self) -> Column:
        i = self.info
        return F.array(*[
            (F.col(c).cast("double") - m) / d
            for c, m, d in zip(i["features"], i["means"], i["deviations"])
        ])

    def score(self, df: DataFrame, **options) -> DataFrame:
        """``df`` with ``probabilities`` and ``prediction``: every row, whatever its id.

        A row with a missing feature has neither. With few training rows nothing is shuffled;
        with many, rows are told apart by a key that is written with them.
        """
        k, classes = self.info["k"], self.info["classes"]
        points = self.rows.select("train_id", "label", self._vector().alias("vec"))
        room = options.get("broadcast_bytes", BROADCAST_BYTES)
        if few_points(points, len(self.info["features"]), room):
            return vote_here(df, self._vector(), points, k, classes)
        keyed = write_out(df.withColumn("query_key", F.monotonically_increasing_id()), "knn-keyed")
        whole = keyed.withColumn("vec", self._vector()).filter(complete(F.col("vec")))
        votes = knn_predict(
            whole.select("query_key", "vec"), points, "vec", "query_key", "train_id", "label", k,
            classes, prepared=True, **options,
        ).withColumnRenamed("query_id", "query_key")
        return keyed.join(votes, "query_key", "left").select(*df.columns, "probabilities", "prediction")

    def save(self, path: str) -> None:
        spark = self.rows.sparkSession
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        i = self.info
        spark.createDataFrame(
            [(i["features"], i["k"], i["classes"], i["means"], i["deviations"])],
            "features array<string>, k int, classes array<int>, means array<double>, deviations array<double>",
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/{MODEL_INFO}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KnnModel:
        info = spark.read.parquet(f"{path}/{MODEL_INFO}").first().asDict()
        return cls(spark.read.parquet(f"{path}/rows"), info)


def load_model(spark: SparkSession, path: str) -> LogisticModel | KnnModel | BoostedModel:
    """A saved model. ``FileNotFoundError`` if the path is missing, ``ValueError`` if it holds
    something else."""
    def there(sub: str) -> bool:
        try:
            spark.read.format("binaryFile").load(f"{path}{sub}")
        except AnalysisException as error:
            if (error.getCondition() or "") == "PATH_NOT_FOUND":
                return False
            raise
        return True

    if not there(""):
        raise FileNotFoundError(path)
    if there(f"/{MODEL_INFO}"):
        return KnnModel.load(spark, path)
    if there(f"/{BOOSTED_INFO}"):
        return BoostedModel.load(spark, path)
    if there(f"/{LOGISTIC_INFO}"):
        return LogisticModel.load(spark, path)
    raise ValueError(f"not a saved model: {path}")


def fit_logistic(
    train: DataFrame, features: Sequence[str] = tuple(S.FEATURES), label: str = S.TARGET,
    classes: Sequence[int] = S.LEVELS, c: float = 1.0, max_iter: int = 1000,
    handle_invalid: str = "error",
) -> LogisticModel:
    """Scaled multinomial regression with balanced class weights: the minimum of the summed weighted
    loss plus half of 1/C times the squared slopes, by Newton steps over the distinct rows.

    A row with a missing feature fails the job, or is left out of the fit under ``skip``.
    """
    whole = complete_row(features)
    if handle_invalid == "skip":
        train = train.filter(whole)
    with _collapsed(train, features, label, classes) as (rows, present, parts):
        holed = F.when(whole, F.col(WEIGHT)).otherwise(F.raise_error(F.lit("a feature is missing")))
        rows = rows.select(label, "copies", *[F.col(f).cast("double").alias(f) for f in features], holed.alias(WEIGHT))
        means, deviations, total = _scale(rows, features)
        theta = newton(
            rows, features, label, WEIGHT, present, means, deviations, 1.0 / c, total, max_iter, parts
        )
        return LogisticModel.of(theta, present, classes, features, means, deviations, handle_invalid)


@dataclass(frozen=True)
class Registered:
    """One entry of the model registry."""

    name: str
    description: str
    path: str
    fit: Callable[..., LogisticModel | KnnModel | BoostedModel]
    threshold: float | None = None


def registry(folder: str, id_column: str = S.POINT_ID, rounds: int = 200) -> dict[str, Registered]:
    """The three compared classifiers; only the boosted one has a tuned class-0 threshold."""
    return {
        "logistic_regression": Registered(
            "Logistic Regression", "linear baseline on z-scores, balanced class weights",
            f"{folder}/logistic_regression", fit_logistic,
        ),
        "knn": Registered(
            "K-Nearest Neighbors", "7 nearest training points on z-scores, unweighted vote",
            f"{folder}/knn", lambda train: KnnModel.fit(train, id_column),
        ),
        "xgboost": Registered(
            "Gradient-Boosted Trees", "boosted trees, balanced row weights, tuned threshold for class 0",
            f"{folder}/xgboost", lambda train: BoostedModel.fit(train, rounds=rounds),
            S.CLASS0_THRESHOLD,
        ),
    }


def check_registry(models: dict[str, Registered]) -> None:
    if not models:
        raise ValueError("the model registry is empty")
    for key, model in models.items():
        if not model.path:
            raise ValueError(f"model {key} has no path")


def train_all(train: DataFrame, models: dict[str, Registered]) -> None:
    """Fit and save every registered model on one persisted training table, side by side.

    A fit is many short jobs with idle tasks in between; Spark shares the executors between them
    (evenly where the session has the fair scheduler). A fit that fails fails the run.
    """
    check_registry(models)
    train = train.persist()
    try:
        train.count()  # once, not by each fit
        with ThreadPoolExecutor(len(models)) as pool:
            for done in [pool.submit(lambda m=m: m.fit(train).save(m.path)) for m in models.values()]:
                done.result()
    finally:
        train.unpersist()


def score_with(
    model: LogisticModel | KnnModel | BoostedModel, df: DataFrame, threshold: float | None = None,
) -> DataFrame:
    """Scored rows; with a threshold the class-0 rule replaces the most probable class."""
    scored = model.score(df)
    if threshold is None:
        return scored
    return scored.withColumn("prediction", threshold_class(F.col("probabilities"), threshold))
