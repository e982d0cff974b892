"""The pipeline's three runs: prepare and train, evaluate, tune the threshold.

Every run reads rows by a key that is written with them once, so that rows whose id is missing or
repeated are split and scored like all others.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gradus import schema as S
from gradus.functions.cleaning import nan_as_null
from gradus.operators import metrics as M
from gradus.operators import thresholds as T
from gradus.operators.levels import label_points
from gradus.operators.models import (
    Registered,
    check_registry,
    load_model,
    score_with,
    train_all,
)
from gradus.operators.splitting import SPLIT, TEST, TRAIN, VALIDATION, fit_split, with_row_key
from gradus.plans.explore import report as dashboard
from gradus.session import write_out
from gradus.sources.registry import keep_operator, with_features
from gradus.sources.tables import write_labelled, write_metrics, write_run_counts


def prepare(raw: DataFrame, operator: str) -> tuple[DataFrame, dict[str, int]]:
    """Raw registry rows to labelled points of one operator, written with their id and a row key,
    and what became of the rows.

    The counts ride on the writes: rows of the operator, those without a power, those whose
    group is missing, labelled ones, and of these how many miss a feature.
    """
    encoded = with_features(keep_operator(raw, operator))
    read, done = Observation("read"), Observation("labelled")
    encoded = encoded.observe(
        read, F.count(F.lit(1)).alias("rows_read"), F.count_if(F.col(S.POWER).isNull()).alias("without_power")
    )
    kept = [S.POINT_ID, S.GROUP, "latitude", "longitude", *S.FEATURES]
    cleaned = write_out(encoded.na.drop(subset=[S.POWER]).select(*kept), "cleaned")
    keyed = with_row_key(label_points(cleaned))
    kinds = dict(keyed.dtypes)
    hole = reduce(or_, [nan_as_null(F.col(c), kinds[c]).isNull() for c in S.FEATURES])
    labelled = write_out(
        keyed.observe(done, F.count(F.lit(1)).alias("labelled"), F.count_if(hole).alias("without_feature")), "labelled"
    )
    counts = {**read.get, **done.get}
    counts["without_group"] = counts["rows_read"] - counts["without_power"] - counts["labelled"]
    return labelled, counts


def missing_counts(points: DataFrame, features: Sequence[str] = tuple(S.FEATURES)) -> DataFrame:
    """One row: all rows, those that miss a feature, and how many miss each one (NaN too)."""
    kinds = dict(points.dtypes)
    holes = {c: nan_as_null(F.col(c), kinds[c]).isNull() for c in features}
    return points.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(reduce(or_, holes.values())).alias("n_incomplete"),
        *[F.count_if(hole).alias(f"n_{c}") for c, hole in holes.items()],
    )


def treat_missing(
    points: DataFrame, policy: str = "drop", features: Sequence[str] = tuple(S.FEATURES),
) -> DataFrame:
    """Rows for all models alike: without incomplete rows (``drop``), with the column's mean in
    their place (``fill``), or none allowed (``error``)."""
    if policy == "drop":
        return points.na.drop(subset=list(features))
    counts = missing_counts(points, features).first()
    if policy == "error":
        if counts["n_incomplete"]:
            raise ValueError(f"{counts['n_incomplete']} of {counts['n_rows']} rows miss a feature")
        return points
    if policy != "fill":
        raise ValueError(f"unknown policy for missing values: {policy}")
    kinds = dict(points.dtypes)
    means = points.agg(*[F.avg(nan_as_null(F.col(c), kinds[c])).alias(c) for c in features]).first()
    filled = {
        c: F.coalesce(nan_as_null(F.col(c), kinds[c]), F.lit(means[c]).cast(kinds[c]))
        for c in features
    }
    return points.withColumns(filled)


def prepare_and_train(
    raw: DataFrame, operator: str, labelled_path: str, models: dict[str, Registered],
    test_size: float = 0.2, seed: int = 42, missing: str = "drop", validation_size: float = 0.0,
) -> DataFrame:
    """Label, export the 13 columns, split, train and save; returns points with their split.

    What became of the rows read is stored beside the labelled table, under its path and ``_counts``.
    ``missing`` says what becomes of rows that miss a feature, for all models alike. With a
    ``validation_size`` that share of the training side is set apart (``validation``) for the
    choice of a threshold, so that neither test nor training rows decide it.
    """
    labelled, counts = prepare(raw, operator)
    write_run_counts(raw.sparkSession, counts, f"{labelled_path}_counts")
    write_labelled(labelled, labelled_path)
    usable = treat_missing(labelled, missing)
    split = fit_split(usable, S.POINT_ID, S.TARGET, test_size, seed, row_key=S.ROW_KEY).apply(usable)
    if validation_size:
        rest = split.filter(F.col(SPLIT) == TRAIN)
        second = fit_split(
            rest, S.POINT_ID, S.TARGET, validation_size, seed + 1, row_key=S.ROW_KEY
        ).column()
        part = F.when(second == TEST, VALIDATION).otherwise(TRAIN)
        split = split.withColumn(SPLIT, F.when(F.col(SPLIT) == TRAIN, part).otherwise(F.col(SPLIT)))
    train_all(split.filter(F.col(SPLIT) == TRAIN), models)
    return split


def predict_all(
    spark: SparkSession, test: DataFrame, models: dict[str, Registered], tuned: bool = False,
) -> dict[str, DataFrame]:
    """Predictions (y, p) per registered model; ``tuned`` applies the class-0 thresholds."""
    out = {}
    for key, model in models.items():
        scored = score_with(
            load_model(spark, model.path), test, model.threshold if tuned else None
        )
        out[key] = scored.select(F.col(S.TARGET).alias(M.TRUTH), F.col("prediction").alias(M.PREDICTED))
    return out


def evaluate(
    spark: SparkSession, split: DataFrame, models: dict[str, Registered], metrics_path: str,
    tuned: bool = False,
) -> DataFrame:
    """Contract checks, then one metrics row per model from a single grouped count."""
    check_registry(models)
    M.require_quality(split)
    predictions = M.stack_predictions(
        predict_all(spark, split.filter(F.col(SPLIT) == TEST), models, tuned)
    )
    names = {key: (m.name, m.path) for key, m in models.items()}
    scores = M.evaluate_models(predictions, names)
    rows = [r.asDict() for r in scores.orderBy("model_key").collect()]  # one row per model
    table = spark.createDataFrame([tuple(r.values()) for r in rows], S.METRICS_SCHEMA)
    write_metrics(table, metrics_path)
    return table


def report(
    spark: SparkSession, split: DataFrame, models: dict[str, Registered], threshold_model: str,
) -> dict[str, DataFrame]:
    """Tables of the dashboard for saved models: the test rows are scored once per model."""
    predictions = write_out(
        M.stack_predictions(predict_all(spark, split.filter(F.col(SPLIT) == TEST), models)), "predictions"
    )
    names = {key: (m.name, m.path) for key, m in models.items()}
    scored = score_with(
        load_model(spark, models[threshold_model].path), split.filter(F.col(SPLIT) == TEST)
    )
    kept = write_out(scored.select(F.col(S.TARGET).alias("y"), "probabilities"), "scored")
    return dashboard(split, predictions, M.evaluate_models(predictions, names), kept)


def tune_threshold(spark: SparkSession, split: DataFrame, model: Registered, part: str = TEST) -> DataFrame:
    """Baseline and best thresholds of a saved model on one part of the split."""
    rows = split.filter(F.col(SPLIT) == part)
    scored = score_with(load_model(spark, model.path), rows)
    kept = write_out(scored.select(F.col(S.TARGET).alias("y"), "probabilities"), "scored")
    return T.threshold_summary(kept)
