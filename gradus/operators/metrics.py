"""Classification metrics, all taken from one confusion table per model.

Predictions are kept in long form (``model_key``, truth, prediction), so any number of
models costs one grouped count. Everything after it works on (classes squared) rows a model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus import schema as S
from gradus.functions.cleaning import nan_as_null
from gradus.operators.splitting import known_label

TRUTH, PREDICTED = "y", "p"


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as a double, 0 where the bottom is 0."""
    return F.when(bottom == 0, 0.0).otherwise(top.cast("double") / bottom.cast("double"))


def confusion(
    predictions: DataFrame, by: Sequence[str] = (), truth: str = TRUTH, predicted: str = PREDICTED,
) -> DataFrame:
    """Rows per (truth, prediction) pair that occurs, in long form."""
    return predictions.groupBy(
        *by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    predictions: DataFrame, labels: Sequence[int] = S.LEVELS, truth: str = TRUTH,
    predicted: str = PREDICTED, by: Sequence[str] = (),
) -> DataFrame:
    """One row per label, also where it is never true; one column ``pred_<label>`` per label.

    ``pred_other`` counts predictions that are no listed label (or NULL); the row without truth
    counts rows whose true label isn't listed, if there are any. With ``by`` one such square per
    model, from the same grouped count.
    """
    called = F.col("predicted")
    listed = F.coalesce(called.isin(list(labels)), F.lit(False))

    def cell(wanted: Column) -> Column:
        return F.coalesce(F.sum(F.when(wanted, F.col("n"))), F.lit(0)).cast("bigint")

    pairs = confusion(predictions, by, truth, predicted).withColumn(
        "truth", F.when(F.col("truth").isin(list(labels)), F.col("truth"))
    )
    # A zero beside every label, per model: rows of a fixed number, beside the counted pairs.
    zeros = pairs.select(*by).distinct() if by else predictions.sparkSession.range(1).select()
    zeros = zeros.select(
        *by,
        F.explode(
            F.array(*[F.lit(c).cast(pairs.schema["truth"].dataType) for c in labels])
        ).alias("truth"),
        F.lit(None).cast(pairs.schema["predicted"].dataType).alias("predicted"),
        F.lit(0).cast("bigint").alias("n"),
    )
    return pairs.unionByName(zeros).groupBy(*by, "truth").agg(
        *[cell(called == c).alias(f"pred_{c}") for c in labels], cell(~listed).alias("pred_other")
    )


def class_report(
    predictions: DataFrame, by: Sequence[str] = (), truth: str = TRUTH, predicted: str = PREDICTED,
) -> DataFrame:
    """Precision, recall, F1 and support for every label that is true or predicted somewhere."""
    pairs = confusion(predictions, by, truth, predicted)
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(
            F.col("truth").alias("label"), F.col("n").alias("support"),
            F.lit(0).cast("bigint").alias("called"), hit.alias("hits"),
        ),
        F.struct(
            F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"),
            F.col("n").alias("called"), F.lit(0).cast("bigint").alias("hits"),
        ),
    )
    per_label = (
        pairs.select(*by, F.explode(sides).alias("side")).select(*by, "side.*")
        .filter("label is not null").groupBy(*by, "label")
        .agg(
            F.sum("hits").alias("hits"), F.sum("called").alias("called"),
            F.sum("support").alias("support"),
        )
    )
    hits, called, support = F.col("hits"), F.col("called"), F.col("support")
    return per_label.select(
        *by, "label",
        ratio(hits, called).alias("precision"),
        ratio(hits, support).alias("recall"),
        ratio(2 * hits, called + support).alias("f1"),
        "support", "hits",
    )


def classification_metrics(
    predictions: DataFrame, by: Sequence[str] = (), truth: str = TRUTH, predicted: str = PREDICTED,
) -> DataFrame:
    """The five scores per model: macro means run over the union of true and predicted labels."""
    report = class_report(predictions, by, truth, predicted)
    grouped = report.groupBy(*by) if by else report.groupBy()
    return grouped.agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.avg("f1").alias("f1_macro"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
    )


def full_report(predictions: DataFrame, truth: str = TRUTH, predicted: str = PREDICTED) -> DataFrame:
    """Per-label rows followed by 'accuracy', 'macro avg' and 'weighted avg' rows."""
    report = class_report(predictions, (), truth, predicted)
    total = F.sum("support")

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / total

    accuracy = F.sum("hits") / total
    summary = report.agg(
        F.array(
            *[
                F.struct(F.lit(row).alias("row"), *[v.alias(c) for c, v in cells.items()], total.alias("support"))
                for row, cells in {
                    "accuracy": dict(precision=accuracy, recall=accuracy, f1=accuracy),
                    "macro avg": dict(precision=F.avg("precision"), recall=F.avg("recall"), f1=F.avg("f1")),
                    "weighted avg": dict(precision=weighted("precision"), recall=weighted("recall"), f1=weighted("f1")),
                }.items()
            ]
        ).alias("rows")
    ).select(F.inline("rows"))
    per_label = report.select(
        F.col("label").cast("string").alias("row"), "precision", "recall", "f1", "support"
    )
    return per_label.unionByName(summary)


def stack_predictions(frames: dict[str, DataFrame]) -> DataFrame:
    """Predictions of several models as one long table keyed by ``model_key``."""
    stacked = None
    for key, df in frames.items():
        part = df.select(F.lit(key).alias("model_key"), TRUTH, PREDICTED)
        stacked = part if stacked is None else stacked.unionByName(part)
    if stacked is None:
        raise ValueError("no model to evaluate")
    return stacked


def evaluate_models(predictions: DataFrame, models: dict[str, tuple[str, str]]) -> DataFrame:
    """Metrics table: one row per model of ``models`` (key -> name, path)."""
    if not models:
        raise ValueError("the model registry is empty")
    scores = classification_metrics(
        predictions.filter(F.col("model_key").isin(list(models))), ["model_key"]
    )

    def lookup(position: int) -> Column:
        entries = [F.lit(v) for key, value in models.items() for v in (key, value[position])]
        return F.create_map(*entries)[F.col("model_key")]

    return scores.select(
        "model_key", lookup(0).alias("model_name"), lookup(1).alias("model_path"), *S.METRICS
    )


def best_model(metrics: DataFrame, metric: str = "f1_weighted") -> DataFrame:
    """Row with the best score; NaN counts as missing, the first key wins a tie."""
    score = F.when(~F.isnan(metric), F.col(metric))
    return metrics.orderBy(score.desc_nulls_last(), "model_key").limit(1)


def metrics_long(metrics: DataFrame) -> DataFrame:
    """One row per model and metric."""
    return metrics.unpivot(["model_key", "model_name"], S.METRICS, "metric", "value")


def metrics_display(metrics: DataFrame) -> DataFrame:
    """Scores as text with four decimals, under display column names."""
    return metrics.select(
        F.col("model_name").alias("Modèle"),
        *[F.format_string("%.4f", F.col(c)).alias(c) for c in S.METRICS],
    )


def quality_checks(
    labelled: DataFrame, label: str = S.TARGET, labels: Sequence[int] = S.LEVELS,
    features: Sequence[str] = tuple(S.FEATURES),
) -> DataFrame:
    """One row per contract check: its name, the offending rows and whether it passed."""
    known = F.coalesce(F.col(label).isin(list(labels)), F.lit(False))
    kinds = dict(labelled.dtypes)
    checks = {
        "rows_missing": F.when(F.count(F.lit(1)) == 0, 1).otherwise(0),
        "label_unknown": F.count_if(~known),
        **{f"null_{c}": F.count_if(nan_as_null(F.col(c), kinds[c]).isNull()) for c in features},
    }
    counts = labelled.agg(*[v.cast("bigint").alias(c) for c, v in checks.items()])
    return counts.unpivot([], list(checks), "check_name", "n_bad").withColumn(
        "passed", F.col("n_bad") == 0
    )


def require_quality(labelled: DataFrame, **options) -> None:
    """Raise ``ValueError`` that lists every failed contract check."""
    failed = quality_checks(labelled, **options).filter("not passed").collect()
    if failed:
        raise ValueError("; ".join(f"{r.check_name}: {r.n_bad}" for r in failed))


def label_shares(labelled: DataFrame, label: str = S.TARGET, labels: Sequence[int] = S.LEVELS) -> DataFrame:
    """Rows and share per label; the window runs over one row per label.

    Raises where a label is not in ``labels``.
    """
    counts = (
        labelled.select(known_label(label, labels)).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
