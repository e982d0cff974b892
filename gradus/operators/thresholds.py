"""Class-0 threshold sweep in one pass, and the picks made from it.

Each row is put in a bucket: the number of grid thresholds its P(class 0) reaches. Counts per
bucket give every threshold's confusion by running sums over at most 91 rows, so 90
thresholds cost the same as one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus import schema as S
from gradus.functions.decisions import argmax_class, best_other_class
from gradus.operators.metrics import ratio

SCORES = ["precision", "rappel", "f1", "accuracy"]


def grid_value(position: Column) -> Column:
    """Threshold at a 0-based grid position, with the rounding of a floating-point range."""
    return F.lit(S.GRID_START) + position * F.lit(S.GRID_STEP)


def reached(p0: Column) -> Column:
    """How many grid thresholds are at most ``p0`` (0..90)."""
    guess = F.floor((p0 - S.GRID_START) / S.GRID_STEP)
    position = (
        F.when(p0 >= grid_value(guess + 1), guess + 1)
        .when(p0 >= grid_value(guess), guess)
        .otherwise(guess - 1)
    )
    return F.least(F.greatest(position + 1, F.lit(0)), F.lit(S.GRID_SIZE)).cast("int")


def threshold_sweep(
    scored: DataFrame, truth: str = "y", probabilities: str = "probabilities",
    by: Sequence[str] = (),
) -> DataFrame:
    """90 rows (per ``by`` key): precision, recall and F1 of class 0, and accuracy."""
    p, y = F.col(probabilities), F.col(truth)
    counts = (
        scored.groupBy(*by, reached(p[0]).alias("reached"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(y == 0).alias("n_zero"),
            F.count_if(y == best_other_class(p)).alias("n_other_right"),
        )
    )
    # At most 91 cells per key are gathered, then laid out over the whole grid.
    cell = F.struct("n", "n_zero", "n_other_right")
    cells = counts.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("reached", cell))).alias("cells")
    )
    steps = F.sequence(F.lit(0), F.lit(S.GRID_SIZE))
    at = F.try_element_at("cells", F.col("reached"))
    filled = cells.select(*by, "cells", F.explode(steps).alias("reached")).select(
        *by, "reached",
        *[F.coalesce(at[c], F.lit(0)).alias(c) for c in ("n", "n_zero", "n_other_right")],
    )
    above = Window.partitionBy(*by).orderBy(F.desc("reached"))
    rest = Window.partitionBy(*by).orderBy("reached").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    sums = filled.select(
        *by, "reached",
        F.sum("n").over(above).alias("called"),
        F.sum("n_zero").over(above).alias("hits"),
        F.sum("n_zero").over(whole).alias("support"),
        F.sum("n").over(whole).alias("total"),
        F.coalesce(F.sum("n_other_right").over(rest), F.lit(0)).alias("other_right"),
    ).filter("reached > 0")
    called, hits, support = F.col("called"), F.col("hits"), F.col("support")
    return sums.select(
        *by,
        F.round(grid_value(F.col("reached") - 1), 3).alias("seuil"),
        ratio(hits, called).alias("precision"),
        ratio(hits, support).alias("rappel"),
        ratio(2 * hits, called + support).alias("f1"),
        ratio(hits + F.col("other_right"), F.col("total")).alias("accuracy"),
    )


def pr_curve(sweep: DataFrame) -> DataFrame:
    return sweep.select("rappel", "precision")


def _top(sweep: DataFrame, score: str) -> DataFrame:
    value = F.when(~F.isnan(score), F.col(score))
    return sweep.orderBy(value.desc_nulls_last(), "seuil").limit(1)


def best_f1_threshold(sweep: DataFrame) -> DataFrame:
    """Threshold with the best F1; the lowest one wins a tie."""
    return _top(sweep, "f1")


def best_recall_threshold(sweep: DataFrame, recall: float = S.MIN_CLASS0_RECALL) -> DataFrame:
    """Most precise threshold that keeps the wanted recall; no row where none does."""
    return _top(sweep.filter(F.col("rappel") >= recall), "precision")


def nearest_threshold(sweep: DataFrame, value: float) -> DataFrame:
    """Grid row closest to ``value``; the lower one wins a tie."""
    gap = F.abs(F.col("seuil") - value)
    return sweep.orderBy(gap, "seuil").limit(1)


def argmax_baseline(
    scored: DataFrame, truth: str = "y", probabilities: str = "probabilities",
) -> DataFrame:
    """The sweep's scores for the plain most-probable-class rule; no threshold."""
    y, p = F.col(truth), argmax_class(F.col(probabilities))
    called, support = F.count_if(p == 0), F.count_if(y == 0)
    hits = F.count_if((p == 0) & (y == 0))
    return scored.agg(
        F.lit(None).cast("double").alias("seuil"),
        ratio(hits, called).alias("precision"),
        ratio(hits, support).alias("rappel"),
        ratio(2 * hits, called + support).alias("f1"),
        ratio(F.count_if(y == p), F.count(F.lit(1))).alias("accuracy"),
    )


def threshold_summary(
    scored: DataFrame, truth: str = "y", probabilities: str = "probabilities",
    recall: float = S.MIN_CLASS0_RECALL,
) -> DataFrame:
    """Baseline, best-F1 and wanted-recall rows; the last is absent where no threshold has it."""
    sweep = threshold_sweep(scored, truth, probabilities)
    rows = {
        "baseline": argmax_baseline(scored, truth, probabilities),
        "max_f1": best_f1_threshold(sweep),
        "min_recall": best_recall_threshold(sweep, recall),
    }
    out = None
    for rule, row in rows.items():
        part = row.select(F.lit(rule).alias("rule"), "seuil", *SCORES)
        out = part if out is None else out.unionByName(part)
    return out
