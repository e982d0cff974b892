"""Aggregates per group (municipality) and per level. All combine map-side first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus import schema as S


def group_sizes(points: DataFrame, group: str = S.GROUP) -> DataFrame:
    """Rows per non-null group, as used for the training labels."""
    return (
        points.filter(F.col(group).isNotNull()).groupBy(group)
        .agg(F.count(F.lit(1)).alias("nombre_pdc_commune"))
    )


def group_profile(points: DataFrame, group: str = S.GROUP, counted: str = S.POINT_ID) -> DataFrame:
    """Non-null ids and mean position per group, as used for the choice of k.

    It differs from ``group_sizes`` where an id is missing; feed it located points.
    """
    return (
        points.filter(F.col(group).isNotNull()).groupBy(group)
        .agg(
            F.count(counted).alias("nb_pdc"),
            F.avg("latitude").alias("latitude"),
            F.avg("longitude").alias("longitude"),
        )
    )


def mean_positions(points: DataFrame, group: str = S.GROUP) -> DataFrame:
    """Mean position per group, in no order."""
    return (
        points.filter(F.col(group).isNotNull()).groupBy(group)
        .agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
    )


def group_centroids(points: DataFrame, group: str = S.GROUP) -> DataFrame:
    return mean_positions(points, group).orderBy(group)


def centroid_of(points: DataFrame, value: str, group: str = S.GROUP) -> DataFrame:
    """Mean position of one group; the filter comes first, so only its rows are read."""
    return mean_positions(points.filter(F.col(group) == F.lit(value)), group)


def map_bubbles(labelled: DataFrame, level_name: Column, group: str = S.GROUP) -> DataFrame:
    """One map bubble per group. The level is constant in a group, so ``max`` picks it."""
    return (
        labelled.filter(F.col(group).isNotNull()).groupBy(group)
        .agg(
            F.avg("latitude").alias("latitude"),
            F.avg("longitude").alias("longitude"),
            F.count(S.TARGET).alias("nombre_pdc"),
            F.max(level_name).alias("Niveau"),
        )
    )


def class_stats(labelled: DataFrame, group: str = S.GROUP, label: str = S.TARGET) -> DataFrame:
    """Groups, mean and largest point count per level: group first, then level."""
    per_group = (
        labelled.filter(F.col(group).isNotNull()).groupBy(group)
        .agg(F.count(label).alias("n"), F.max(label).alias(label))
    )
    return (
        per_group.filter(F.col(label).isNotNull()).groupBy(label)
        .agg(
            F.count(F.lit(1)).alias("n_groups"),
            F.avg("n").alias("mean_points"),
            F.max("n").alias("max_points"),
        )
    )


def kpis(labelled: DataFrame, metrics: DataFrame | None = None, group: str = S.GROUP) -> DataFrame:
    """Dashboard head row: points, groups, mean power and the best weighted F1 (if any)."""
    head = labelled.agg(
        F.count(F.lit(1)).alias("n_points"),
        F.count_distinct(group).alias("n_groups"),
        F.avg(S.POWER).alias("mean_power"),
    )
    best = (
        metrics.agg(F.max("f1_weighted")).scalar() if metrics is not None
        else F.lit(None).cast("double")
    )
    return head.withColumn("best_f1_weighted", best)
