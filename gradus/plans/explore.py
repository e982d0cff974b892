"""The exploratory and the report run: every table behind their charts, by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus import schema as S
from gradus.functions.cleaning import name_of
from gradus.operators import groups as G
from gradus.operators import levels as L
from gradus.operators import metrics as M
from gradus.operators import profiling as P
from gradus.operators import thresholds as T
from gradus.session import write_out
from gradus.sources.registry import clean_points, drop_counts, keep_located, keep_operator, with_features

KS = tuple(range(2, 9))
BINS = 30


def explore(raw: DataFrame, operator: str, ks: Sequence[int] = KS) -> dict[str, DataFrame]:
    """Profile of one operator's raw rows (all columns that ``raw`` has), and the choice of k."""
    own = keep_operator(raw, operator)
    points = write_out(clean_points(own), "explored")
    located = keep_located(with_features(own))
    sizes = write_out(G.group_sizes(points), "explored-sizes")
    level = F.log1p(F.col(L.SIZE))
    return {
        "scan_profile": P.scan_profile(own, [S.GROUP, S.STATION_ID]),
        "null_profile": P.null_profile(own),
        "drop_counts": drop_counts(own),
        "access_counts": P.value_counts(own, S.ACCESS),
        "site_shares": P.value_shares(own, S.SITE_TYPE),
        "plug_totals": P.flag_totals(points, S.PLUG_NAMES),
        "power_summary": P.describe(points, S.POWER),
        "power_histogram": P.histogram(points, F.col(S.POWER), BINS),
        "group_profile": G.group_profile(located),
        "size_summary": P.describe(sizes, L.SIZE),
        "size_histogram": P.histogram(sizes, F.col(L.SIZE), BINS),
        "log_size_histogram": P.histogram(sizes, level, BINS),
        "elbow": L.elbow(sizes, ks),
        "silhouette": L.silhouette(sizes, ks),
        "level_summary": L.level_summary(L.label_groups(sizes, L.fit_levels(sizes, (3,))[3])),
    }


def report(
    labelled: DataFrame, predictions: DataFrame | None = None, metrics: DataFrame | None = None,
    scored: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Tables of the dashboard: from the labelled points, and where given from the models'
    predictions (``model_key, y, p``), their metrics and the scored rows (``y, probabilities``)."""
    name = name_of(F.col(S.TARGET), S.LEVEL_NAMES)
    out = {
        "kpis": G.kpis(labelled, metrics),
        "map_bubbles": G.map_bubbles(labelled, name),
        "class_stats": G.class_stats(labelled).withColumn("Niveau", name),
        "label_shares": M.label_shares(labelled).withColumn("Niveau", name),
        "power_by_label": P.histogram(labelled, F.col(S.POWER), BINS, [S.TARGET]),
        "quality_checks": M.quality_checks(labelled),
    }
    if predictions is not None:
        out["confusion"] = M.confusion_matrix(predictions, by=["model_key"]).withColumn(
            "Niveau", name_of(F.col("truth"), S.LEVEL_NAMES)
        )
    if metrics is not None:
        out |= {
            "metrics_long": M.metrics_long(metrics),
            "metrics_display": M.metrics_display(metrics),
            "best_model": M.best_model(metrics),
        }
    if scored is not None:
        sweep = T.threshold_sweep(scored)
        out |= {"threshold_sweep": sweep, "pr_curve": T.pr_curve(sweep)}
    return out


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table per name."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
