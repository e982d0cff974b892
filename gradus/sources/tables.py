"""Labelled dataset and metrics table: sinks and sources."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus import schema as S


def _is_missing_path(error: AnalysisException) -> bool:
    return (error.getCondition() or "") == "PATH_NOT_FOUND"


def write_labelled(labelled: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Overwrite ``path`` with the 13 labelled columns; returns what was written."""
    out = labelled.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.LABELLED_SCHEMA.fields]
    )
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)
    return out


def read_labelled(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(S.LABELLED_SCHEMA)
    try:
        if fmt == "csv":
            return reader.option("header", True).option("escape", '"').csv(path)
        return reader.format(fmt).load(path)
    except AnalysisException as error:
        if _is_missing_path(error):
            raise FileNotFoundError(path) from error
        raise


RUN_COUNTS = ["rows_read", "without_power", "without_group", "labelled", "without_feature"]


def write_run_counts(spark: SparkSession, counts: Mapping[str, int], path: str) -> None:
    """What became of the rows of a run: ``step, rows``, a row for each step."""
    rows = [(i, name, int(counts[name])) for i, name in enumerate(RUN_COUNTS)]
    table = spark.createDataFrame(rows, "position int, step string, rows long")
    table.coalesce(1).write.mode("overwrite").parquet(path)


def read_run_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy("position").select("step", "rows")


def metrics_table(spark: SparkSession, rows: Iterable[Mapping[str, object]]) -> DataFrame:
    """Metrics rows, one per model, with the fixed column order."""
    names = S.METRICS_SCHEMA.fieldNames()
    values = [
        tuple(
            float(row[c]) if c in S.METRICS and row[c] is not None else row[c] for c in names
        )
        for row in rows
    ]
    return spark.createDataFrame(values, S.METRICS_SCHEMA)


def write_metrics(metrics: DataFrame, path: str) -> DataFrame:
    """Metrics as one CSV file: the table has one row per registered model."""
    out = metrics.select(*S.METRICS_SCHEMA.fieldNames())
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return out


def read_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    """The metrics table, or None where nothing has been written yet."""
    try:
        return spark.read.schema(S.METRICS_SCHEMA).option("header", True).csv(path)
    except AnalysisException as error:
        if _is_missing_path(error):
            return None
        raise
