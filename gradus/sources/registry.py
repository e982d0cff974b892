"""Raw registry source and the filters that start the pipeline."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus import schema as S
from gradus.functions.cleaning import (
    contains_flag,
    flag_from_text,
    numeric_or_null,
    ordinal_code,
    text_or_null,
)


CORRUPT = "_corrupt_record"


def read_raw_csv(
    spark: SparkSession, path: str, columns: Sequence[str] | None = tuple(S.RAW_COLUMNS),
    multiline: bool = False,
) -> DataFrame:
    """National CSV as text columns picked by header name; cell texts for "missing" become NULL.

    The header is the schema, so extra columns and any column order are fine and there is no
    inference pass; ``columns=None`` keeps all. All files of a folder must have one header: a
    file whose header differs fails the job (``read_raw_folder`` takes such files). Keep
    ``multiline`` off unless quoted line breaks occur: it makes each file one task.
    """
    raw = (
        spark.read.option("header", True).option("escape", '"').option("encoding", "UTF-8")
        .option("multiLine", multiline).option("inferSchema", False)
        .option("enforceSchema", False).csv(path)
    )
    return raw.select(*[text_or_null(F.col(f"`{c}`")).alias(c) for c in columns or raw.columns])


def read_raw_csvs(
    spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = tuple(S.RAW_COLUMNS),
    multiline: bool = False,
) -> DataFrame:
    """Several CSV files or folders, each with a header of its own, put together by column name.

    A column that one of them lacks is NULL there.
    """
    parts = [read_raw_csv(spark, path, None, multiline) for path in paths]
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return raw.select(*columns) if columns else raw


def _first_lines(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of a folder by their first line; one line of each file is read, many files at once."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    found, listing = [], fs.listFiles(root, True)
    while listing.hasNext():
        status = listing.next()
        name = status.getPath().getName()
        if status.getLen() and not name.startswith(("_", ".")):
            found.append(status.getPath())

    def first(file) -> tuple[str, str]:
        codec = codecs.getCodec(file)
        stream = fs.open(file)
        if codec is not None:
            stream = codec.createInputStream(stream)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        try:
            return reader.readLine(), file.toString()
        finally:
            reader.close()

    out: dict[str, list[str]] = {}
    with ThreadPoolExecutor(16) as pool:
        for line, file in pool.map(first, found):
            out.setdefault(line.removeprefix("\ufeff"), []).append(file)
    return out


def read_raw_folder(
    spark: SparkSession, path: str, columns: Sequence[str] | None = tuple(S.RAW_COLUMNS),
    multiline: bool = False,
) -> DataFrame:
    """All CSV files under ``path``, whatever header each has, by column name.

    Files are grouped by their header, and each group is one scan. A column that a file lacks is
    NULL in its rows. A row whose cells don't fit its header keeps its text in ``CORRUPT`` (NULL
    in sound rows), see ``sound_rows`` and ``broken_count``.
    """
    parts = []
    for _, files in sorted(_first_lines(spark, path).items()):
        options = {"header": True, "escape": '"', "encoding": "UTF-8", "multiLine": multiline}
        names = spark.read.options(**options).csv(files[0]).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in (*names, CORRUPT)])
        # Without pruning, as a row is only held against its header where all its cells are parsed.
        raw = spark.read.schema(schema).options(
            **options, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, columnPruning=False
        ).csv(files)
        # Spark refuses a scan of the corrupt texts alone: they always come with a cell (none of it).
        cell = F.substring(F.coalesce(F.col(f"`{names[0]}`"), F.lit("")), 1, 0)
        broken = F.concat(F.col(CORRUPT), cell).alias(CORRUPT)
        parts.append(raw.select(*[text_or_null(F.col(f"`{c}`")).alias(c) for c in names], broken))
    if not parts:
        raise FileNotFoundError(path)
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if columns is None:
        return raw.select(*[c for c in raw.columns if c != CORRUPT], CORRUPT)
    lacking = {c: F.lit(None).cast("string") for c in columns if c not in raw.columns}
    return raw.withColumns(lacking).select(*columns, CORRUPT)


def sound_rows(raw: DataFrame) -> DataFrame:
    """Rows that fit their file's header, without the channel for the others."""
    return raw.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def broken_count(raw: DataFrame) -> DataFrame:
    """One row: all rows and those that don't fit their file's header."""
    return raw.agg(F.count(F.lit(1)).alias("n_rows"), F.count(CORRUPT).alias("n_broken"))


def read_raw_parquet(
    spark: SparkSession, path: str, columns: Sequence[str] | None = tuple(S.RAW_COLUMNS),
) -> DataFrame:
    """The same registry as Parquet; texts for "missing" become NULL as from CSV.

    ``columns=None`` keeps all that the files have. The operator's name alone stays as it is, so
    that a filter on it reaches the scan.
    """
    if columns is None:
        raw = spark.read.parquet(path)
    else:
        raw = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).parquet(path)
    kinds = dict(raw.dtypes)
    cleaned = {c: text_or_null(F.col(f"`{c}`")) for c in raw.columns if c != S.OPERATOR and kinds[c] == "string"}
    return raw.withColumns(cleaned)


def keep_operator(points: DataFrame, operator: str, column: str = S.OPERATOR) -> DataFrame:
    """Exact match on the operator; reaches the Parquet scan as a pushed filter."""
    return points.filter(F.col(column) == F.lit(operator))


def keep_located(points: DataFrame, columns: Sequence[str] = ("latitude", "longitude")) -> DataFrame:
    return points.na.drop(subset=list(columns))


def keep_in_viewport(
    points: DataFrame, longitude: str = "longitude", latitude: str = "latitude",
    longitudes: tuple[float, float] = S.LONGITUDE_RANGE,
    latitudes: tuple[float, float] = S.LATITUDE_RANGE,
) -> DataFrame:
    return points.filter(
        F.col(longitude).between(*longitudes) & F.col(latitude).between(*latitudes)
    )


def with_features(points: DataFrame) -> DataFrame:
    """Typed feature and coordinate columns beside the raw ones; one narrow projection."""
    typed = {c: flag_from_text(F.col(c)) for c in S.PLUG_FLAGS}
    typed["implantation_encoded"] = ordinal_code(F.col(S.SITE_TYPE), S.SITE_TYPE_CODES)
    typed["acces_libre"] = contains_flag(F.col(S.ACCESS), S.FREE_ACCESS_TEXT)
    for c in (S.POWER, S.POINT_COUNT):
        typed[c] = numeric_or_null(F.col(c))
    typed["latitude"] = numeric_or_null(F.col(S.RAW_LATITUDE))
    typed["longitude"] = numeric_or_null(F.col(S.RAW_LONGITUDE))
    return points.withColumns(typed)


def clean_points(points: DataFrame, required: Sequence[str] = (S.POWER,)) -> DataFrame:
    """Encoded points without the rows that miss a required value."""
    return with_features(points).na.drop(subset=list(required))


def drop_counts(points: DataFrame, required: Sequence[str] = (S.POWER,)) -> DataFrame:
    """One row: rows before, rows dropped and rows kept by ``clean_points``, in one pass."""
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull()
    return with_features(points).agg(
        F.count(F.lit(1)).alias("n_before"),
        F.count_if(~complete).alias("n_dropped"),
        F.count_if(complete).alias("n_kept"),
    )
