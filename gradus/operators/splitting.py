"""Exact stratified split and balanced class weights."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus import schema as S
from gradus.session import write_out

SPLIT = "split"
TEST, TRAIN, VALIDATION = "test", "train", "validation"
BUCKET_ROWS = 100_000  # wanted rows of one hash bucket; only one bucket per class is ranked


def split_quotas(class_counts: dict[int, int], test_size: float = 0.2) -> dict[int, int]:
    """Test rows per class: ceil(test_size * n) in all, shared out by largest remainder.

    The training side is rounded first, the test side gets the rest, as in the usual
    stratified splitter; equal remainders go to the smaller class.
    """
    n = sum(class_counts.values())
    n_test = math.ceil(test_size * n)
    n_train = n - n_test
    train = {c: m * n_train // n for c, m in class_counts.items()}
    by_rest = sorted(class_counts, key=lambda c: (-(class_counts[c] * n_train % n), c))
    for c in by_rest[: n_train - sum(train.values())]:
        train[c] += 1
    return {c: m - train[c] for c, m in class_counts.items()}


@dataclass(frozen=True)
class StratifiedSplit:
    """Per class the last (hash, identity) that belongs to the test side."""

    id_column: str
    label: str
    seed: int
    cutoffs: dict[int, tuple[str, str]]
    row_key: str | None = None

    def column(self) -> Column:
        """'test' or 'train' as a narrow expression: any later job repeats the same split."""
        key = identity(self.id_column, self.row_key)
        h = _hash(self.id_column, self.row_key, self.seed)
        is_test = F.lit(False)
        for c, (cut_hash, cut_id) in self.cutoffs.items():
            is_test = F.when(
                F.col(self.label) == c, (h < cut_hash) | ((h == cut_hash) & (key <= cut_id))
            ).otherwise(is_test)
        return F.when(is_test, TEST).otherwise(TRAIN)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(SPLIT, self.column())


def identity(id_column: str, row_key: str | None = None) -> Column:
    """Text that tells rows apart: the id, and the key of the row where ids may repeat or lack."""
    text = F.col(id_column).cast("string")
    if row_key is None:
        return text
    return F.concat(F.coalesce(text, F.lit("")), F.lit("|"), F.col(row_key).cast("string"))


def _hash(id_column: str, row_key: str | None, seed: int) -> Column:
    """Hash of the id alone, so that rows keep their place whatever key a run gave them; a row
    without an id takes its key."""
    text = F.col(id_column).cast("string")
    if row_key is not None:
        text = F.coalesce(text, identity(id_column, row_key))
    return F.md5(F.concat(text, F.lit(f"-{seed}")).cast("binary"))


def fit_split(
    df: DataFrame, id_column: str, label: str = S.TARGET, test_size: float = 0.2,
    seed: int = 42, bucket_rows: int = BUCKET_ROWS, row_key: str | None = None,
) -> StratifiedSplit:
    """Exact per-class quotas in hash order of the rows' identity: the id, and ``row_key`` with it.

    Without a row key the id must be there and unique where a quota ends, else ``ValueError``:
    rows that can't be told apart would all go to one side. Rows without a label are in neither
    quota.

    One job counts the classes. The next counts rows per class and hash bucket, finds the
    bucket in which a class's quota runs out, and ranks the rows of that bucket only. So no
    task orders more of a class than one bucket, however large the class.
    """
    keyed = df.select(
        F.col(label).alias("label"), identity(id_column, row_key).alias("id"),
        _hash(id_column, row_key, seed).alias("h"),
    ).filter("label is not null")
    rows = keyed.groupBy("label").agg(F.count(F.lit(1)), F.count_if(F.col("id").isNull())).collect()
    if any(r[2] for r in rows):
        raise ValueError(f"{sum(r[2] for r in rows)} rows lack {id_column}; name a row key")
    classes = {r[0]: r[1] for r in rows}
    quotas = {c: q for c, q in split_quotas(classes, test_size).items() if q > 0}
    if not quotas:
        return StratifiedSplit(id_column, label, seed, {}, row_key)
    prefix = 0  # buckets and rows per bucket both stay near the square root of a huge class
    while max(classes.values()) > max(bucket_rows, 16 ** prefix) * 16 ** prefix:
        prefix += 1
    keyed = keyed.withColumn("bucket", F.substring("h", 1, prefix))
    counts = keyed.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("label").orderBy("bucket")
    quota = F.try_element_at(
        F.create_map(*[F.lit(v) for pair in quotas.items() for v in pair]), F.col("label")
    )
    upto = counts.withColumn("upto", F.sum("n").over(running)).withColumn("quota", quota)
    last = upto.filter("upto >= quota and upto - n < quota").select(
        "label", "bucket", (F.col("quota") - (F.col("upto") - F.col("n"))).alias("rest")
    )
    in_bucket = Window.partitionBy("label", "bucket").orderBy("h", "id")
    cut = (
        keyed.join(F.broadcast(last), ["label", "bucket"])  # one row per class
        .withColumns({
            "rank": F.row_number().over(in_bucket),
            "tied": F.coalesce(F.lead("id").over(in_bucket) == F.col("id"), F.lit(False)),
        })
        .filter("rank = rest").select("label", "h", "id", "tied").collect()
    )
    if any(r["tied"] for r in cut):
        raise ValueError(f"{id_column} repeats where a class's quota ends; name a row key")
    return StratifiedSplit(id_column, label, seed, {r[0]: (r[1], r[2]) for r in cut}, row_key)


def with_row_key(df: DataFrame, name: str = S.ROW_KEY) -> DataFrame:
    """``df``, written, with a key that tells its rows apart: a hash of the row's content and its number
    among equal rows.

    The keys of a table are the same on any partitioning, so a split by them is, too. Only rows
    that repeat are numbered: within a written partition, behind the partitions before, so no task
    orders all copies of a row.
    """
    content, part, n = (f"_{name}_{x}" for x in ("content", "part", "n"))
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    rows = write_out(df.withColumns({content: F.md5(text.cast("binary")), part: F.spark_partition_id()}), "row-keys")
    counts = rows.groupBy(content, part).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(content).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum(n).over(Window.partitionBy(content))
    repeated = counts.withColumns({"start": F.coalesce(F.sum(n).over(before), F.lit(0)), "all": whole})
    repeated = write_out(repeated.filter(F.col("all") > 1).select(content, part, "start"), "row-repeats")
    plain = rows.withColumn(name, F.concat(content, F.lit("-0")))
    if repeated.isEmpty():
        return plain.drop(content, part)
    number = F.row_number().over(Window.partitionBy(content, part).orderBy(content)) - 1
    many = rows.join(repeated, [content, part]).withColumn(
        name, F.concat(content, F.lit("-"), (F.col("start") + number).cast("string"))
    )
    once = plain.join(repeated.select(content, part), [content, part], "left_anti")
    return once.select(*df.columns, name).unionByName(many.select(*df.columns, name))


def split_overlap(split: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: keys on both sides, and keys of the whole on neither side. Both should be 0."""
    test = split.filter(F.col(SPLIT) == TEST).select(*columns)
    train = split.filter(F.col(SPLIT) == TRAIN).select(*columns)
    both = test.intersect(train).agg(F.count(F.lit(1))).scalar()
    neither = split.select(*columns).exceptAll(test.unionAll(train)).agg(F.count(F.lit(1)))
    return neither.select(both.alias("n_both"), F.col("count(1)").alias("n_neither"))


def known_label(label: str, classes: Sequence[int]) -> Column:
    """The label; a row whose label is NULL or not in ``classes`` fails the job, it isn't dropped."""
    known = F.coalesce(F.col(label).isin(list(classes)), F.lit(False))
    text = F.coalesce(F.col(label).cast("string"), F.lit("NULL"))
    unknown = F.raise_error(F.concat(F.lit("label not in the classes: "), text))
    return F.when(known, F.col(label)).otherwise(unknown).alias(label)


def class_weights(df: DataFrame, label: str = S.TARGET, classes: Sequence[int] = S.LEVELS) -> DataFrame:
    """Per class: rows and balanced weight n / (number of classes present * rows of class).

    Raises where a label is not in ``classes``.
    """
    counts = df.select(known_label(label, classes)).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # at most len(classes) rows
    return counts.withColumn(
        "weight",
        F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n")),
    )


def with_class_weight(
    df: DataFrame, label: str = S.TARGET, classes: Sequence[int] = S.LEVELS, weight: str = "weight",
) -> DataFrame:
    """Balanced weight on every row; the broadcast side has one row per listed class.

    Raises where a label is not in ``classes``, so no row is lost in the join.
    """
    weights = class_weights(df, label, classes).select(label, F.col("weight").alias(weight))
    return df.join(F.broadcast(weights), label)
