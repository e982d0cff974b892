"""Exploratory profile: counts, missing values, shares, describe, histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.cleaning import nan_as_null

KEEP = 10_000  # distinct values of one bracket that the driver may get


def scan_profile(df: DataFrame, distinct: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """One row: rows, columns and the distinct non-null values of chosen columns.

    Each exact count is a grouped one of its own column, so no row is copied per column;
    ``approximate`` takes sketches of all columns in one pass instead.
    """

    def values(c: str) -> Column:
        if approximate:
            return F.approx_count_distinct(F.col(c))
        return df.select(c).distinct().agg(F.count(F.col(c))).scalar()

    counts = {f"n_{c}": values(c) for c in distinct}
    out = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("int").alias("n_columns"),
        *[v.alias(name) for name, v in counts.items() if approximate],
    )
    return out if approximate else out.withColumns(counts) if counts else out


def preview(df: DataFrame, order: str, n: int = 3) -> DataFrame:
    return df.orderBy(order).limit(n)


def null_profile(df: DataFrame) -> DataFrame:
    """Columns that have missing values (NaN too) and how many, most first; one pass over the data."""
    kinds = dict(df.dtypes)
    counts = df.agg(*[F.count_if(nan_as_null(F.col(c), kinds[c]).isNull()).alias(c) for c in df.columns])
    return (
        counts.unpivot([], df.columns, "column_name", "n_missing")
        .filter("n_missing > 0")
        .orderBy(F.desc("n_missing"), "column_name")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value, most first."""
    return (
        df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")
    )


def value_shares(df: DataFrame, column: str, width: int = 30) -> DataFrame:
    """Value counts with their share of all non-null rows and a shortened display text.

    The total is a scalar subquery, so the values are never gathered into one window.
    """
    present = df.filter(F.col(column).isNotNull())
    counts = present.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(
        "value",
        F.substring(F.col("value").cast("string"), 1, width).alias("display"),
        "n",
        (F.col("n") / total).alias("share"),
    )


def flag_totals(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Sum of each 0/1 column as one row per column, under its display name."""
    sums = df.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).cast("bigint").alias(n) for c, n in names.items()])
    return sums.unpivot([], list(names.values()), "name", "total")


def histogram(
    df: DataFrame, value: Column, bins: int, by: Sequence[str] = (),
) -> DataFrame:
    """Equal-width histogram: ``bin`` (0-based), its edges and ``n``; the last bin is closed.

    A value sits in the bin whose stored edges hold it, also where the division that finds
    the bin rounds the other way. With ``by`` all groups share the edges. Without it, empty
    bins are listed too.
    """
    x = nan_as_null(value.cast("double"), "double")
    data = df.select(*by, x.alias("x")).filter(F.col("x").isNotNull())
    lo, hi = F.min("x"), F.max("x")
    flat = lo == hi
    span = data.agg(
        F.struct(
            F.when(flat, lo - 0.5).otherwise(lo).alias("lo"),
            F.when(flat, hi + 0.5).otherwise(hi).alias("hi"),
        ).alias("span")
    )
    ranged = data.withColumn("span", span.scalar())
    lo, hi = F.col("span.lo"), F.col("span.hi")
    step = (hi - lo) / F.lit(float(bins))

    def edge(i: Column) -> Column:
        return F.when(i == bins, hi).otherwise(i * step + lo)

    guess = F.least(F.floor((F.col("x") - lo) / (hi - lo) * bins), F.lit(bins - 1))
    binned = ranged.withColumn("guess", guess).withColumn(
        "bin",
        (
            F.col("guess")
            - F.when(F.col("x") < edge(F.col("guess")), 1).otherwise(0)
            + F.when(
                (F.col("x") >= edge(F.col("guess") + 1)) & (F.col("guess") < bins - 1), 1
            ).otherwise(0)
        ).cast("int"),
    )
    counts = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    if by:
        rows = counts.withColumn("span", span.scalar())
    else:
        every_bin = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
        rows = every_bin.withColumn("span", span.scalar()).join(counts, "bin", "left")
    return rows.select(
        *by,
        "bin",
        edge(F.col("bin")).alias("low"),
        edge(F.col("bin") + 1).alias("high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def exact_quantiles(
    df: DataFrame, column: str, probabilities: Sequence[float], keep: int = KEEP, accuracy: int = 10_000,
) -> list[float | None]:
    """Quantiles with linear interpolation, exact at any size; NaN counts as missing.

    A sketch brackets every needed rank at once: its rank error is known, so the bracket surely
    holds the rank. The next pass counts what is below and inside each bracket and sketches the
    inside again. Once a bracket has few distinct values, they are fetched with their counts. A
    pass cuts brackets to some 4/``accuracy`` of their rows whatever the values, so a handful of
    passes do for any table. The driver gets at most ``keep`` values a bracket.
    """
    x = nan_as_null(F.col(column).cast("double"), "double")
    values = df.select(x.alias("x")).filter("x is not null")
    n, low, high = values.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if n == 0:
        return [None] * len(probabilities)
    wanted = set()
    for q in probabilities:
        i = int(q * (n - 1))
        wanted |= {i, min(i + 1, n - 1)}
    found = _values_at(values, sorted(wanted), n, low, high, keep, accuracy)
    out = []
    for q in probabilities:
        h = q * (n - 1)
        i = int(h)
        a, b = found[i], found[min(i + 1, n - 1)]
        out.append(a if a == b else (i + 1 - h) * a + (h - i) * b)
    return out


def _values_at(values, ranks, n, low, high, keep, accuracy) -> dict[int, float]:
    """Value at each 0-based rank. A round is one pass that sketches the inside of every bracket
    and one that counts the new brackets; brackets of few distinct values take one fetch."""
    # A bracket that its sketch can't cut any more has a few rows, or ties and a few values.
    keep = max(keep, 4 + 8 * 10_000 // accuracy)
    brackets = {rank: (0, n, low, high) for rank in ranks}  # rows below, rows inside, ends
    found: dict[int, float] = {}
    while brackets:
        sketches = []
        for rank, (below, size, lo, hi) in brackets.items():
            inside = F.when(F.col("x").between(lo, hi), F.col("x"))
            place, slack = (rank - below) / size, 2.0 / accuracy + 1.0 / size
            ends = [max(0.0, place - slack), min(1.0, place + slack)]
            sketches += [F.approx_count_distinct(inside, 0.02), F.percentile_approx(inside, ends, accuracy)]
        row = values.agg(*sketches).first()
        sketched = {rank: (row[2 * i], row[2 * i + 1]) for i, rank in enumerate(brackets)}
        few = {rank: b for rank, b in brackets.items() if sketched[rank][0] <= 0.8 * keep}
        found.update(_fetched(values, few))
        open_ranks = [rank for rank in brackets if rank not in few]
        if not open_ranks:
            break
        counts = values.agg(
            *[
                count
                for rank in open_ranks
                for lo, hi in [sketched[rank][1]]
                for count in (F.count_if(F.col("x") < lo), F.count_if(F.col("x").between(lo, hi)))
            ]
        ).first()
        brackets = {}
        for i, rank in enumerate(open_ranks):
            below, size, (lo, hi) = counts[2 * i], counts[2 * i + 1], sketched[rank][1]
            if not below <= rank < below + size:
                raise ArithmeticError("a sketch missed a rank by more than its error")
            if lo == hi:
                found[rank] = float(lo)
            else:
                brackets[rank] = (below, size, lo, hi)
    return found


def _fetched(values, brackets) -> dict[int, float]:
    """Value at each rank whose bracket has few distinct values: they come with their counts."""
    if not brackets:
        return {}
    inside = F.lit(False)
    for _, _, lo, hi in set(brackets.values()):
        inside = inside | F.col("x").between(lo, hi)
    rows = sorted(tuple(r) for r in values.filter(inside).groupBy("x").count().collect())
    out = {}
    for rank, (below, _, lo, hi) in brackets.items():
        at = below
        for x, count in rows:
            if lo <= x <= hi:
                at += count
                if rank < at:
                    out[rank] = float(x)
                    break
    return out


def describe(df: DataFrame, column: str, keep: int = KEEP) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max of one numeric column, without NaN."""
    x = nan_as_null(F.col(column).cast("double"), "double")
    n, mean, deviation, low, high = df.agg(
        F.count(x), F.avg(x), F.stddev_samp(x), F.min(x), F.max(x)
    ).first()
    quartiles = exact_quantiles(df, column, (0.25, 0.5, 0.75), keep)
    return df.sparkSession.createDataFrame(
        [(n, mean, deviation, low, *quartiles, high)],
        "count bigint, mean double, std double, min double, p25 double, p50 double, p75 double, max double",
    )
