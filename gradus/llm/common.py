"""What the operators of this subpackage share: tables, held-out rows, ASCII case, hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose crc32 of the id's text leaves this remainder are never learnt from.
FOLDS, HELD_OUT = 5, 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_column: str) -> Column:
    """Whether a row is kept from training; a NULL id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def modest_batches(spark: SparkSession) -> None:
    """Whole texts are long: where the session has not set it, 2,000 rows (not 10,000) make an Arrow
    batch from now on, which keeps workers and their JVM small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, "2000")


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Two columns, ``doc_id`` and ``text`` (NULL: empty), whatever else the table holds."""
    modest_batches(docs.sparkSession)
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )


def ascii_lower(data: bytes) -> bytes:
    """``bytes.lower`` changes A-Z only, whatever the encoding of the rest."""
    return data.lower()


def mix64(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (xor-shift and odd multipliers), vectorised."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Memo(dict):
    """A dict that computes what it lacks and keeps the last ``limit`` to ``2 * limit`` entries."""

    def __init__(self, compute, limit: int = 150_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest, self.older = compute, limit, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """``doc_id, text, label`` of at most about ``bound`` labelled training rows.

    Where more rows are labelled, a hash of the id keeps an even share of them. Held-out rows
    and NULL labels are left out; a document labelled twice has its larger label. The kept
    labels are broadcast: their number is bounded, and the texts stay where they are.
    """
    ids = (
        labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    share = min(1.0, bound / max(1, ids.count()))
    chosen = ids.where(F.abs(F.xxhash64("doc_id") % 1_000_003) < int(share * 1_000_003))
    return texts(docs).join(F.broadcast(chosen), "doc_id")


def platt(values: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of the logistic curve through labelled values, with a mild ridge."""
    x, y = np.asarray(values, float), np.asarray(labels, float)
    w = np.ones_like(x) if weights is None else np.asarray(weights, float)
    design = np.stack([x, np.ones_like(x)], axis=1)
    fit, ridge = np.zeros(2), np.diag([1.0, 0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ fit, -30, 30)))
        gradient = design.T @ (w * (p - y)) + ridge @ fit
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, gradient)
        fit -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(fit[0]), float(fit[1])


def logistic(values: np.ndarray, slope: float, offset: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * np.asarray(values, float) + offset, -30, 30)))
