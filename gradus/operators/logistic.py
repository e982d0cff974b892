"""Multinomial logistic regression by Newton steps.

The loss is convex and has few parameters, so a handful of exact steps reaches its minimum: each
is one pass that sums the loss, its gradient and the blocks of its Hessian over all rows. The
driver solves a system of (features + 1) times classes equations. Scoring is SQL expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.decisions import argmax_class
from gradus.operators.sums import array_sum

INFO, TABLE = "logistic_info", "coefficients"
INTERCEPT = "(intercept)"
_COEFFICIENTS = "class int, feature string, mean double, deviation double, coefficient double"


def complete(features: Sequence[str]) -> Column:
    whole = F.lit(True)
    for c in features:
        value = F.col(f"`{c}`").cast("double")
        whole = whole & value.isNotNull() & ~F.isnan(value)
    return whole


def softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def _scaled(batch: pd.DataFrame, features: Sequence[str], means, deviations) -> np.ndarray:
    """Z-scores with a last column of ones."""
    x = (batch[list(features)].to_numpy(dtype=float) - means) / deviations
    return np.hstack([x, np.ones((len(x), 1))])


def newton(
    rows: DataFrame, features: Sequence[str], label: str, weight: str, classes: Sequence[int],
    means: np.ndarray, deviations: np.ndarray, ridge: float, total: float, max_iter: int,
    parts: int | None = None,
) -> np.ndarray:
    """Coefficients (classes x (features + 1)) where the summed weighted loss plus half the ridge
    on all but the intercepts is least."""
    k, d = len(classes), len(features) + 1
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    size = 1 + k * d + len(pairs) * d * d
    names, order = list(features), {c: i for i, c in enumerate(classes)}

    def passed(theta: np.ndarray):
        def part(batch: pd.DataFrame) -> np.ndarray:
            x = _scaled(batch, names, means, deviations)
            y, w = batch[label].map(order).to_numpy(), batch[weight].to_numpy(dtype=float)
            p = softmax(x @ theta.T)
            loss = -(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum()
            gradient = ((p - np.eye(k)[y]) * w[:, None]).T @ x
            blocks = [(x * (w * p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ x for i, j in pairs]
            return np.concatenate([[loss], gradient.ravel(), *[b.ravel() for b in blocks]])

        sums = array_sum(rows, part, size, parts)
        penalty = np.tile(np.append(np.full(d - 1, ridge), 0.0), k)
        flat = theta.ravel()
        loss = sums[0] + 0.5 * (penalty * flat**2).sum()
        gradient = sums[1:1 + k * d] + penalty * flat
        hessian = np.diag(penalty)
        for (i, j), block in zip(pairs, sums[1 + k * d:].reshape(-1, d, d)):
            hessian[i * d:(i + 1) * d, j * d:(j + 1) * d] += block
            if i != j:
                hessian[j * d:(j + 1) * d, i * d:(i + 1) * d] += block.T
        return loss, gradient, hessian

    theta, step, before = np.zeros((k, d)), None, np.inf
    for _ in range(max_iter):
        loss, gradient, hessian = passed(theta)
        if step is not None and loss > before + 1e-9 * abs(before):
            step = step / 2  # too far: back by half
            theta = theta - step
            continue
        if np.abs(gradient).max() <= 1e-7 + 1e-12 * total:
            break
        before = loss
        # Adding a constant to all intercepts changes nothing: the shortest solution leaves it out.
        step = -np.linalg.lstsq(hessian, gradient, rcond=1e-12)[0].reshape(k, d)
        theta = theta + step
    theta[:, -1] -= theta[:, -1].mean()
    return theta


class LogisticModel:
    """Coefficients on z-scores; a class that training lacked has probability 0."""

    def __init__(self, table: list[tuple], features: Sequence[str], classes: Sequence[int], policy: str):
        #: Rows (class, feature, mean, deviation, coefficient), the intercepts under a name of their own.
        self.table = [tuple(r) for r in table]
        self.features, self.classes, self.policy = list(features), list(classes), policy

    @classmethod
    def of(cls, theta: np.ndarray, present: Sequence[int], classes, features, means, deviations, policy):
        scale = [*zip(features, means, deviations), (INTERCEPT, 0.0, 1.0)]
        table = [
            (int(c), name, float(mean), float(deviation), float(value))
            for c, row in zip(present, theta)
            for (name, mean, deviation), value in zip(scale, row)
        ]
        return cls(table, features, classes, policy)

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """``class, feature, mean, deviation, coefficient``: a row for each, on z-scores."""
        return spark.createDataFrame(self.table, _COEFFICIENTS)

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probabilities`` and ``prediction``, by expressions in the same stage.

        A row with a missing feature fails the job; under the policy ``skip`` it stays, without
        either.
        """
        logits = {}
        for c, name, mean, deviation, value in self.table:
            term = F.lit(value)
            if name != INTERCEPT:
                term = (F.col(f"`{name}`").cast("double") - F.lit(mean)) / F.lit(deviation) * F.lit(value)
            logits[c] = logits[c] + term if c in logits else term
        zs = F.array(*[logits[c] for c in sorted(logits)])
        shares = F.transform(zs, lambda z: F.exp(z - F.array_max(zs)))
        order = sorted(logits)
        total = F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)
        every = F.array(*[F.get(shares, order.index(c)) / total if c in logits else F.lit(0.0) for c in self.classes])
        whole = complete(self.features)
        if self.policy == "skip":
            every = F.when(whole, every)
        else:
            every = F.when(whole, every).otherwise(F.raise_error(F.lit("a feature is missing")))
        winner = argmax_class(F.col("probabilities"))
        if self.classes != list(range(len(self.classes))):
            winner = F.get(F.array(*[F.lit(int(c)) for c in self.classes]), winner)
        return df.withColumn("probabilities", every).withColumn("prediction", winner)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.coefficients(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/{TABLE}")
        info = spark.createDataFrame(
            [(self.features, self.classes, self.policy)], "features array<string>, classes array<int>, policy string"
        )
        info.coalesce(1).write.mode("overwrite").parquet(f"{path}/{INFO}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LogisticModel:
        info = spark.read.parquet(f"{path}/{INFO}").first()
        rows = spark.read.schema(_COEFFICIENTS).parquet(f"{path}/{TABLE}").collect()  # classes x features
        return cls([tuple(r) for r in rows], info["features"], info["classes"], info["policy"])
