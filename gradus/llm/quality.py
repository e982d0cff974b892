"""Quality of texts by naive Bayes support vectors.

A text's features are indicators of n-grams: single words (hashed), n-grams of word shapes up to
three, and how much of the text each shape covers. Each indicator is scaled by its class
log-count ratio, and a linear hinge-loss model over the scaled indicators is fitted by dual
coordinate descent; a logistic curve turns margins into scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import (
    Memo,
    held_out,
    labelled_sample,
    logistic,
    modest_batches,
    platt,
    table,
    texts,
)
from gradus.session import write_out

#: Labelled rows that are learnt from, at most about so many.
FIT_ROWS = 20_000
#: Score from which a text is accepted.
ACCEPT = 0.3
SMOOTH, COST, EPOCHS = 1.0, 1.0, 20
#: The sample is dealt into so many shards, each with a dual problem of its own.
SHARDS = 4

#: Sizes of the feature families: words by hash, shapes, their pairs and triples, shares.
WORDS, SHAPES, SHARES = 1 << 16, 64, 8
AT = np.cumsum([0, WORDS, SHAPES, SHAPES**2, SHAPES**3, SHAPES * SHARES])
SIZE = int(AT[-1])
_REPEATED = SHAPES - 1
_TAIL = re.compile(r"[^\w\s]+$")


def _shape(word: str) -> int:
    """Case (3 values), digits (2), what ends the word (5): 30 shapes; those of symbols alone."""
    tail = _TAIL.search(word)
    marks = tail.group() if tail else ""
    body = word[: len(word) - len(marks)]
    if not body:
        return 30 + min(len(marks), 3)
    case = 0 if body == body.lower() else 2 if len(body) > 1 and body == body.upper() else 1
    digits = any(c.isdigit() for c in body)
    if not marks:
        end = 0
    elif len(marks) == 1:
        end = 1 if marks in ".,;:?!" else 2
    else:
        end = 3 if marks.strip(".,;:?!") == "" else 4
    return (case * 2 + digits) * 5 + end


def _word(word: str) -> int:
    """Hash and shape of a word in one number."""
    return (crc32(word.lower().encode("utf-8")) % WORDS) * SHAPES + _shape(word)


def indicators(text: str, memo: dict[str, int]) -> np.ndarray:
    """Sorted numbers of the features that the text has; none for a text without words."""
    words = text.split()
    if not words:
        return np.empty(0, dtype=np.int32)
    both = np.array([memo[word] for word in words], dtype=np.int64)
    shapes = both % SHAPES
    same = np.array([a == b for a, b in zip(words, words[1:], strict=False)], dtype=bool)
    shapes[1:][same] = _REPEATED
    found = [np.unique(both // SHAPES) + AT[0]]
    counts = np.bincount(shapes, minlength=SHAPES)
    present = np.flatnonzero(counts)
    found.append(present + AT[1])
    pairs = shapes[:-1] * SHAPES + shapes[1:]
    found.append(np.unique(pairs) + AT[2])
    found.append(np.unique(pairs[:-1] * SHAPES + shapes[2:]) + AT[3])
    # Each halving of the share is one indicator; a large share has those of the smaller ones too.
    reach = np.minimum(SHARES - 1, np.floor(-np.log2(counts[present] / len(words)))).astype(int)
    for shape, least in zip(present, reach, strict=True):
        found.append(AT[4] + shape * SHARES + np.arange(least, SHARES))
    return np.concatenate(found).astype(np.int32)


@dataclass
class Model:
    """Weights of the indicators (ratios multiplied in), and the curve from margin to score."""

    weights: np.ndarray
    offset: float
    curve: tuple[float, float]

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() / max(1.0, len(found)) ** 0.5 + self.offset)


def featured(rows: DataFrame) -> DataFrame:
    """``label, found`` of labelled texts."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(_word)
        for batch in batches:
            found = [indicators(text, memo) for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "found": found})

    return rows.mapInPandas(find, "doc_id long, label int, found array<int>")


def log_count_ratios(rows: DataFrame, smooth: float = SMOOTH) -> np.ndarray:
    """Log ratio of each indicator's smoothed share in either class, summed up by Spark.

    The driver gets one row per indicator: at most ``SIZE``, whatever the number of rows.
    """
    counts = (
        rows.select("label", F.explode("found").alias("i"))
        .groupBy("i")
        .agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("p"), F.count("*").alias("n"))
        .toPandas()
    )
    p, n = np.full(SIZE, smooth), np.full(SIZE, smooth)
    p[counts["i"]] += counts["p"]
    n[counts["i"]] += counts["n"] - counts["p"]
    ones = rows.where("label = 1").count()
    zeros = rows.where("label = 0").count()
    ratio = np.log(p / (ones + 2 * smooth)) - np.log(n / (zeros + 2 * smooth))
    ratio[(p == smooth) & (n == smooth)] = 0.0
    return ratio


def dual_descent(
    rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS
) -> tuple[np.ndarray, float]:
    """Weights and offset that minimise the squared norm plus ``cost`` times the hinge losses.

    Dual coordinate descent: one multiplier per row, between 0 and its cost, is set to its best
    value in turn, in a fixed random order. Rows have length 1; the rarer class costs as much as
    the other in sum.
    """
    y = np.where(labels == 1, 1.0, -1.0)
    ones = max(1, int((labels == 1).sum()))
    upper = np.where(labels == 1, cost, cost * max(1.0, ones / max(1, len(y) - ones)))
    values = [ratio[row] / max(1.0, len(row)) ** 0.5 for row in rows]
    square = np.array([v @ v + 1.0 for v in values])
    weights, offset, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(6)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (weights[rows[i]] @ values[i] + offset) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            if new != alpha[i]:
                change = (new - alpha[i]) * y[i]
                weights[rows[i]] += change * values[i]
                offset += change
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights * ratio, offset


def _descend(ratio: np.ndarray):
    def descend(shard: pd.DataFrame) -> pd.DataFrame:
        target = shard["label"].to_numpy()
        found = [np.asarray(row, dtype=np.int64) for row in shard["found"]]
        if len(set(target)) < 2:
            return pd.DataFrame({"i": [], "w": []}).astype({"i": "int32", "w": float})
        weights, offset = dual_descent(found, target, ratio)
        used = np.flatnonzero(weights)
        # The offset goes by the number behind the last indicator's.
        return pd.DataFrame(
            {"i": np.append(used, SIZE).astype("int32"), "w": np.append(weights[used], offset)}
        )

    return descend


def fit(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS, shards: int = SHARDS) -> Model:
    """The model of ``labels.quality`` from at most about ``bound`` labelled rows of ``docs``.

    The indicators of the bounded sample are written once. Their counts are a Spark aggregate;
    each shard of the sample is fitted by a task, and the shards' weights are averaged. Without
    rows of both classes every text gets the share of label 1 (0.5 without any row) as its score.
    """
    rows = write_out(featured(labelled_sample(docs, labels, "quality", bound)), "quality-rows")
    by_label = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    ones, zeros = by_label.get(1, 0), by_label.get(0, 0)
    neutral = Model(np.zeros(SIZE, np.float32), 0.0, (0.0, 0.0))
    if not ones or not zeros:
        share = 0.5 if not ones + zeros else float(ones > 0)
        neutral.curve = (0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
        return neutral
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(shards)))
    parts = dealt.groupBy("shard").applyInPandas(_descend(log_count_ratios(rows)), "i int, w double")
    parts = write_out(parts, "quality-weights")
    fitted = parts.where(F.col("i") == SIZE).count()
    if not fitted:
        return neutral
    mean = parts.groupBy("i").agg((F.sum("w") / fitted).alias("w")).toPandas()
    weights = np.zeros(SIZE + 1, np.float32)
    weights[mean["i"]] = mean["w"]
    model = Model(weights[:SIZE], float(weights[SIZE]), (1.0, 0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    margin = F.pandas_udf(
        lambda found: found.map(lambda row: shared.value.margin(np.asarray(row, dtype=np.int64))),
        "double",
    )
    # Margins in hundredths, by label: the driver gets a short table.
    levels = rows.select(F.round(margin("found"), 2).alias("level"), "label")
    levels = levels.groupBy("level", "label").agg(F.count("*").alias("n"))
    levels = levels.orderBy("level", "label").toPandas()
    model.curve = platt(levels["level"], levels["label"], levels["n"])
    return model


def score(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """``doc_id, held_out, score, predicted, margin`` of every row of ``docs``.

    Narrow: one pass, the model (fixed size) goes to the workers. A NULL text is empty; a text
    without words gets the score of the offset alone; a NULL id counts as held out; repeated
    rows get equal scores; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, fitted = Memo(_word), shared.value
        for batch in batches:
            margins = np.array([fitted.margin(indicators(text, memo)) for text in batch["text"]])
            scores = logistic(margins, *fitted.curve)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "held_out": batch["held_out"],
                    "score": scores,
                    "predicted": (scores >= accept).astype("int32"),
                    "margin": margins,
                }
            )

    rows = texts(docs).withColumn("held_out", held_out("doc_id"))
    return rows.mapInPandas(
        judge, "doc_id long, held_out boolean, score double, predicted int, margin double"
    )


def accepted(
    docs: DataFrame, model: Model, accept: float = ACCEPT, text_column: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose text the model accepts, all columns as they were."""
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo, fitted = Memo(_word), shared.value
        for batch in series:
            margins = np.array([fitted.margin(indicators(text, memo)) for text in batch])
            yield pd.Series(logistic(margins, *fitted.curve) >= accept)

    return docs.where(good(F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
