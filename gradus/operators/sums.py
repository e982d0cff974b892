"""One array summed over all rows of a table: the step of the iterative fits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial arrays that the driver adds up itself; more are summed by Spark.
FEW_PARTS = 32


def array_sum(
    rows: DataFrame, part: Callable[[pd.DataFrame], np.ndarray], size: int, parts: int | None = None,
) -> np.ndarray:
    """The sum of ``part`` over the Arrow batches of ``rows``: ``size`` numbers, whatever the rows.

    A task sums its batches. Where ``parts``, the number of tasks, is known to be small, their
    arrays are added up right away in the order of the tasks; else Spark sums them by position.
    """
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                own = part(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"sums": [np.ravel(total)]})

    partial = rows.mapInPandas(sums, "sums array<double>")
    out = np.zeros(size)
    if parts is not None and parts <= FEW_PARTS:
        for row in partial.collect():
            out += np.array(row["sums"])
        return out
    spread = partial.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s"))
    for row in spread.collect():  # one row for each of the numbers
        out[row["pos"]] = row["s"]
    return out
