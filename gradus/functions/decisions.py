"""Decision rules on a class-probability array column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax_class(probabilities: Column) -> Column:
    """Index of the largest probability; the first one wins a tie."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def best_other_class(probabilities: Column) -> Column:
    """Index of the largest probability when class 0 is left out; the first one wins a tie."""
    rest = F.slice(probabilities, 2, F.size(probabilities) - 1)
    return F.array_position(rest, F.array_max(rest)).cast("int")


def threshold_class(probabilities: Column, threshold: Column | float) -> Column:
    """Class 0 from ``threshold`` upwards, else the most probable of the other classes."""
    return F.when(probabilities[0] >= threshold, F.lit(0)).otherwise(
        best_other_class(probabilities)
    )
