"""What-if station rows for batch scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus import schema as S
from gradus.operators.groups import mean_positions

# Slider ranges and defaults of the station form.
POWERS = tuple(range(0, 401, 10))
DEFAULTS = {
    "prise_type_ef": 0.0,
    "prise_type_2": 1.0,
    "prise_type_combo_ccs": 1.0,
    "prise_type_chademo": 0.0,
    "prise_type_autre": 0.0,
    "implantation_encoded": 0,
    "acces_libre": 1.0,
    "nbre_pdc": 4.0,
}


def whatif_grid(
    points: DataFrame, powers: Sequence[int] = POWERS, defaults: dict = DEFAULTS,
    group: str = S.GROUP,
) -> DataFrame:
    """One station per group and power level, in the feature contract.

    The values are exploded from a literal array beside each group, so the table grows with
    the groups only and nothing is joined.
    """
    fixed = {c: F.lit(v) for c, v in defaults.items()}
    rows = mean_positions(points, group).select(
        group, "latitude", "longitude",
        F.explode(F.array(*[F.lit(float(p)) for p in powers])).alias(S.POWER),
    )
    return rows.withColumns(fixed).select(group, "latitude", "longitude", *S.FEATURES)
