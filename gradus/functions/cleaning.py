"""Column expressions that turn messy text into numbers. No action, no Python per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradus.schema import MISSING_TEXT, UNKNOWN_CODE

# What counts as a number: decimal or exponent form, or infinity, blanks around it allowed.
# ``try_cast`` alone is too generous: it also takes a type suffix such as '1d'.
NUMERIC_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def text_or_null(col: Column) -> Column:
    """NULL for the cell texts that mean "missing" in the registry's CSV files."""
    return F.when(~col.isin(MISSING_TEXT), col)


def nan_as_null(col: Column, kind: str) -> Column:
    """NULL in place of NaN; ``kind`` is the column's type name, others than floats stay as is."""
    return F.nanvl(col, F.lit(None).cast(kind)) if kind in ("double", "float") else col


def numeric_or_null(col: Column) -> Column:
    """Lenient numeric cast: text that is not a plain number becomes NULL, as does NaN."""
    text = col.cast("string")
    return F.when(text.rlike(NUMERIC_PATTERN), F.trim(text).try_cast("double"))


def flag_from_text(col: Column) -> Column:
    """1.0 for 'true' in any case, 0.0 for everything else: no trimming, NULL counts as 0.0."""
    return F.when(F.lower(col.cast("string")) == "true", 1.0).otherwise(0.0)


def ordinal_code(col: Column, codes: Mapping[str, int], unknown: int = UNKNOWN_CODE) -> Column:
    """Code of an exactly matching text; ``unknown`` for any other text and for NULL."""
    entries = [F.lit(x) for pair in codes.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), col), F.lit(unknown)).cast("int")


def contains_flag(col: Column, needle: str) -> Column:
    """1.0 where the lower-cased text contains ``needle``; NULL counts as 0.0."""
    return F.coalesce(F.lower(col).contains(needle), F.lit(False)).cast("double")


def name_of(col: Column, names: Mapping[int, str]) -> Column:
    """Display name of a code, NULL for codes without a name."""
    entries = [F.lit(x) for pair in names.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), col)
