"""Fill-in-middle transformation by a regular expression with counted quantifiers.

``regexp_count`` gives the number n of units (lines) of a text. Two cuts are drawn from a hash of
the identifier, and a pattern made for the row captures what lies around them in one match: a
possessive group of ``a`` units, one of ``b - a`` units, and the rest. The replacement of that
match writes the captured parts in their new order behind the markers. Possessive counted groups
are matched by a loop, without backtracking or a stack that grows with the text.

A text with a marker in it is left plain, so a marker in a transformed text is always ours, and
``restored`` can undo the transformation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import table, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED = "7"
#: Shares (of 100) of transformed texts, and of those with the suffix first.
RATE, SPM_RATE = 100, 50
UNIT = r"[^\n]*\n|[^\n]+"
#: The same unit without backtracking inside a line.
_POSSESSIVE = r"(?:[^\n]*+\n|[^\n]++)"


def draws(seed: str, key: Column) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed and key; a NULL key is empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(text: Column, a: Column, b: Column, form: Column) -> Column:
    """``text`` cut after ``a`` and after ``b`` units and written in the order of ``form``."""
    pattern = F.concat(
        F.lit(rf"(?s)\A({_POSSESSIVE}{{"),
        a.cast("string"),
        F.lit(rf"}}+)({_POSSESSIVE}{{"),
        (b - a).cast("string"),
        F.lit(r"}+)(.*+)\z"),
    )
    psm, spm = f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"
    order = F.when(form == SPM, F.lit(spm)).otherwise(F.lit(psm))
    return F.when(form == PLAIN, text).otherwise(F.regexp_replace(text, pattern, order))


def _part(output: Column, which: str, form: Column) -> Column:
    """Prefix, suffix or middle of a transformed text: its markers stand nowhere else in it."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", 4)
    at = {
        PREFIX: F.when(form == SPM, F.get(parts, 2)).otherwise(F.get(parts, 1)),
        SUFFIX: F.when(form == SPM, F.get(parts, 1)).otherwise(F.get(parts, 2)),
        MIDDLE: F.get(parts, 3),
    }
    return F.when(form != PLAIN, at[which])


def restored(output: Column, form: Column) -> Column:
    """The text that ``transformed`` was given, from its result and form alone."""
    whole = F.concat(*[_part(output, which, form) for which in (PREFIX, MIDDLE, SUFFIX)])
    return F.when(form == PLAIN, output).otherwise(whole)


def fill_in_middle(
    docs: DataFrame,
    seed: str = SEED,
    rate: int = RATE,
    spm_rate: int = SPM_RATE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, text, n, form, output, prefix_chars, middle_chars`` for every row of ``docs``.

    Narrow: one pass, no shuffle; memory is that of one text and its parts. ``rate`` and
    ``spm_rate`` are shares of 100. A NULL text is empty; empty texts and those with a marker are
    plain, and their counts of characters are NULL. A NULL identifier is drawn from as empty text;
    rows that repeat an identifier are cut by the same draws. An empty table gives an empty
    one; other columns are left out, whatever their names. A unit is a line with its line feed,
    or what follows the last one.
    """
    h1, h2, h3, h4 = draws(seed, F.col("doc_id"))
    text, n = F.col("text"), F.col("n")
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = (
        F.when((text == "") | marked | (h3 % 100 >= rate), PLAIN)
        .when(h4 % 100 < spm_rate, SPM)
        .otherwise(PSM)
    )
    cut = texts(docs, id_column, text_column).select(
        "doc_id", "text", F.regexp_count("text", F.lit(UNIT)).cast("long").alias("n"), form.alias("form"),
    )
    ends = [F.pmod(h, n + 1) for h in (h1, h2)]
    out = cut.withColumn(
        "output", transformed(text, F.least(*ends), F.greatest(*ends), F.col("form"))
    )
    chars = {
        f"{name}_chars": F.char_length(_part(F.col("output"), which, F.col("form"))).cast("long")
        for name, which in (("prefix", PREFIX), ("middle", MIDDLE))
    }
    return out.withColumns(chars)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, form = F.col("output"), F.col("form")
    return fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(out.cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(out, form).cast("binary"), 256).alias("restored_sha256"),
    )


OP11_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
         sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), c AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS c1,
         ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}')
                   OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= {RATE} THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS pre,
         array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS mid,
         array_to_string(u[greatest(c1, c2) + 1:], '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form != 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
              ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
