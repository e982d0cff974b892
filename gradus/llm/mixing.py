"""Sources mixed to target weights by Poisson replication.

A source's mean repetition rate is its target weight times the rows wanted, over its rows. Each
row's count is the inverse of the Poisson distribution with that mean at a uniform number made
from a hash of seed and identifier: the same row gets the same count in any run, on any
partitioning. Rows are exploded by their count and dealt anew by a hash of row and copy, and
sorted by it within partitions: a global shuffle without hot keys, whatever source or rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import table
from gradus.session import write_out

SEED = "mix"
#: Without weights, a source's weight is its number of rows to this power: 1 keeps the mix, 0 evens it.
ALPHA = 0.5
#: A mean is the sum of parts up to this one, so that exp(-mean) is never 0.
PART = 32.0
#: A part's distribution reaches 1 in double precision before so many terms.
TERMS = 128


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the parts, NULL as empty text."""
    text = F.concat_ws(":", *[F.coalesce(part.cast("string"), F.lit("")) for part in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def inverse_poisson(mean: Column, u: Column) -> Column:
    """The smallest k whose cumulative probability is above ``u``.

    One sum per row: the terms stop counting once the sum has passed ``u``.
    """
    start = F.struct(
        F.exp(-mean).alias("term"), F.exp(-mean).alias("total"), F.lit(0).alias("k")
    )

    def step(state: Column, i: Column) -> Column:
        more = state["total"] <= u
        term = state["term"] * mean / i
        return F.when(
            more, F.struct(term.alias("term"), (state["total"] + term).alias("total"), i.alias("k"))
        ).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["k"])


def poisson_count(mean: Column, *key: Column) -> Column:
    """The Poisson count of a row: the sum over equal parts of the mean, each with its own hash."""
    parts = F.greatest(F.lit(1), F.ceil(mean / PART)).cast("int")
    counts = F.transform(
        F.sequence(F.lit(1), parts), lambda j: inverse_poisson(mean / parts, uniform(*key, j))
    )
    # A first look at the lowest outcomes spares most rows the sum.
    first = uniform(*key, F.lit(1))
    none = F.exp(-mean)
    return (
        F.when((parts == 1) & (first < none), 0)
        .when((parts == 1) & (first < none + none * mean), 1)
        .otherwise(F.aggregate(counts, F.lit(0), lambda a, b: a + b))
    )


def rates(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    total: int | None = None,
    alpha: float = ALPHA,
    source_column: str = "source",
) -> DataFrame:
    """``source, rows, rate`` of every source; a NULL source is a source of its own.

    ``weights`` by source need not sum to 1; a source that they lack gets none. ``total``: rows
    wanted in all, by default as many as there are.
    """
    sources = docs.groupBy(F.col(source_column).cast("string").alias("source")).agg(
        F.count("*").alias("rows")
    )
    if weights is None:
        wanted = F.pow(F.col("rows").cast("double"), F.lit(float(alpha)))
    else:
        if any(w < 0 for w in weights.values()) or not sum(weights.values()):
            raise ValueError("weights must not be negative, nor all 0")
        pairs = [x for name, w in weights.items() for x in (F.lit(name), F.lit(float(w)))]
        wanted = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0))
    sources = write_out(sources.withColumn("wanted", wanted), "mixing-sources")
    all_wanted, all_rows = sources.agg(F.sum("wanted"), F.sum("rows")).first()
    goal = float(total if total is not None else all_rows or 0)
    share = F.col("wanted") / F.lit(float(all_wanted or 1))
    return sources.select("source", "rows", (F.lit(goal) * share / F.col("rows")).alias("rate"))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    total: int | None = None,
    alpha: float = ALPHA,
    seed: str = SEED,
    id_column: str = "doc_id",
    source_column: str = "source",
) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, in a global random order.

    All columns stay as they are; ``copy`` (from 1), ``copies`` and ``order_key`` come behind
    them under names that the table lacks (a clash gets underscores in front). Rows with the
    same identifier get the same count; a NULL identifier hashes as empty text; a NULL source is
    mixed as a source of its own. An empty table gives an empty one. Sources whose rate is 0 go.
    """
    table_rates = write_out(rates(docs, weights, total, alpha, source_column), "mixing-rates")
    copy, copies, order, rate, name = (free_name(docs, x) for x in ("copy", "copies", "order_key", "rate", "source"))
    lookup = table_rates.select(
        F.col("source").alias(f"__{name}"), F.col("rate").alias(f"__{rate}")
    )
    # Sources are few rows, read back from a written table: Spark broadcasts them by their size,
    # or else splits a hot source at run time.
    key = docs[f"`{source_column}`"].cast("string")
    counted = (
        docs.join(lookup, key.eqNullSafe(lookup[f"__{name}"]))
        .withColumn(
            copies,
            poisson_count(F.col(f"__{rate}"), F.lit(seed), F.col(f"`{id_column}`")).cast("int"),
        )
        .where(F.col(copies) > 0)
    )
    out = counted.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    out = out.withColumn(
        order,
        F.md5(
            F.concat_ws(
                ":",
                F.lit(f"{seed}-order"),
                F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")),
                F.col(copy).cast("string"),
            )
        ),
    ).select(*[docs[f"`{c}`"] for c in docs.columns], copy, copies, order)
    # Rows without an identifier share their keys; a hash of the row spreads them.
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    spread = F.when(F.col(f"`{id_column}`").isNull(), F.xxhash64(*hashed)).otherwise(F.lit(0))
    return out.repartition(F.col(order), spread).sortWithinPartitions(order)


def free_name(docs: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as make it new."""
    taken = {column.lower() for column in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows are shuffled; the columns that tell the mix are returned."""
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "copy", "copies", "order_key", F.md5("text").alias("text_md5")
    )


OP1_SQL = f"""
WITH RECURSIVE s AS (
  SELECT source, count(*) AS rows, pow(count(*)::DOUBLE, {ALPHA}) AS wanted FROM documents GROUP BY source
), r AS (
  SELECT source, (SELECT sum(rows)::DOUBLE FROM s) * (wanted / (SELECT sum(wanted) FROM s)) / rows AS rate FROM s
), p AS (
  SELECT source, rate, greatest(1, ceil(rate / {PART}))::INTEGER AS parts FROM r
), c AS (
  SELECT source, rate / parts AS mean, parts, 0 AS k, exp(-rate / parts) AS term, exp(-rate / parts) AS total FROM p
  UNION ALL
  SELECT source, mean, parts, k + 1, term * mean / (k + 1), total + term * mean / (k + 1) FROM c WHERE k < {TERMS}
), l AS (
  SELECT source, any_value(parts) AS parts, list(total ORDER BY k) AS totals FROM c GROUP BY source
), d AS (
  SELECT doc_id, d.source, text, l.totals, unnest(range(1, parts + 1)) AS j
  FROM documents d JOIN l ON d.source IS NOT DISTINCT FROM l.source
), u AS (
  SELECT doc_id, source, text,
         len(list_filter(totals, lambda x: x <= (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || j), 1, 13))::BIGINT / {float(1 << 52)}))) AS n
  FROM d
), n AS (
  SELECT doc_id, any_value(source) AS source, any_value(text) AS text, sum(n)::INTEGER AS copies FROM u GROUP BY doc_id
), e AS (
  SELECT *, unnest(range(1, copies + 1))::INTEGER AS copy FROM n
)
SELECT doc_id, source, copy, copies,
       md5('{SEED}-order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS order_key, md5(text) AS text_md5
FROM e
"""
