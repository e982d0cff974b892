"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.session import write_out


def _lowest(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("low"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, root``: every id in a link with the smallest id that it reaches, itself included.

    Links are undirected, may repeat and may join an id to itself. A round hangs every id's
    larger neighbours under its lowest one, then its smaller ones; links never get more, and the
    rounds are about the logarithm of the longest path. Minima are found before the shuffle; an
    id with very many links is one key of a join whose larger side Spark splits at run time.
    Each round is written to the shared folder, so a lost executor costs one round.
    """
    ends = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    high, low = F.greatest("a", "b"), F.least("a", "b")
    stars = write_out(ends.select(high.alias("a"), low.alias("b")).distinct(), "links")
    before = None
    while True:
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.join(_lowest(both), "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        )
        # Links now go from the larger to the smaller end; a self-link marks a root alone.
        large = write_out(large.unionByName(stars.where("a = b")).distinct(), "links-large")
        small = large.join(_lowest(large), "a")
        moved = small.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        stars = write_out(
            moved.unionByName(large.join(_lowest(large), "a").select("a", F.col("low").alias("b"))).distinct(),
            "links",
        )
    roots = stars.select(F.col("b").alias("id")).distinct().withColumn("root", F.col("id"))
    below = stars.where("a != b").select(F.col("a").alias("id"), F.col("b").alias("root"))
    return below.unionByName(roots.join(below.select("id"), "id", "left_anti"))
