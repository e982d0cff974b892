"""Documents dealt to shards by balanced label propagation.

Linked documents should share a shard, and all shards should have the same number of rows. Every row
starts in a shard that a hash of its smallest neighbour names, so that small groups mostly start
together; neighbours of a row that has very many start evenly dealt. In each round, Spark joins bring every row the shards of its neighbours; a row whose
neighbours are more often elsewhere asks to go where most of them are. Only one half of the
rows, drawn anew each round, may ask, or else two linked rows would change places for ever. What
the shards have room for is worked out from the table of moves asked for (shards squared times
gains): within that quota the moves with the highest gain come first. At the end, rows with the
fewest neighbours beside them leave shards that are too full, so that counts are at most one apart.

Rows are numbered within shards without a task per shard: counts of small hash buckets are summed
up, and rows are ranked inside their bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.llm.common import table, texts
from gradus.session import write_out

SHARDS, ROUNDS = 8, 12
#: A shard may have so much more linked rows than its share of all rows while rows move.
SLACK = 0.0
#: A row with more neighbours than a shard's share over this doesn't name their first shard.
CROWDS = 64
#: Equal rows are linked over so many middle rows, which keeps the links of any one row few.
MIDDLES = 4096
#: Rows of a hash bucket in which rows are ranked, about; buckets of a small table.
BUCKET_ROWS, LEAST_BUCKETS = 20_000, 1024
#: Gains and kept links count up to this; beyond it they rank alike.
MOST = 15


def _hash(seed: str, *columns: str | Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _uniform(seed: str, column: str) -> Column:
    """A number in [0, 1) for each key."""
    return F.pmod(_hash(seed, column), F.lit(1 << 40)).cast("double") / float(1 << 40)


def equal_links(rows: DataFrame, key: str = "node", *same: str) -> DataFrame:
    """``a, b``: links that join all rows which agree in the columns ``same``, fewer than the rows.

    A group is dealt by hash to ``MIDDLES`` parts. The rows of a part are linked with its smallest
    key, and that one with the smallest of the group: a group with a third of all rows makes no row
    with more than some thousandths of them as neighbours, and no pairs within a group. Groups are
    found by minima before the shuffle; rows whose group has one row take part in no join.
    """
    part = F.pmod(_hash("part", key), F.lit(MIDDLES))
    parts = write_out(
        rows.groupBy(*same, part.alias("part")).agg(F.min(key).alias("middle"), F.count("*").alias("n")), "shards-parts"
    )
    groups = parts.groupBy(*same).agg(F.min("middle").alias("b"), F.sum("n").alias("n")).where("n > 1").drop("n")
    upper = parts.join(groups, list(same)).where("middle != b").select(F.col("middle").alias("a"), "b")
    wide = parts.where("n > 1").select(*same, "part", F.col("middle").alias("b"))
    lower = rows.withColumn("part", part).join(wide, [*same, "part"]).where(F.col(key) != F.col("b"))
    return upper.unionByName(lower.select(F.col(key).alias("a"), "b"))


def _room(asked: dict[tuple[int, int], int], load: list[int], most: int) -> dict[tuple[int, int], float]:
    """The share of the moves from s to t that may happen so that no shard gets more than ``most``.

    Moves out make room for moves in; what a shard can't take stays where it was, which may in
    turn leave another without room, so shares go down until all fit.
    """
    share = dict.fromkeys(asked, 1.0)
    for _ in range(200):
        calm = True
        for t in range(len(load)):
            gone = sum(n * share[k] for k, n in asked.items() if k[0] == t)
            come = sum(n * share[k] for k, n in asked.items() if k[1] == t)
            free = max(0.0, most - (load[t] - gone))
            if come > free + 1e-6:
                calm = False
                for k in asked:
                    if k[1] == t:
                        share[k] *= free / come
        if calm:
            break
    return share


def _neighbours(both: DataFrame, placed: DataFrame) -> DataFrame:
    """``node, shard, n``: how many neighbours of a row are in a shard."""
    there = placed.select(F.col("node").alias("b"), "shard")
    return both.join(there, "b").groupBy(F.col("a").alias("node"), "shard").agg(F.count("*").alias("n"))


def _round(number: int, linked: DataFrame, both: DataFrame, alone: list[int], most: int) -> tuple[DataFrame, int]:
    """``node, shard`` of the linked rows after a round, and how many of them moved."""
    votes = _neighbours(both, linked)
    liked = F.struct("n", _hash(f"like-{number}", "node", "shard").alias("tie"), F.col("shard").alias("to"))
    own = linked.select("node", F.col("shard").alias("at"))
    asks = votes.join(own, "node").groupBy("node").agg(
        F.first("at").alias("at"),
        F.max(liked).alias("best"),
        F.max(F.when(F.col("shard") == F.col("at"), F.col("n")).otherwise(0)).alias("kept"),
    )
    gain = F.least(F.col("best.n") - F.col("kept"), F.lit(MOST)).cast("int")
    turn = F.pmod(_hash(f"turn-{number}", "node"), F.lit(2)) == 0
    asks = write_out(
        asks.select("node", "at", F.col("best.to").alias("to"), F.when(turn, gain).otherwise(0).alias("gain")),
        "shards-asks",
    )
    load = list(alone)
    table_of_moves: dict[tuple[int, int], dict[int, int]] = {}
    # Shards squared times MOST rows at most.
    for r in asks.groupBy("at", "to", "gain").count().collect():
        load[r["at"]] += r["count"]
        if r["gain"] > 0:
            table_of_moves.setdefault((r["at"], r["to"]), {})[r["gain"]] = r["count"]
    share = _room({k: sum(v.values()) for k, v in table_of_moves.items()}, load, most)
    chance, moved = [], 0.0
    for key, gains in table_of_moves.items():
        left = sum(gains.values()) * share[key]
        for g in sorted(gains, reverse=True):
            part = min(1.0, left / gains[g])
            left -= part * gains[g]
            moved += part * gains[g]
            if part > 0:
                chance.append((F.struct(F.lit(key[0]), F.lit(key[1]), F.lit(g)), part))
    if moved < 1:
        return linked, 0
    pairs = [x for where, part in chance for x in (F.concat_ws("-", *[where[f"col{i}"] for i in (1, 2, 3)]), F.lit(part))]
    allowed = F.coalesce(F.create_map(*pairs)[F.concat_ws("-", "at", "to", "gain")], F.lit(0.0))
    goes = (F.col("gain") > 0) & (_uniform(f"go-{number}", "node") < allowed)
    return asks.select("node", F.when(goes, F.col("to")).otherwise(F.col("at")).alias("shard")), int(moved)


def numbered(rows: DataFrame, within: list[str], first: Column, key: str, total: int) -> DataFrame:
    """``rows`` with ``at``: their number from 0 within ``within``, smaller values of ``first`` first.

    Rows of equal ``first`` come in the order of a hash of ``key``. Buckets of the hash are counted
    and summed up (a row for each bucket, in a window over them), and rows are ranked in their bucket.
    """
    buckets = max(math.ceil(total / BUCKET_ROWS), min(LEAST_BUCKETS, 1 + total // 50))
    rows = rows.withColumns({"first": first, "bucket": F.pmod(_hash("number", key), F.lit(buckets))})
    spots = [*within, "first", "bucket"]
    before = Window.partitionBy(*within).orderBy("first", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*spots).agg(F.count("*").alias("n"))
    starts = counts.select(*spots, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy(*spots).orderBy(_hash("number", key), key))
    ranked = rows.withColumn("rank", rank)
    return ranked.join(starts, spots).withColumn("at", F.col("start") + F.col("rank") - 1).drop(
        "first", "bucket", "rank", "start"
    )


def level(placed: DataFrame, shards: int, total: int) -> DataFrame:
    """``node, shard, slot`` with counts at most one apart from a written ``node, shard, kept``.

    A shard keeps its rows with the most neighbours beside them; the others fill the free slots
    of the shards that have too few rows. Slots are gapless from 0 in every shard.
    """
    load = {s: 0 for s in range(shards)} | {
        r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()
    }
    fullest = sorted(load, key=lambda s: (-load[s], s))
    quota = {s: total // shards + (i < total % shards) for i, s in enumerate(fullest)}
    ranked = write_out(numbered(placed, ["shard"], -F.least("kept", F.lit(MOST)), "node", total), "shards-ranked")
    limit = F.create_map(*[F.lit(x) for s in quota for x in (s, quota[s])])[F.col("shard")]
    stays = ranked.where(F.col("at") < limit).select("node", "shard", F.col("at").alias("slot"))
    over = ranked.where(F.col("at") >= limit).select("node", F.lit(0).alias("all"))
    gaps, start = [], 0
    for s in sorted(load):
        if load[s] < quota[s]:
            gaps.append((s, start, load[s]))
            start += quota[s] - load[s]
    if not gaps:
        return stays
    goal, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s, begin, held in gaps:  # at most as many as shards; the last that begins before the row is its own
        goal = F.when(F.col("at") >= begin, F.lit(s)).otherwise(goal)
        slot = F.when(F.col("at") >= begin, F.col("at") - begin + held).otherwise(slot)
    moved = numbered(over, ["all"], F.lit(0), "node", start)
    return stays.unionByName(moved.select("node", goal.alias("shard"), slot.alias("slot")))


def propagate(
    nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK
) -> DataFrame:
    """``node, shard, slot`` for every row of ``nodes`` (``node``: a unique long).

    ``links`` (``a, b``) are undirected; they may repeat and count so often; a link of a row with
    itself is left out. Counts of rows are at most one apart, slots gapless from 0. An empty table
    gives an empty result. Each round is written to the shared folder; rounds end when fewer than a
    thousandth of the linked rows moved.
    """
    nodes = write_out(nodes.select("node"), "shards-nodes")
    total = nodes.count()
    most = math.ceil(total / shards * (1 + slack))
    links = links.where("a != b").select("a", "b")
    both = write_out(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "shards-links")
    least = F.least("a", F.min("b")).alias("low")
    smallest = write_out(both.groupBy("a").agg(least).select(F.col("a").alias("node"), "low"), "shards-lowest")
    n_linked = smallest.count()
    # At most shards times CROWDS rows.
    crowds = smallest.groupBy("low").count().where(F.col("count") > max(1, most // CROWDS)).select("low")
    by = F.when(F.col("crowd").isNull(), F.col("low")).otherwise(F.col("node"))
    named = smallest.join(F.broadcast(crowds.withColumn("crowd", F.lit(True))), "low", "left")
    shard = F.pmod(_hash("start", by), F.lit(shards)).cast("int")
    linked = write_out(named.select("node", shard.alias("shard")), "shards-start")
    single = nodes.join(linked, "node", "left_anti").withColumn(
        "shard", F.pmod(_hash("start", "node"), F.lit(shards)).cast("int")
    )
    single = write_out(single, "shards-single")
    # Rows without links have no wish; they make way for linked ones at the end.
    for number in range(rounds if n_linked else 0):
        linked, moved = _round(number, linked, both, [0] * shards, most)
        linked = write_out(linked, "shards-round")
        if moved <= n_linked // 1000:
            break
    kept = _neighbours(both, linked).join(linked, ["node", "shard"]).select("node", F.col("n").alias("kept"))
    placed = linked.join(kept, "node", "left").select("node", "shard", F.coalesce("kept", F.lit(0)).alias("kept"))
    placed = placed.unionByName(single.withColumn("kept", F.lit(0).cast("long")))
    return level(write_out(placed, "shards-placed"), shards, total)


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: every row of ``docs`` in a shard, equal texts linked.

    The size is the bytes of the text and one more; a NULL text has no bytes and equals an empty
    one. Rows are told apart by a key that is written with them, so identifiers may be NULL or
    repeat. Other columns are left out, whatever their names.
    """
    text = F.col("text").cast("binary")
    rows = texts(docs, id_column, text_column).select(
        F.monotonically_increasing_id().alias("node"),
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    rows = write_out(rows, "shards-rows")
    places = propagate(rows, equal_links(rows, "node", "digest"), shards, rounds)
    return rows.join(places, "node").select("doc_id", "size", "text_crc32", "shard", "slot")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.withColumns(
        {"law": F.lit("rows"), "slot": F.col("slot").cast("long"), "grown_shard": F.lit(None).cast("int")}
    )
