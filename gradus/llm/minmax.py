"""Near-duplicate documents by min-max hashing, every link confirmed on the full sets.

Under each permutation of the hashed shingles both the least and the greatest value are kept:
half as many hash evaluations as for minima alone. Bands of four values give the candidates.
Documents with equal sets are one class from the start. In each bucket of a band every class is
compared with one hub, the class that meets most others; classes that are then still outside
the hub's component are compared with all of the bucket, in blocks of bounded size. So whatever
shares a bucket is compared, or connected already, and no group's pairs are ever listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import Memo, ascii_lower, mix64, modest_batches, table
from gradus.llm.graph import components
from gradus.session import write_out

#: Words in a shingle and least similarity (per cent) unless a caller says otherwise.
WORDS, PERCENT = 5, 80
#: Bands and the permutations of each; a permutation gives two values. A pair with similarity
#: 0.8 has no band in common once in some millions of cases.
BANDS, EACH = 30, 2
#: Shingles in a block of a bucket, at most (but for a single longer document).
BLOCK = 1_000_000
#: Rows of (id, set digest) that may be broadcast to find the texts of candidates: 40 bytes each.
BROADCAST_ROWS = 500_000

# A permutation of 32 bits is an odd factor, a shift and another factor; 32 bits are enough for
# candidates, and half the work of 64.
_ODD = (mix64(np.arange(1, BANDS * EACH + 1)) | np.uint64(1)).astype(np.uint32).reshape(-1, 1)


def shingles(text: bytes, words: int, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles.

    Words are what blanks (space, tab, line ends, vertical tab, form feed) part, A-Z lowered. A
    text with fewer words than a shingle is one shingle; one without words has none.
    """
    parts = ascii_lower(text).split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    hashes = np.array([memo[part] for part in parts], dtype=np.uint64)
    size = min(words, len(parts))
    out = hashes[: len(parts) - size + 1]
    for i in range(1, size):
        out = mix64(out + np.uint64(i)) + hashes[i : len(parts) - size + 1 + i]
    return np.unique(mix64(out + np.uint64(size)))


def word_memo() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def signature(found: np.ndarray) -> np.ndarray:
    """Least and greatest value of the set under each permutation: two columns."""
    short = found.astype(np.uint32)
    low = np.full(len(_ODD), np.iinfo(np.uint32).max, dtype=np.uint32)
    high = np.zeros(len(_ODD), dtype=np.uint32)
    for at in range(0, len(found), 4096):
        x = short[None, at : at + 4096] * _ODD
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return np.stack([low, high], axis=1).astype(np.uint64)


def buckets(found: np.ndarray) -> np.ndarray:
    """One number per band, from the least and greatest values of its permutations."""
    values = signature(found).reshape(BANDS, EACH * 2)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in values.T:
        out = mix64(out + column)
    return out.view(np.int64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, digest, n_shingles, node, buckets`` of ``doc_id, text, digest`` rows; node is a
    digest of the set, NULL for an empty one."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = word_memo()
        for batch in batches:
            sets = [shingles(text, words, memo) for text in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "digest": batch["digest"],
                    "n_shingles": [len(x) for x in sets],
                    "node": [_digest(x) if len(x) else None for x in sets],
                    "buckets": [buckets(x) if len(x) else [] for x in sets],
                }
            )

    return docs.mapInPandas(
        sketch, "doc_id long, digest long, n_shingles long, node binary, buckets array<long>"
    )


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def full_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``node, found``: the shingles of each class in ``nodes`` (``node, rep``), from the text of
    its smallest document."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = word_memo()
        for batch in batches:
            sets = [shingles(text, words, memo) for text in batch["text"]]
            keep = [i for i, x in enumerate(sets) if len(x) and _digest(x) == batch["node"][i]]
            yield pd.DataFrame(
                {
                    "node": [batch["node"][i] for i in keep],
                    "found": [sets[i].view(np.int64) for i in keep],
                }
            )

    wanted = nodes.select(F.col("rep").alias("doc_id"), "node")
    if nodes.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = docs.join(wanted, "doc_id").select("node", "text")
    # Repeated rows of one id would repeat a set.
    return rows.mapInPandas(expand, "node binary, found array<long>")


def _similar(shared, of_a, of_b, percent: int):
    return 100 * shared >= percent * (of_a + of_b - shared)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a, b`` nodes and more columns) whose full sets are similar."""
    left = sets.select(F.col("node").alias("a"), F.col("found").alias("found_a"))
    right = sets.select(F.col("node").alias("b"), F.col("found").alias("found_b"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("found_a", "found_b"))
    return both.where(_similar(shared, F.size("found_a"), F.size("found_b"), percent)).drop(
        "found_a", "found_b"
    )


def _compare(percent: int):
    """Links across components between the two sides of a block pair; one for each row and
    component that it meets."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        one = group[group["side"] != 1].reset_index(drop=True)
        two = group[group["side"] != 0].reset_index(drop=True)
        out: list[tuple[int, int]] = []
        if len(one) and len(two):
            tokens = np.concatenate(two["found"].to_list())
            sizes = np.array([len(x) for x in two["found"]])
            owner = np.repeat(np.arange(len(two)), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            comps, reps = two["comp"].to_numpy(), two["rep"].to_numpy()
            for found, comp, rep in zip(one["found"], one["comp"], one["rep"], strict=True):
                start = np.searchsorted(tokens, found, "left")
                length = np.searchsorted(tokens, found, "right") - start
                # Places of all postings: each run's start, then steps of one.
                places = np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())
                shared = np.bincount(owner[places], minlength=len(two))
                good = _similar(shared, len(found), sizes, percent) & (comps != comp)
                met = np.flatnonzero(good)
                if len(met):
                    _, first = np.unique(comps[met], return_index=True)
                    out += [(rep, reps[met[i]]) for i in first]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return compare


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with ``comp``: the root of ``rep``, or ``rep`` itself."""
    found = rows.join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    return found.withColumn("comp", F.coalesce("root", "rep")).drop("root")


def bucket_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links of ``members`` (``bucket, node, rep, n``) that connect all similar pairs
    which share a bucket."""
    popular = members.groupBy("node").agg(F.sum("size").alias("meets"))
    ranked = write_out(members.join(popular, "node"), "near-members")
    hub = F.max(F.struct("meets", "node", "rep", "n")).alias("hub")
    hubs = write_out(ranked.groupBy("bucket").agg(hub, F.count("*").alias("size")), "near-hubs")
    pairs = (
        ranked.drop("size")
        .join(hubs, "bucket")
        .where("node != hub.node")
        # Sizes alone rule a pair out.
        .where(f"100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)")
        .select(
            F.col("node").alias("a"),
            F.col("hub.node").alias("b"),
            F.col("rep").alias("rep_a"),
            F.col("hub.rep").alias("rep_b"),
        )
        .distinct()
    )
    first = write_out(
        confirm(pairs, sets, percent).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")),
        "near-first",
    )
    roots = write_out(components(first), "near-roots")
    # What is not in its bucket's hub's component is minor; it meets everything else there but
    # the hub, which it has met.
    open_rows = _labelled(ranked.select("bucket", "node", "rep", "n"), roots)
    hub_comp = _labelled(
        hubs.select("bucket", F.col("hub.rep").alias("rep"), F.col("hub.node").alias("hub")), roots
    ).select("bucket", "hub", F.col("comp").alias("hub_comp"))
    open_rows = open_rows.join(hub_comp, "bucket").where("node != hub")
    open_rows = open_rows.withColumn("minor", F.col("comp") != F.col("hub_comp"))
    open_rows = write_out(open_rows.drop("hub", "hub_comp"), "near-open")
    blocks = open_rows.groupBy("bucket").agg(
        F.count_if(F.col("minor")).alias("minor_rows"),
        F.count("*").alias("all_rows"),
        F.ceil(F.sum(F.when(F.col("minor"), F.col("n"))) / BLOCK).cast("int").alias("minors"),
        F.ceil(F.sum(F.when(~F.col("minor"), F.col("n"))) / BLOCK).cast("int").alias("majors"),
    )
    blocks = blocks.where("minor_rows > 0 and all_rows > 1").drop("all_rows")
    rows = open_rows.join(blocks, "bucket").withColumn(
        "own", F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))).cast("int")
    )
    # Sides: 0 is compared with 1; 2 stands on both sides of a block against itself.
    others = F.sequence(F.lit(0), F.col("minors") - 1)

    def place(i, j, side, kind):
        return F.struct(i.alias("i"), j.alias("j"), side.cast("int").alias("side"), F.lit(kind).alias("kind"))

    none = F.array().cast("array<struct<i:int,j:int,side:int,kind:int>>")
    among = F.transform(
        others,
        lambda j: place(
            F.least(F.col("own"), j),
            F.greatest(F.col("own"), j),
            F.when(F.col("own") == j, 2).when(F.col("own") < j, 0).otherwise(1),
            0,
        ),
    )
    against = F.transform(
        F.sequence(F.lit(0), F.col("majors") - 1), lambda j: place(F.col("own"), j, F.lit(0), 1)
    )
    from_major = F.transform(others, lambda i: place(i, F.col("own"), F.lit(1), 1))
    spread = rows.withColumn(
        "to",
        F.explode(
            F.when(~F.col("minor"), from_major).otherwise(
                F.concat(
                    F.when(F.col("minor_rows") > 1, among).otherwise(none),
                    F.when(F.col("majors").isNotNull(), against).otherwise(none),
                )
            )
        ),
    ).select("bucket", "node", "rep", "comp", "to.*")
    second = (
        spread.join(sets, "node")
        .groupBy("bucket", "kind", "i", "j")
        .applyInPandas(_compare(percent), "a long, b long")
    )
    return first.unionByName(write_out(second.distinct(), "near-second"))


def _text_digest(docs: DataFrame, text_column: str) -> Column:
    text = F.coalesce(docs[f"`{text_column}`"].cast("binary"), F.lit(b""))
    return F.xxhash64(text)


def _marked(docs: DataFrame, words: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, digest, n_shingles, component_id, kept`` of every row of ``docs``; rows of one
    id are told apart by ``digest``, that of their text."""
    modest_batches(docs.sparkSession)
    rows = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_column}`").cast("binary"), F.lit(b"")).alias("text"),
        _text_digest(docs, text_column).alias("digest"),
    )
    drawn = write_out(sketches(rows, words), "near-sketches")
    named = drawn.where("node is not null and doc_id is not null")
    # Classes go by a hash of their own in links: their smallest ids may be the same.
    classes = write_out(
        named.groupBy("node").agg(
            F.min("doc_id").alias("first"), F.max("n_shingles").alias("n"), F.count("*").alias("copies")
        ).withColumn("rep", F.xxhash64("node")),
        "near-classes",
    )
    # One row of each class keeps its buckets; the join is on a key that no class repeats.
    reps = named.drop("digest", "n_shingles").join(
        classes.select("node", F.col("first").alias("doc_id"), "rep", "n"), ["node", "doc_id"]
    ).dropDuplicates(["node"])
    spread = reps.select(F.explode("buckets").alias("bucket"), "node", "rep", "n")
    # Buckets of the same members (by two sums of hashes) are one bucket.
    same = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)]
    shared = spread.groupBy("bucket").agg(F.count("*").alias("size"), *same).where("size > 1")
    shared = shared.groupBy("size", "x0", "x1").agg(F.min("bucket").alias("bucket"))
    members = write_out(spread.join(shared.select("bucket", "size"), "bucket"), "near-buckets")
    nodes = members.select("node").distinct().join(classes.select("node", F.col("first").alias("rep")), "node")
    nodes = write_out(nodes, "near-nodes")
    sets = write_out(full_sets(rows.drop("digest"), nodes, words).dropDuplicates(["node"]), "near-sets")
    links = bucket_links(members, sets, percent)
    roots = write_out(components(links), "near-components")
    # A component is kept as its class with the smallest id, of these the one with the least node.
    linked = write_out(_labelled(classes, roots), "near-linked")
    keeper = linked.groupBy("comp").agg(F.min(F.struct("first", "node")).alias("keeper"))
    known = linked.join(keeper, "comp").select(
        "node",
        F.col("keeper.first").alias("component_id"),
        (F.col("keeper.node") == F.col("node")).alias("head"),
        "copies",
    )
    known = write_out(known.where("copies > 1 or not head").drop("copies"), "near-known")
    out = drawn.join(known, "node", "left")
    linked_row = F.col("doc_id").isNotNull() & F.col("component_id").isNotNull()
    component = F.when(linked_row, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        "digest",
        "n_shingles",
        component.alias("component_id"),
        (component.eqNullSafe(F.col("doc_id")) & (~linked_row | F.col("head"))).alias("kept"),
    )


def near_duplicates(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Rows are linked if 100 times the shared shingles are at least ``percent`` times all of
    either; ``component_id`` is the smallest id that links reach. A text without words (NULL
    included) links with nothing, nor does a row without id, which is kept. Rows that repeat an
    id with unlike texts are documents of their own: the id links nothing, and of several in one
    component one is kept. An empty table gives an empty one; other columns are ignored,
    whatever their names.
    """
    return _marked(docs, words, percent, id_column, text_column).drop("digest")


def deduplicate(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns
    as they were."""
    found = _marked(docs, words, percent, id_column, text_column)
    dropped = write_out(found.where("not kept").select("doc_id", "digest").distinct(), "near-dropped")
    # A list that is large by its written size makes this a shuffle of rows that don't repeat.
    key = docs[f"`{id_column}`"].cast("long") == dropped["doc_id"]
    return docs.join(dropped, key & (_text_digest(docs, text_column) == dropped["digest"]), "left_anti")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)
