import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gradus.llm import shards
from gradus.llm.queries import QUERIES
from tests.llm.helpers import ODD, documents


def evenly(rows, n_shards):
    """(shard, slot) of all rows: counts at most one apart, slots without a gap."""
    slots = defaultdict(list)
    for shard, slot in rows:
        slots[shard].append(slot)
    counts = [len(slots[s]) for s in range(n_shards)]
    assert set(slots) <= set(range(n_shards))
    assert max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_documents_are_dealt_evenly_and_copies_stay_together(spark):
    rows = [(i, f"text {i}") for i in range(3000)]
    rows += [(10_000 + i, f"copy {i // 4}") for i in range(1200)]
    rows += [(20_000 + i, "the hot one") for i in range(1500)]
    out = shards.shard_documents(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    evenly([(r.shard, r.slot) for r in out], 8)
    want = {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in rows}
    assert {r.doc_id: (r.size, r.text_crc32) for r in out} == want
    at = {r.doc_id: r.shard for r in out}
    groups = [{at[10_000 + 4 * g + j] for j in range(4)} for g in range(300)]
    assert sum(len(g) == 1 for g in groups) >= 285
    hot = Counter(at[20_000 + i] for i in range(1500))
    # It needs two and a bit of the eight shards, its parts are not scattered one by one.
    assert hot.most_common(1)[0][1] > 400


def test_any_links(spark):
    nodes = spark.range(800).withColumnRenamed("id", "node")
    # Forty rings of twenty rows.
    ring = [(20 * g + i, 20 * g + (i + 1) % 20) for g in range(40) for i in range(20)]
    links = spark.createDataFrame(ring + ring[:5] + [(3, 3)], "a long, b long")
    at = {r.node: r for r in shards.propagate(nodes, links, 4, rounds=20, slack=0.1).collect()}
    evenly([(r.shard, r.slot) for r in at.values()], 4)
    cut = sum(at[a].shard != at[b].shard for a, b in ring)
    assert cut < 0.35 * len(ring)  # three quarters are cut by chance


def test_equal_links_join_each_group_and_no_row_has_many(spark):
    rows = spark.range(20_000).select(F.col("id").alias("node"), F.when(F.col("id") < 9000, 0).otherwise(F.col("id") % 5000).alias("g"))
    links = [tuple(r) for r in shards.equal_links(rows, "node", "g").collect()]
    root = list(range(20_000))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    groups = defaultdict(set)
    for r in rows.collect():
        groups[r.g].add(find(r.node))
    assert all(len(x) == 1 for x in groups.values())
    assert len(links) == 20_000 - len(groups)
    assert max(Counter(x for link in links for x in link).values()) <= shards.MIDDLES


def test_numbers_have_no_gap(spark):
    rows = spark.range(5000).select(F.col("id").alias("node"), (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("p"))
    saved, shards.BUCKET_ROWS = shards.BUCKET_ROWS, 100
    try:
        got = shards.numbered(rows, ["g"], F.col("p"), "node", 5000).collect()
    finally:
        shards.BUCKET_ROWS = saved
    for g in range(3):
        mine = sorted((r.at, r.p) for r in got if r.g == g)
        assert [x for x, _ in mine] == list(range(len(mine)))
        assert [p for _, p in mine] == sorted(p for _, p in mine)


@pytest.mark.parametrize("rows", [ODD, [(None, None)] * 30, [(1, "x")], []])
def test_odd_rows(spark, rows):
    out = shards.shard_documents(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((k, len((t or "").encode()) + 1) for k, t in rows)
    evenly([(r.shard, r.slot) for r in out], 8)


def test_shares_leave_no_shard_too_full():
    asked = {(0, 1): 50, (1, 0): 10, (2, 1): 40, (1, 2): 5, (3, 0): 100}
    load, most = [100, 100, 100, 100], 110
    share = shards._room(asked, load, most)
    for t in range(4):
        come = sum(n * share[k] for k, n in asked.items() if k[1] == t)
        gone = sum(n * share[k] for k, n in asked.items() if k[0] == t)
        assert load[t] + come - gone <= most + 1e-3
    assert sum(n * share[k] for k, n in asked.items()) > 30


def test_query_covers_its_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = QUERIES["op13_sharding"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = got.collect()
    assert dict(got.dtypes) == {
        "doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "shard": "int", "slot": "bigint",
        "law": "string", "grown_shard": "int",
    }
    assert sorted((r.doc_id, r.text_crc32) for r in rows) == sorted((r.doc_id, zlib.crc32((r.text or "").encode())) for r in docs)
    evenly([(r.shard, r.slot) for r in rows], 8)
