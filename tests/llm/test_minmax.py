import random

import pytest

from gradus.llm import minmax
from gradus.llm.graph import components
from gradus.llm.minmax import deduplicate, near_duplicates
from tests.llm.helpers import ODD, documents, near_groups


def corpus(seed=3, families=12, copies=14):
    """Families of near copies at all distances, chains, short texts and strangers."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for family in range(families):
        base = draw.choices(vocabulary, k=draw.randrange(8, 90))
        for _ in range(copies):
            words = list(base)
            for _ in range(draw.randrange(0, 1 + len(base) // 8)):
                at = draw.randrange(len(words))
                words[at : at + 1] = draw.choices(vocabulary, k=draw.randrange(0, 3))
            texts.append(" ".join(words).title() if family % 2 else " ".join(words))
            if draw.random() < 0.3:
                base = words  # a chain: later copies leave the first ones behind
    texts += ["", " ", "a", "A", "a b", "b a", "a b c", "a b c d e", "a b c d e f", None]
    ids = draw.sample(range(1000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("words", "percent"), [(2, 80), (1, 80), (5, 80), (2, 90)])
def test_components_equal_all_pairs(spark, words, percent):
    rows = corpus(words)
    got = near_duplicates(documents(spark, rows), words, percent).collect()
    assert sorted(map(tuple, got)) == near_groups(rows, words, percent)


def test_small_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minmax, "BLOCK", 60)
    rows = corpus(9, families=3, copies=40)
    got = near_duplicates(documents(spark, rows), 2).collect()
    assert sorted(map(tuple, got)) == near_groups(rows, 2, 80)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(minmax, "BROADCAST_ROWS", 0)
    rows = corpus(5, families=4)
    got = near_duplicates(documents(spark, rows), 2).collect()
    assert sorted(map(tuple, got)) == near_groups(rows, 2, 80)


def test_odd_rows(spark):
    got = {}
    for r in near_duplicates(documents(spark, ODD)).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == [(0, 1, True)] and got[2] == [(0, 2, True)] and got[3] == [(0, 3, True)]
    assert got[4] == [(4, 4, True)] * 2 and got[5] == [(4, 4, False)]
    assert got[None] == [(4, None, True)]
    docs = documents(spark, ODD)
    out = deduplicate(docs)
    assert out.schema == docs.schema and out.count() == len(ODD) - 1
    assert near_duplicates(documents(spark, [])).count() == 0


def test_graph_components(spark):
    draw = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (9, 7), (7, 9)]
    links += [(500, draw.randrange(501, 900)) for _ in range(200)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161))
    assert got[5] == 5 and got[7] == 7 and got[9] == 7
    assert {got[i] for link in links for i in link if i >= 500} == {500}
    assert len(got) == len({i for link in links for i in link})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_an_id_repeated_with_unlike_texts(spark):
    a, b, c = ([f"{x}{i}" for i in range(40)] for x in "abc")
    alone = [" ".join(x) for x in (a, b, c)]
    near = [" ".join([*x[:-1], "end"]) for x in (a, b, c)]
    rows = [(3, alone[0]), (7, alone[0]), (7, alone[1]), (9, near[1]), (5, near[2]), (7, alone[2])]
    rows += [(20, " ".join(a[:20] + b[:20])), (20, " ".join(a[:20] + b[:19] + ["end"]))]
    docs = documents(spark, rows)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, 1).collect()}
    assert got >= {(3, 40, 3, True), (7, 40, 3, False), (7, 40, 7, True), (9, 40, 7, False), (5, 40, 5, True), (7, 40, 5, False)}
    left = [(r.doc_id, r.text) for r in deduplicate(docs, 1).collect()]
    assert sorted(left[i] for i in range(len(left)) if left[i][0] != 20) == sorted([rows[0], rows[2], rows[4]])
    assert sum(doc_id == 20 for doc_id, _ in left) == 1
